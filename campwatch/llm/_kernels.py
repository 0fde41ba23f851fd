"""Vectorised word hashing over Arrow string buffers.

A word's hash goes through its bytes in blocks of eight, all words side by side,
by two functions with constants of their own, each of which mixes every block
before the next; no Python object is made per word. The few words of more than
LONG bytes are hashed one by one.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a word that are hashed block by block; longer words go through BLAKE2.
LONG = 256
#: Bytes of text handled at once; a single longer text is handled alone.
SLICE = 1 << 20
_U = np.uint64


_BASE = 0x9E3779B97F4A7C15
#: One odd factor and one start for each of the two functions.
_FACTORS = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))
_SEEDS = (_U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3))
#: The bytes of a block that belong to a word of which 0 to 8 bytes are left.
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], _U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@functools.cache
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy(run: Callable) -> Callable:
    """An Arrow function whose worker hands back free memory when a task ends.

    Workers outlive stages; without this each keeps the most it ever needed.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if _trim():
                _trim()(0)

    return tidied


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` bytes together, or one row."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


class Words:
    """Words of consecutive texts: hashes, byte spans, and first word of each text."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = True):
        self.raw = _LOWER[raw] if lower else raw
        n = len(raw)
        inside = ~_SPACE[raw]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | first[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offs)
        self._blocks: np.ndarray | None = None

    def _segment(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of bytes [starts, ends)."""
        if self._blocks is None:
            padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
            self._blocks = np.lib.stride_tricks.sliding_window_view(padded, 8)
        sizes = ends - starts
        one, two = (sizes.astype(_U) * f ^ s for f, s in zip(_FACTORS, _SEEDS, strict=True))
        left, at, rest = np.flatnonzero(sizes <= LONG), starts, sizes
        if len(left) < len(sizes):
            at, rest = starts[left], sizes[left]
        with np.errstate(over="ignore"):
            while len(left):
                block = self._blocks[at].view(_U)[:, 0] & _MASK[np.minimum(rest, 8)]
                one[left] = mix64(one[left] ^ (block * _FACTORS[0]))
                two[left] = mix64((two[left] + block) * _FACTORS[1])
                more = np.flatnonzero(rest > 8)
                left, at, rest = left[more], at[more] + 8, rest[more] - 8
            out = mix64(one ^ ((two << _U(32)) | (two >> _U(32))))
        for i in np.flatnonzero(sizes > LONG):
            digest = hashlib.blake2b(self.raw[starts[i] : ends[i]], digest_size=8).digest()
            out[i] = np.frombuffer(digest, _U)[0]
        return out

    def hashes(self) -> np.ndarray:
        return self._segment(self.starts, self.ends)

    def prefixes(self, length: int) -> np.ndarray:
        """Hash of each word's first ``length`` bytes (of the word, if it is shorter)."""
        return self._segment(self.starts, np.minimum(self.ends, self.starts + length))


def shingle_sets(raw: np.ndarray, offs: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Words are lower-cased (A-Z). A text of fewer than ``k`` words has its whole
    sequence as one shingle; a text without words has none.
    """
    words = Words(raw, offs)
    h = words.hashes()
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(h) - k + 1, 0), _U)
        for i in range(k):
            rolled = rolled * _U(_BASE) + h[i : i + len(rolled)]
        rolled = mix64(rolled)
        for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            if b - a >= k:
                own = np.sort(rolled[a : b - k + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                one = _U(b - a)
                for x in h[a:b]:
                    one = one * _U(_BASE) + x
                yield mix64(np.array([one ^ _U(0x5851F42D4C957F2D)], _U))
            else:
                yield np.empty(0, _U)
