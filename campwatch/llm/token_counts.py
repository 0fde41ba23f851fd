"""Exact token counts at every prefix, for sentencepiece BPE models.

A dynamic programme over the prefixes of a word: the encoding of a prefix ends
in exactly one piece, the one that is compatible with the piece before it, so

    last[i] = the piece p ending at i that is compatible with last[i - len(p)]
    count[i] = count[i - len(p)] + tokens of p

Two pieces are compatible if no merge across their border comes before the
merges that made them; undoing these merges from the last on decides it. A
character without a piece stands for its UTF-8 bytes. No piece reaches from a
non-space character to a following space, so words (each with the spaces before
it) are independent; a worker takes the unseen words of many texts through the
programme together, and remembers them.

``token_prefixes`` stores, for every text, the count at every one of its
prefixes, as the steps from one prefix to the next (one byte a character). ``PrefixTable`` answers from the stored steps alone how
many tokens the first x characters are and how many characters fit a budget;
neither the text nor the model is needed again. Counts can fall as a prefix
grows, and the longest prefix within a budget takes that into account.

The library checks the programme: the count of every distinct word is compared
with its encoding, and a word on which they differ is counted prefix by prefix
by the library itself.

Defined cases: null text is empty; an empty text has no tokens; repeated rows
are counted each; an empty table gives an empty result; other columns are
ignored. Texts are never truncated; time grows linearly with their length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campwatch.llm._common import saved, table

LIMIT = 4096
#: Words a worker remembers, and the longest one it remembers; only speed depends on them.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
#: Texts worked through at once, in characters; a longer text is taken alone.
CHARS_AT_ONCE = 1 << 20
SPACE = "▁"
BASE = 0x9E3779B97F4A7C15
_RUNS = re.compile(" +[^ ]*")


class Memo(dict):
    """Bounded memory of a function of a word."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of = of

    def __missing__(self, word):
        found = self.of(word)
        if len(self) < REMEMBERED and len(word) <= REMEMBERED_CHARS:
            self[word] = found
        return found


class PieceCounter:
    """Counts at every prefix of a word, by the pieces of one model."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [
            i for i in range(len(lib))
            if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))
        ]
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece of this model spans words")
        self.longest = max(map(len, self.score), default=1)
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.number = {p: i for i, p in enumerate(self.score)}
        self.names = list(self.score)
        hashes = np.array([self._hash(p) for p in self.names], np.uint64)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.fits: dict[int, bool] = {}
        #: Pairs of pieces decided so far, sorted, and those decided last.
        self.pairs, self.good = np.empty(0, np.int64), np.empty(0, bool)
        self.new_pairs, self.new_good = np.empty(0, np.int64), np.empty(0, bool)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * BASE + ord(c) + 1) & (1 << 64) - 1
        return h

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            self.parts.setdefault(parts[at] + parts[at + 1], (parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes ``piece``; none for a character, or if no merge does."""
        if len(piece) == 1:
            return None
        if piece not in self.parts:
            self.merged(piece)
        return self.parts.setdefault(piece, None)

    def reachable(self, piece: str) -> bool:
        return len(piece) == 1 or self.halves(piece) is not None and self.merged(piece) == [piece]

    def compatible(self, one: str, two: str) -> bool:
        """Whether ``one`` and ``two`` stay apart when their characters are merged from scratch."""
        score, undone, left = self.score, None, False
        while True:
            across = score.get(one + two)
            if across is not None and (undone is None or across > undone or (across == undone and not left)):
                return False
            a, b = self.halves(one), self.halves(two)
            if a is None and b is None:
                return True
            # The later of two merges has the lower score; of equal scores, the one to the right.
            if b is not None and (a is None or score[two] <= score[one]):
                undone, left, two = score[two], False, b[0]
            else:
                undone, left, one = score[one], True, a[1]

    def _decide(self, pair: int) -> bool:
        """Whether the piece of a pair is a piece by itself and stays apart from the one before it."""
        before, piece = (pair >> 24) - 1, self.names[pair & (1 << 24) - 1]
        return self.reachable(piece) and (before < 0 or self.compatible(self.names[before], piece))

    def prefix_counts(self, word: str) -> np.ndarray:
        """Tokens of each prefix of ``word`` after its space: index 0 is the space alone."""
        text, number, fits = SPACE + word.replace(" ", SPACE), self.number, self.fits
        last, count = [-1], [0]
        for i in range(1, len(text) + 1):
            if text[i - 1] not in number:
                last.append(-1)
                count.append(count[i - 1] + len(text[i - 1].encode()))
                continue
            for size in range(1, min(i, self.longest) + 1):
                piece = number.get(text[i - size : i])
                if piece is None:
                    continue
                pair = (last[i - size] + 1 << 24) + piece
                good = fits.get(pair)
                if good is None:
                    good = self._decide(pair)
                    if len(fits) < REMEMBERED:
                        fits[pair] = good
                if good:
                    last.append(piece)
                    count.append(count[i - size] + 1)
                    break
            else:
                return self._by_library(word)
        if count[-1] != (len(self.library.encode(word)) if word else 1):
            return self._by_library(word)
        return np.array(count[1:], np.int32)

    def _known(self, pair: np.ndarray) -> np.ndarray:
        """Whether each pair fits; new ones are decided once and kept."""
        good, open_ = np.zeros(len(pair), bool), np.ones(len(pair), bool)
        for keys, values in ((self.pairs, self.good), (self.new_pairs, self.new_good)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                hit = keys[at] == pair
                good[hit], open_[hit] = values[at[hit]], False
        if open_.any():
            fresh, back = np.unique(pair[open_], return_inverse=True)
            found = np.array([self._decide(int(x)) for x in fresh])
            good[open_] = found[back]
            self.new_pairs, self.new_good = _joined(self.new_pairs, self.new_good, fresh, found)
            if len(self.new_pairs) > 4096:
                if len(self.pairs) < 10 * REMEMBERED:
                    self.pairs, self.good = _joined(self.pairs, self.good, self.new_pairs, self.new_good)
                self.new_pairs, self.new_good = np.empty(0, np.int64), np.empty(0, bool)
        return good

    def prefix_counts_of(self, words: list[str]) -> list[bytes]:
        """The same for many words of at most REMEMBERED_CHARS characters, position by position.

        A count is one byte: a character is four tokens at most.
        """
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n) + 1
        codes = np.array([SPACE + w.replace(" ", SPACE) for w in words], f"U{int(sizes.max())}").view(np.uint32)
        codes = codes.reshape(n, -1).astype(np.uint64)
        width = codes.shape[1]
        power = np.ones(width + 1, np.uint64)
        power[1:] = np.multiply.accumulate(np.full(width, BASE & (1 << 64) - 1, np.uint64))
        rolled = np.zeros((n, width + 1), np.uint64)
        for i in range(width):
            rolled[:, i + 1] = rolled[:, i] * power[1] + codes[:, i] + np.uint64(1)
        last, count = np.full((n, width + 1), -1, np.int64), np.zeros((n, width + 1), np.int64)
        lost = np.zeros(n, bool)
        for i in range(1, width + 1):
            left = np.flatnonzero(sizes >= i)
            for size in range(1, min(i, self.longest) + 1):
                if not len(left):
                    break
                h = rolled[left, i] - rolled[left, i - size] * power[size]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                piece = np.where(self.hashes[at] == h, self.by_hash[at], -1)
                if size == 1:
                    bare = left[piece < 0]
                    c = codes[bare, i - 1]
                    count[bare, i] = count[bare, i - 1] + 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                    left, piece = left[piece >= 0], piece[piece >= 0]
                some = np.flatnonzero(piece >= 0)
                if not len(some):
                    continue
                row = left[some]
                fits = self._known((last[row, i - size] + 1 << 24) + piece[some])
                row, done = row[fits], some[fits]
                last[row, i], count[row, i] = piece[done], count[row, i - size] + 1
                left = np.delete(left, done)
            lost[left] = True
        total = np.fromiter(map(len, self.library.encode(words, num_threads=1)), np.int64, n)
        total[sizes == 1] = 1
        lost |= count[np.arange(n), sizes] != total
        small = count.astype(np.uint8)
        return [
            self._by_library(w).astype(np.uint8).tobytes() if lost[j] else small[j, 1 : sizes[j] + 1].tobytes()
            for j, w in enumerate(words)
        ]

    def _by_library(self, word: str) -> np.ndarray:
        return np.array([1] + [len(self.library.encode(word[:i])) for i in range(1, len(word) + 1)], np.int32)


def _joined(keys: np.ndarray, values: np.ndarray, more: np.ndarray, more_values: np.ndarray):
    at = np.searchsorted(keys, more)
    return np.insert(keys, at, more), np.insert(values, at, more_values)


class Words:
    """Prefix counts of words as bytes, remembered for words that come again."""

    def __init__(self, counter: PieceCounter):
        self.counter, self.held = counter, {}

    def of(self, words: set[str]) -> dict[str, bytes]:
        """Counts of at least ``words``; longer ones than REMEMBERED_CHARS are left out."""
        fresh = [w for w in words if w not in self.held and len(w) <= REMEMBERED_CHARS]
        found: dict[str, bytes] = {}
        for o in range(0, len(fresh), 16_384):
            part = fresh[o : o + 16_384]
            # Words of like length share a table without much empty room.
            part.sort(key=len)
            for p in range(0, len(part), 2048):
                group = part[p : p + 2048]
                found.update(zip(group, self.counter.prefix_counts_of(group), strict=True))
        if len(self.held) + len(found) <= REMEMBERED:
            self.held.update(found)
            return self.held
        return found | {w: self.held[w] for w in words if w in self.held}


@lru_cache(maxsize=2)
def counter(model: str) -> Words:
    return Words(PieceCounter(model))


def split_words(text: str) -> list[str]:
    """The words of a text, each without the one space that the library puts before it."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _RUNS.findall(" " + text)]
    return text.split(" ")


def prefix_counts(words: list[str], known: dict[str, bytes], own: PieceCounter) -> np.ndarray:
    """Tokens of the first 0, 1, ... characters of a text, from its words."""
    if not words:
        return np.zeros(1, np.int64)
    parts = [known.get(w) for w in words]
    if None in parts:
        plain = [
            own.prefix_counts(w) if p is None else np.frombuffer(p, np.uint8)
            for w, p in zip(words, parts, strict=True)
        ]
        inside = np.concatenate([p.astype(np.int64) for p in plain])
    else:
        plain, inside = parts, np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    totals = np.fromiter((p[-1] for p in plain), np.int64, len(plain))
    counts = inside + np.repeat(np.cumsum(totals) - totals, sizes)
    # The library's space before a text is no prefix of it, and an empty text has no token.
    counts[0] = 0
    return counts


def texts_prefix_counts(texts: list[str], words: Words) -> Iterator[np.ndarray]:
    """``prefix_counts`` of each text, unseen words of all of them together."""
    split = [split_words(t) for t in texts]
    known = words.of(set().union(*split)) if split else {}
    return (prefix_counts(w, known, words.counter) for w in split)


class PrefixTable:
    """Token count of every prefix of one text, from its stored steps."""

    def __init__(self, steps: bytes):
        own = np.frombuffer(steps, np.int8)
        self.counts = np.zeros(len(own) + 1, np.int64)
        np.cumsum(own, out=self.counts[1:])

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters."""
        return int(self.counts[min(max(chars, 0), len(self.counts) - 1)])

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        good = np.flatnonzero(self.counts <= budget)
        return int(good[-1]) if len(good) else 0


def _steps(counts: np.ndarray) -> bytes:
    """From one prefix to the next a count rises by 4 and falls by a piece's length at most."""
    steps = np.diff(counts)
    if len(steps) and (steps.min() < -128 or steps.max() > 127):
        raise ValueError("a step does not fit a byte")
    return steps.astype(np.int8).tobytes()


def _prefixes(model: str):
    names = ["row_id", "n_bytes", "steps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(model)
        for batch in batches:
            ids, texts, at, size = batch.column(0), [], 0, 0
            for i in range(batch.num_rows):
                texts.append(batch.column(1)[i].as_py() or "")
                size += len(texts[-1])
                if size > CHARS_AT_ONCE or i + 1 == batch.num_rows:
                    steps = [_steps(c) for c in texts_prefix_counts(texts, words)]
                    n_bytes = [len(t.encode()) for t in texts]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, len(texts)), pa.array(n_bytes, pa.int64()), pa.array(steps, pa.binary())], names
                    )
                    texts, at, size = [], i + 1, 0

    return run


def token_prefixes(
    df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``row_id, n_bytes, steps``: by how much the count grows from each prefix to the next."""
    return df.select(F.col(id_col).cast("long").alias("row_id"), text_col).mapInArrow(
        _prefixes(model), "row_id long, n_bytes long, steps binary"
    )


def _answers(limit: int):
    names = ["row_id", "n_bytes", "n_tokens", "chars_within_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, within = [], []
            for steps in batch.column(2):
                stored = PrefixTable(steps.as_buffer())
                total.append(int(stored.counts[-1]))
                within.append(stored.fit(limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(within, pa.int64())], names
            )

    return run


def budget_answers(prefixes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Token count of every stored text, and the characters of its longest prefix within ``limit``."""
    return prefixes.select("row_id", "n_bytes", "steps").mapInArrow(
        _answers(limit), "row_id long, n_bytes long, n_tokens long, chars_within_limit long"
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    stored = saved(
        token_prefixes(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")),
        "token-prefixes",
    )
    return budget_answers(stored).select(
        F.col("row_id").alias("doc_id"),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
        "chars_within_limit",
    )
