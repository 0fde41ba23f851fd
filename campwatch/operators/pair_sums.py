"""Sums per pair of nodes, by one exchange of packed columns.

A pair as a row of two names costs Spark's exchange about 23 bytes, several times
what is in it. A task therefore sums what it has, ``CHUNK`` rows at a time, and
sends the sums of one slot as one compressed block of columns; Spark groups the
blocks by slot. A slot holds about ``SLOT`` rows however common a node is: the
links of one node are dealt to ``SHARES`` slots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = SLOT = 2_000_000
SHARES = 64
PACKED = "slot int, n int, size int, pairs binary"
SUMS = "a string, b string, rose long, last_active double"


def summed(changes: DataFrame, slots: int) -> DataFrame:
    """``a, b, rose, last_active`` of rows alike: the sum of ``rose``, the latest ``last_active``."""
    share = F.pmod(F.xxhash64("b"), F.lit(SHARES))
    slot = F.pmod(F.xxhash64("a", share), F.lit(max(1, slots))).cast("int")
    rows = changes.select(slot.alias("slot"), "a", "b", F.col("rose").cast("long"), F.col("last_active").cast("double"))
    return rows.mapInArrow(_packed, PACKED).groupBy("slot").applyInArrow(_merged, SUMS)


def _ordered(x: pa.Array) -> pa.Array:
    """Doubles as integers of the same order, NaN last as Spark has it."""
    bits = np.asarray(x.fill_null(0.0)).view(np.int64)
    return pa.array(bits ^ ((bits >> 63) & np.int64(2**63 - 1)), mask=np.asarray(x.is_null()))


def _doubles(x: np.ndarray) -> np.ndarray:
    return (x ^ ((x >> 63) & np.int64(2**63 - 1))).view(np.float64)


def _totals(rows: pa.Table, keys: list[str]) -> pa.Table:
    out = rows.group_by(keys, use_threads=False).aggregate([("rose", "sum"), ("last", "max")])
    return out.select([*keys, "rose_sum", "last_max"]).rename_columns([*keys, "rose", "last"])


def _packed(batches):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield from _blocks(held)
            held, n = [], 0
    if n:
        yield from _blocks(held)


def _blocks(held: list[pa.RecordBatch]):
    """The sums of some rows, a block a slot."""
    rows = pa.Table.from_batches(held)
    rows = rows.drop_columns(["last_active"]).append_column("last", _ordered(rows["last_active"].combine_chunks()))
    rows = _totals(rows, ["slot", "a", "b"]).sort_by([("slot", "ascending"), ("a", "ascending"), ("b", "ascending")]).combine_chunks()
    slots = rows["slot"].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
    a, b = (_pieces(rows[c].chunk(0)) for c in "ab")
    rose, last = rows["rose"].to_numpy(), rows["last"].chunk(0)
    none, last = np.asarray(last.is_null()).astype(np.uint8), np.asarray(last.fill_null(0))
    out = []
    for i, j in zip(cuts, cuts[1:]):
        planes = (a[0][i:j], b[0][i:j], rose[i:j], last[i:j], none[i:j])
        texts = (t[o[i] : o[j]] for _, o, t in (a, b))
        raw = b"".join([*map(_planes, planes), *map(bytes, texts)])
        out.append((int(slots[i]), j - i, len(raw), pa.compress(raw, "zstd", asbytes=True)))
    for k in range(0, len(out), 64):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 64]), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["slot", "n", "size", "pairs"])


def _pieces(names: pa.Array):
    """Lengths, offsets and bytes of an array of texts."""
    offsets = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1]
    return np.diff(offsets), offsets, memoryview(names.buffers()[2] or b"")


def _planes(x: np.ndarray) -> bytes:
    """First bytes first: those of like numbers are alike."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _opened(n: int, size: int, block: pa.BinaryScalar) -> pa.Table:
    raw, at, columns = pa.decompress(block.as_buffer(), size, "zstd"), 0, []
    for kind in (np.int32, np.int32, np.int64, np.int64, np.uint8):
        width = np.dtype(kind).itemsize
        plane = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        columns.append(np.ascontiguousarray(plane.T).view(kind).reshape(n))
        at += n * width
    names = []
    for lengths in columns[:2]:
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        names.append(pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), raw.slice(at, int(offsets[-1]))]))
        at += int(offsets[-1])
    last = pa.array(columns[3], mask=columns[4].astype(bool))
    return pa.table([*names, pa.array(columns[2]), last], ["a", "b", "rose", "last"])


def _merged(group: pa.Table) -> pa.Table:
    blocks = zip(group["n"].to_pylist(), group["size"].to_pylist(), group["pairs"])
    rows = _totals(pa.concat_tables([_opened(*x) for x in blocks]), ["a", "b"])
    last = rows["last"].combine_chunks()
    none = np.asarray(last.is_null())
    times = pa.array(_doubles(np.asarray(last.fill_null(0))), mask=none)
    return pa.table([rows["a"], rows["b"], rows["rose"], times], ["a", "b", "rose", "last_active"])
