"""Exact deduplication by a tree merge of sorted digest runs.

A record is a fixed number of bytes whose order is that of (digest, check,
length, rank): the best row of a group is the first record of its key. A task
sorts its records and keeps one per key, its best row and the number of rows:
a run. Runs then meet in rounds. In round ``r`` the runs whose number agrees
after division by ``2 ** (bits * r)`` go to one owner, which merges them by a
multiway merge and again keeps the best record of each key and the summed
count. As runs get fewer they are cut into more lanes by the next ``bits`` bits
of the digest, so what one owner holds stays at about one run however many rows
there are, and every round has as many tasks as the one before. A group of
copies, however large, is one record per run from the first level on.

A digest counts as equal only with its verification: SHA-256, an independent
64-bit hash and the length of the normalised text must all agree.

Defined cases: null text is the empty text; all empty texts form one group; a
null id ranks after every other id; rows repeated with the same id stay as
separate output rows of which exactly one is kept (of equal ones, the first in
the table as read); a text of any length is one digest; an empty table gives an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campwatch.llm._common import PLACE, SPACES, forget, place_columns, placed, saved, table, without

KEY = ["digest", "check", "norm_len"]
#: Bytes of a record: its key, its rank and its count.
KEY_BYTES, RANK_BYTES, COUNT_BYTES = 48, 25, 8
WIDTH = KEY_BYTES + RANK_BYTES + COUNT_BYTES
#: Records a task sorts at once into a run.
RUN_RECORDS = 250_000
#: Runs that meet in one round: ``2 ** BITS``.
BITS = 4
_RECORD = np.dtype(
    [("digest", "S32"), ("check", ">u8"), ("norm_len", ">u8"), ("short", ">u8"), ("no_id", "u1"),
     ("row_id", ">u8"), ("pos", ">u8"), ("n", ">u8")]
)
_TOP = np.uint64(1 << 63)
RUN = "run long, lane long, block binary"


def digest_rows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", place: list[str] | None = None
) -> DataFrame:
    """One skinny row per input row: identifier, place in its table, digest and lengths."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), PLACE if place else []
    return (
        df.select(F.col(id_col).cast("long").alias("row_id"), text.alias("body"), *place_columns(place))
        .select(
            "row_id", *own, F.translate("body", SPACES, "").alias("norm"),
            F.length("body").alias("orig_len"),
        )
        .select(
            "row_id", *own,
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.xxhash64(F.lit(17), "norm").alias("check"),
            F.length("norm").cast("long").alias("norm_len"),
            F.col("orig_len").cast("long").alias("orig_len"),
            F.monotonically_increasing_id().alias("pos"),
        )
    )


def _pack(batch: pa.RecordBatch) -> np.ndarray:
    """Records of digest rows (``digest, check, norm_len, orig_len, row_id, pos``)."""
    out = np.zeros(batch.num_rows, _RECORD)
    column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    out["digest"] = np.frombuffer(b"".join(column["digest"].to_pylist()), "S32")
    for name in ("check", "norm_len", "pos"):
        out[name] = column[name].to_numpy().view(np.uint64)
    out["short"] = np.uint64(1 << 63) - column["orig_len"].to_numpy().astype(np.uint64)
    ids = column["row_id"]
    out["no_id"] = ids.is_null().to_numpy(zero_copy_only=False)
    out["row_id"] = ids.fill_null(0).to_numpy().view(np.uint64) ^ _TOP
    out["n"] = 1
    return out


def _records(block: bytes) -> Iterator[bytes]:
    return (block[i : i + WIDTH] for i in range(0, len(block), WIDTH))


def merge(runs: Iterable[Iterable[bytes]]) -> Iterator[bytes]:
    """Multiway merge of sorted runs: the best record of each key, with the summed count."""
    best, n = None, 0
    for record in heapq.merge(*runs):
        if best is not None and record[:KEY_BYTES] == best[:KEY_BYTES]:
            n += int.from_bytes(record[-COUNT_BYTES:], "big")
            continue
        if best is not None:
            yield best[:-COUNT_BYTES] + n.to_bytes(COUNT_BYTES, "big")
        best, n = record, int.from_bytes(record[-COUNT_BYTES:], "big")
    if best is not None:
        yield best[:-COUNT_BYTES] + n.to_bytes(COUNT_BYTES, "big")


def _lanes(block: bytes, lane_bits: int) -> Iterator[tuple[int, bytes]]:
    """A sorted block cut by the first ``lane_bits`` bits of its digests."""
    heads = np.frombuffer(block, np.dtype([("head", ">u8"), ("rest", f"V{WIDTH - 8}")]))["head"]
    lane = heads.astype(np.uint64) >> np.uint64(64 - lane_bits)
    cut = np.flatnonzero(np.diff(lane, prepend=lane[:1] + np.uint64(1)))
    for a, b in zip(cut, [*cut[1:], len(lane)], strict=True):
        yield int(lane[a]), block[int(a) * WIDTH : int(b) * WIDTH]


def _runs_table(rows: list[tuple[int, int, bytes]]) -> list[pa.Array]:
    run, lane, block = zip(*rows, strict=True) if rows else ((), (), ())
    return [pa.array(run, pa.int64()), pa.array(lane, pa.int64()), pa.array(block, pa.binary())]


def _sort_runs(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId(), [], 0

        def flush():
            records = np.frombuffer(b"".join(x.tobytes() for x in held), f"S{WIDTH}")
            block = b"".join(merge([_records(np.sort(records).tobytes())]))
            rows = [(number, lane, part) for lane, part in _lanes(block, bits)]
            return pa.RecordBatch.from_arrays(_runs_table(rows), ["run", "lane", "block"])

        for batch in batches:
            if batch.num_rows:
                held.append(_pack(batch))
                n += batch.num_rows
            if n >= RUN_RECORDS:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return run


def _merge_owned(bits: int, lane_bits: int):
    def run(key: tuple, cell: pa.Table) -> pa.Table:
        blocks = cell.column("block").to_pylist()
        block = b"".join(merge(map(_records, blocks)))
        rows = [(key[0].as_py(), lane, part) for lane, part in _lanes(block, lane_bits)]
        return pa.Table.from_arrays(_runs_table(rows), ["run", "lane", "block"])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*KEY, "best_len", "best_id", "best_pos", "n"]
    for batch in batches:
        for block in batch.column(2):
            got = np.frombuffer(block.as_buffer(), _RECORD)
            raw = np.frombuffer(block.as_buffer(), np.uint8).reshape(-1, WIDTH)
            plain = {c: got[c].astype(np.uint64) for c in ("check", "norm_len", "short", "row_id", "pos", "n")}
            ids = (plain["row_id"] ^ _TOP).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in raw[:, :32]], pa.binary()),
                 pa.array(plain["check"].view(np.int64)), pa.array(plain["norm_len"].view(np.int64)),
                 pa.array((_TOP - plain["short"]).view(np.int64)),
                 pa.array(ids, mask=got["no_id"].astype(bool)), pa.array(plain["pos"].view(np.int64)),
                 pa.array(plain["n"].view(np.int64))], names,
            )


def sorted_runs(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """The first level: every task's rows as sorted runs, cut into ``2 ** bits`` lanes."""
    cols = rows.select(*KEY, "orig_len", "row_id", "pos")
    return cols.mapInArrow(_sort_runs(bits), RUN)


def merge_round(runs: DataFrame, bits: int, lane_bits: int) -> DataFrame:
    """Runs go to their owners lane by lane, are merged, and are cut into finer lanes."""
    owner = F.shiftright("run", bits).alias("run")
    return runs.select(owner, "lane", "block").groupBy("run", "lane").applyInArrow(
        _merge_owned(bits, lane_bits), RUN
    )


def merge_runs(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """Merge the sorted runs of ``rows`` round by round into one record per key.

    Returns ``digest, check, norm_len, best_len, best_id, best_pos, n``. One
    number per round reaches the driver.
    """
    if not 1 <= bits <= 8:
        raise ValueError("a round merges 2 to 256 runs")
    runs, lane_bits = saved(sorted_runs(rows, bits), "runs"), bits
    last = runs.agg(F.max("run")).first()[0] or 0
    while True:
        last, lane_bits = last >> bits, min(lane_bits + bits, 48)
        merged = saved(merge_round(runs, bits, lane_bits), "runs")
        forget(runs)
        runs = merged
        if not last:
            break
    return runs.mapInArrow(
        _unpack, "digest binary, check long, norm_len long, best_len long, best_id long, best_pos long, n long"
    )


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, place: list[str] | None = None
) -> DataFrame:
    """Group of every row: keeper, size, whether this row stays, and digest.

    Returns ``row_id, keep_id, group_size, kept, text_sha256, orig_len``, one row
    per input row, and where the row lies if ``place`` names the columns of a ``placed`` table.
    """
    rows = saved(digest_rows(df, id_col, text_col, place), "digests")
    groups = saved(merge_runs(rows, bits), "digest-groups")
    # Both sides come from written tables, so adaptive execution may split a hot digest.
    return rows.join(groups, KEY).select(
        "row_id",
        F.col("best_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("pos") == F.col("best_pos")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "orig_len",
        *(PLACE if place else []),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts, columns unchanged.

    Rows go by their place in the table, so a text is hashed once and rows that
    agree in every column are still told apart.
    """
    rows, place = placed(df)
    gone = exact_dedup(rows, id_col, text_col, place=place).where("NOT kept").select(*PLACE)
    return without(rows, place, gone, df.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        F.col("row_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS olen,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY olen DESC, doc_id NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
