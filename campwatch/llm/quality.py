"""Quality selection by importance resampling.

Two bag-of-n-gram models over hashed byte n-grams are counted: one of target
text (documents labelled good), one of all raw text. A document's importance
weight is the ratio of its likelihoods under both; adding Gumbel noise to its
logarithm and keeping the ``k`` largest keys samples ``k`` documents without
replacement in proportion to the weights.

The raw model is counted over every document. The target model is counted over
a bounded sample of labelled rows (``TARGET_ROWS``, the smallest by a hash of
the id). Noise comes from a hash of the id and the text, so reruns agree. The cut of the top
``k`` is found by range-sorting the keys and counting range partitions.

Defined cases: null text is empty, weighs 1 (log weight 0) and takes part in
the draw; rows repeated with the same id and text have one key, and where the
cut falls among them those read first are drawn, so that exactly ``k`` rows
are; a text longer than a slice is counted in overlapping parts; null labels do
not count as good; without good labels all weights are 1; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campwatch.llm import _kernels as K
from campwatch.llm._common import forget, saved, table

BUCKETS, GRAM = 1 << 14, 4
SMOOTH = 1.0
#: Good documents counted for the target model, at most; share of documents drawn.
TARGET_ROWS, KEEP = 20_000, 0.85
SEED = 905
#: Keys in one range, about; ranges follow the number of rows.
ROWS_PER_RANGE = 100_000


def _grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram that lies inside one text, and their counts by text."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    h = np.zeros(n, np.uint32)
    for i in range(GRAM):
        h = (h << np.uint32(8)) | raw[i : i + n]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    per_text = np.maximum(np.diff(offs) - GRAM + 1, 0)
    first = np.repeat(offs[:-1] - (np.cumsum(per_text) - per_text), per_text)
    return h[first + np.arange(len(first))].astype(np.int64), per_text


def _texts(column: pa.Array):
    raw, offs = K.buffers(column)
    for a, b in K.slices(offs):
        lo = offs[a]
        # One text longer than a slice is taken in overlapping parts.
        if offs[b] - lo > K.SLICE:
            for o in range(0, int(offs[b] - lo), K.SLICE):
                part = raw[lo + o : min(lo + o + K.SLICE + GRAM - 1, offs[b])]
                yield a, a + 1, *_grams(part, np.array([0, len(part)]))
        else:
            yield a, b, *_grams(raw[lo : offs[b]], offs[a : b + 1] - lo)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, grams, _ in _texts(batch.column(0)):
            total += np.bincount(grams, minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts by bucket over the one text column of ``texts``; BUCKETS numbers reach the driver."""
    found = texts.mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    out = np.zeros(BUCKETS)
    for bucket, n in found.collect():
        out[bucket] = n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket, log of the smoothed probability in target text over that in raw text."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p, q = ((c + SMOOTH) / (c.sum() + SMOOTH * BUCKETS) for c in (target, raw))
    return np.log(p) - np.log(q)


def _weigh(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            sums = np.zeros(batch.num_rows)
            for a, b, grams, per_text in _texts(batch.column(2)):
                text = np.repeat(np.arange(a, b), per_text)
                np.add.at(sums, np.arange(a, b), np.bincount(text - a, ratio[grams], b - a))
            u = (batch.column(1).to_numpy().view(np.uint64) >> np.uint64(11)).astype(float)
            gumbel = -np.log(-np.log((u + 0.5) / float(1 << 53)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums), pa.array(sums + gumbel)],
                ["row_id", "log_weight", "sample_key"],
            )

    return run


def top_cut(keys: DataFrame, k: int, rows: int) -> tuple[float, int] | None:
    """``sample_key`` and ``pos`` of the ``k``-th row, larger keys and then lower positions first.

    One number per range partition reaches the driver.
    """
    n = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE))
    order = [F.desc("sample_key"), F.asc("pos")]
    ranged = saved(
        keys.select("sample_key", "pos").repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id()),
        "keys",
    )
    left, cut = k, None
    for pid, held in sorted(ranged.groupBy("pid").count().collect()):
        if held >= left:
            at = ranged.where(F.col("pid") == pid).withColumn("r", F.row_number().over(Window.orderBy(*order)))
            cut = tuple(at.where(F.col("r") == left).select("sample_key", "pos").first())
            break
        left -= held
    forget(ranged)
    return cut


def resample(
    docs: DataFrame, good_ids: DataFrame, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``row_id, log_weight, sample_key, selected``: the draw of exactly ``keep`` of all rows.

    ``good_ids`` has one column of ids of target documents.
    """
    spark = docs.sparkSession
    few = good_ids.toDF("__good").distinct()
    few = few.orderBy(F.xxhash64(F.lit(SEED), "__good"), "__good").limit(TARGET_ROWS)
    # At most TARGET_ROWS integers: a proven bound.
    target = docs.join(F.broadcast(few), F.col(id_col) == F.col("__good")).select(text_col)
    ratio = log_ratio(gram_counts(target), gram_counts(docs.select(text_col)))
    noise = F.xxhash64(F.lit(SEED + 1), id_col, text_col)
    keys = saved(
        docs.select(F.col(id_col).cast("long").alias("row_id"), noise.alias("noise"), text_col)
        .mapInArrow(_weigh(spark.sparkContext.broadcast(ratio)), "row_id long, log_weight double, sample_key double")
        .withColumn("pos", F.monotonically_increasing_id()),
        "weights",
    )
    rows = keys.count()
    k = round(rows * keep)
    cut = top_cut(keys, k, rows) if k else None
    chosen = F.lit(False)
    if cut is not None:
        tied = (F.col("sample_key") == cut[0]) & (F.col("pos") <= cut[1])
        chosen = (F.col("sample_key") > cut[0]) | tied
    return keys.withColumn("selected", chosen).drop("pos")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return resample(table(spark, sf_dir, "documents"), labels).withColumnRenamed("row_id", "doc_id")
