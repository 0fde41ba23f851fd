"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, passed over at most
``max_repeat`` times. A document's virtual finish time is the number of words
its source has sent once the document is through, divided by the source's
weight. All copies are range-sorted by that time and the order is cut where the
running total reaches the budget. A queue that runs dry leaves its share to the
others, so the cut is the water level of the capped targets.

The order inside a source is a running sum in two passes (totals of hash
buckets, then rows inside a bucket), so no source is ever in one task.

Defined cases: null text has size 0; a null source is a source of its own and
ranks last; documents of size 0 are never taken; repeated rows are separate
documents, whose order among themselves is that of the table as read; a text of
any length is one number; an empty table gives an empty result; other columns
are ignored, whatever their names. Whole documents are taken, so a source is
off its target by part of a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campwatch.llm._common import PLACE, column, forget, free_names, place_columns, placed, saved, table, word_count

ROWS_PER_BUCKET = 20_000
#: Copies in one range of finish times, about; ranges follow the number of rows.
ROWS_PER_RANGE = 100_000
SEED = 20_011


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2
) -> DataFrame:
    """Weight, rank and water-filled target of each source.

    ``sizes`` has one row per source: ``source, source_size``. The level is the
    first one, in order of the level at which a source is full, that the next
    source still absorbs.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ring = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn(
        "weight", F.element_at(ring, (F.col("rank") % len(weights) + 1).cast("int"))
    ).withColumn("full", F.col("source_size") * float(cap) / F.col("weight"))
    upto = Window.orderBy("full", "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("full", "rank").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("full", "rank").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    full_before = F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * float(cap)
    budget = F.least(F.lit(float(share)), F.lit(float(cap))) * F.sum("source_size").over(everything)
    level = (budget - full_before) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level", level)
    holds = F.when(F.col("level") <= F.col("full"), F.struct("full", "rank", "level"))
    water = F.min(holds).over(everything)["level"]
    return ranked.select(
        "source",
        "rank",
        "weight",
        "source_size",
        F.least(F.col("weight") * F.coalesce(water, F.max("full").over(everything)),
                F.col("source_size") * float(cap)).alias("target"),
    )


def _cut(copies: DataFrame, budget: float, rows: int) -> tuple[float, int] | None:
    """Range-sort copies by (finish, rank) and find the last one within the budget."""
    n = max(int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE))
    ranged = saved(
        copies.repartitionByRange(n, "finish", "rank").withColumn("pid", F.spark_partition_id()),
        "finish-times",
    )
    # One number per range partition reaches the driver.
    totals = sorted(ranged.groupBy("pid").agg(F.sum("size")).collect())
    used, at = 0, None
    for pid, total in totals:
        if used + total > budget:
            at = pid
            break
        used += total
    running = F.sum("size").over(
        Window.orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    last = ranged.where("true" if at is None else f"pid < {at}").select("finish", "rank")
    if at is not None:
        edge = ranged.where(f"pid = {at}").withColumn("running", running)
        last = last.union(edge.where(F.col("running") <= budget - used).select("finish", "rank"))
    found = last.agg(F.max(F.struct("finish", "rank"))).first()[0]
    forget(ranged)
    return None if found is None else (found["finish"], found["rank"])


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: int = 2,
    place: list[str] | None = None,
) -> DataFrame:
    """Words each document contributes to the mix, one row per input row.

    Returns ``row_id, source, size, source_size, target, copies, taken``, and
    where the row lies if ``place`` names the columns of a ``placed`` table.
    """
    own = PLACE if place else []
    rows = saved(
        df.select(
            F.col(id_col).alias("row_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            row_key(id_col, text_col).alias("row_key"),
            F.monotonically_increasing_id().alias("pos"),
            *place_columns(place),
        ),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = saved(source_targets(sizes, weights, share, max_repeat), "sources")
    n_rows, budget = rows.count(), sources.agg(F.sum("target")).first()[0] or 0.0
    buckets = max(256, -(-n_rows // ROWS_PER_BUCKET))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "row_key"), F.lit(buckets)))
    per_bucket = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = saved(
        per_bucket.select(
            F.col("source").alias("s"),
            F.col("bucket").alias("b"),
            F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("start"),
        ),
        "bucket-starts",
    )
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy(F.xxhash64(F.lit(SEED + 1), "row_key"), "row_key", "row_id", "size", "pos")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    queued = dealt.withColumn("within", F.sum("size").over(inside))
    queued = queued.join(
        starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    ).drop("s", "b")
    facts = sources.withColumnRenamed("source", "s")
    queued = saved(
        queued.join(facts, F.col("source").eqNullSafe(F.col("s"))).select(
            "row_id", "source", "size", "source_size", "target", "rank", "weight", *own,
            (F.col("start") + F.col("within")).alias("sent"),
        ),
        "queues",
    )

    def finish(turn: Column | int) -> Column:
        return (F.col("sent") + F.col("source_size") * turn) / F.col("weight")

    copies = queued.where("size > 0").select(
        F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))).alias("turn"), "*"
    )
    cut = _cut(copies.select(finish(F.col("turn")).alias("finish"), "rank", "size"), budget, n_rows * max_repeat)
    if cut is None:
        count = F.lit(0)
    else:
        goes = [
            F.struct(finish(t), F.col("rank")) <= F.struct(F.lit(cut[0]), F.lit(cut[1]))
            for t in range(max_repeat)
        ]
        count = sum((F.when(g, 1).otherwise(0) for g in goes), F.lit(0))
    count = F.when(F.col("size") > 0, count).otherwise(0)
    return queued.select(
        "row_id", "source", "size", "source_size", "target", *own,
        count.alias("copies"), (count * F.col("size")).cast("long").alias("taken"),
    )


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col))


def apply_mix(df: DataFrame, **options) -> DataFrame:
    """``df`` with each row repeated as often as the mix takes it (0 drops it).

    Counts go to rows by their place in the table, so rows that agree in id and
    text, or in every column, each get their own.
    """
    rows, place = placed(df)
    count, copy = free_names(rows, ["copies", "copy"])
    plan = mix(rows, place=place, **options).where("copies > 0").select(*PLACE, "copies")
    taken = rows.join(saved(plan, "taken").toDF(*place, count), place)
    copies = F.explode(F.sequence(F.lit(1), column(count)))
    return taken.withColumn(copy, copies).select(*map(column, df.columns))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("row_id").alias("doc_id"), "size", "source_size", "target", "taken", "source"
    )
