"""Conversations over time: turn numbers, bursts, windows, salience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campwatch.functions import text as X

BURST_MS, SHORT_WORDS = 4000, 4
RING = 12
HALF_LIFE_S = 3 * 86_400


def reassemble(df: DataFrame, conv: str, sender: str, ts_ms: str, text: str, order: list[str]) -> DataFrame:
    """Join rapid bursts of short messages of one sender into turns.

    A message continues the turn before it when the sender is the same, at most
    BURST_MS passed, and the message before it is short. Turn borders are gaps
    found with ``lag``; turns are numbered by a running sum.
    """
    w = Window.partitionBy(conv).orderBy(*order)
    clean = df.withColumn("__norm", X.normalize(F.col(text)))
    joins = (
        (F.lag(sender).over(w) == F.col(sender))
        & (F.col(ts_ms) - F.lag(ts_ms).over(w) <= BURST_MS)
        & (F.lag(F.size(X.words(F.col("__norm")))).over(w) <= SHORT_WORDS)
    )
    marked = clean.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("turn", F.sum("__new").over(w))
    part = F.struct(*[F.col(c) for c in order], F.col("__norm").alias("t"))
    return marked.groupBy(conv, "turn").agg(
        F.min_by(sender, F.struct(*order)).alias("sender"),
        F.trim(
            F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), " ")
        ).alias("text"),
        F.min_by(ts_ms, F.struct(*order)).alias("start_ms"),
        F.max_by(ts_ms, F.struct(*order)).alias("end_ms"),
        F.count("*").alias("n_messages"),
    )


def numbered(df: DataFrame, conv: str, order: list[str]) -> DataFrame:
    """Adds ``turn_index``, from 1."""
    return df.withColumn("turn_index", F.row_number().over(Window.partitionBy(conv).orderBy(*order)))


def ring(df: DataFrame, conv: str, order: list[str], size: int = RING) -> DataFrame:
    """The newest ``size`` turns of each conversation."""
    newest = Window.partitionBy(conv).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("age", F.row_number().over(newest) - 1).where(F.col("age") < size)


def salience(weight: Column, age_s: Column) -> Column:
    """Weight halved every three days; never below zero age."""
    return weight * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_s) / F.lit(float(HALF_LIFE_S)))


def elapsed(df: DataFrame, key: str, ts: str, order: list[str]) -> DataFrame:
    """Adds ``elapsed_since_prev``; null for a key's first row."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("elapsed_since_prev", F.col(ts) - F.lag(ts).over(w))


def cited(spans: Column, text: Column) -> Column:
    """What a risk flag quotes: its spans, or the first 80 characters of its sentence."""
    joined = F.array_join(spans, ", ")
    return F.when(joined != "", joined).otherwise(F.substring(text, 1, 80))


def structured_summary(flags: DataFrame, entities: DataFrame, now: Column, conv: str = "conv_id") -> DataFrame:
    """Per conversation: flags (tactic, turn, confidence, evidence) and entities with their present salience.

    ``entities`` has ``conv, kind, value, weight, last_seen``. Flags never expire.
    """
    flag = F.struct("turn", "tactic", F.round("confidence", 3).alias("confidence"), "evidence")
    by_flag = flags.groupBy(conv).agg(F.array_sort(F.collect_list(flag)).alias("risk_flags"))
    score = F.round(salience(F.col("weight").cast("double"), now - F.col("last_seen")), 3)
    entity = F.struct("kind", "value", score.alias("salience"))
    by_entity = entities.groupBy(conv).agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    return by_flag.join(by_entity, conv, "full")


def training_examples(summaries: DataFrame) -> DataFrame:
    """Text and label of each summary's flags, nothing else; flags without either are left out."""
    rows = summaries.select(F.inline("risk_flags"))
    whole = (F.coalesce("evidence", F.lit("")) != "") & (F.coalesce("tactic", F.lit("")) != "")
    return rows.where(whole).select(F.col("evidence").alias("normalized_text"), F.col("tactic").alias("tactic_label"))


def summary(flags: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation: its flags in order, confidences to three places. Flags never expire."""
    item = F.struct("turn", "tactic", F.round("confidence", 3).alias("confidence"))
    return flags.groupBy(conv).agg(F.array_sort(F.collect_list(item)).alias("flags"))
