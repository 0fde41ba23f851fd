"""Evaluation: confusion counts, slices, regressions, release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATENCY_MS, DRAIN = 800.0, 5.0
REGRESSION = 0.05


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, label: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """Counts and precision, recall, F1 (0 where undefined), per slice if given."""
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(label & predicted).alias("tp"),
        F.count_if(~label & predicted).alias("fp"),
        F.count_if(label & ~predicted).alias("fn"),
        F.count_if(~label & ~predicted).alias("tn"),
    )
    tp = F.col("tp")
    out = counts.withColumn("precision", _ratio(tp, tp + F.col("fp")))
    out = out.withColumn("recall", _ratio(tp, tp + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", _ratio(2 * p * r, p + r))


def confusion_by_each(df: DataFrame, label: Column, predicted: Column, slices: list[str]) -> DataFrame:
    """``confusion`` for every value of each slice column, in one pass: ``slice, value`` and the figures."""
    pairs = [F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices]
    rows = df.select(label.alias("__y"), predicted.alias("__p"), F.inline(F.array(*pairs)))
    return confusion(rows, F.col("__y"), F.col("__p"), ["slice", "value"])


def latency_summary(reports: DataFrame, device: str, latencies: Column) -> DataFrame:
    """Per device: measured messages, how many were too slow, their total and the slowest."""
    total = F.aggregate(latencies, F.lit(0.0), lambda s, x: s + x)
    return reports.select(
        device, F.size(latencies).alias("measured"), F.size(F.filter(latencies, lambda x: x > LATENCY_MS)).alias("over"),
        total.alias("total"), F.array_max(latencies).alias("slowest"),
    )


DEGRADED = "Reduced confidence: full analysis unavailable right now, verify independently."


def degraded_notice(total_ms: Column) -> Column:
    """What a user is told when a message took longer than the gate allows; else null."""
    return F.when(total_ms > LATENCY_MS, DEGRADED)


def stage_totals(timings: DataFrame, message: str, stage: str, ms: str) -> DataFrame:
    """Per message: total time, whether it exceeds the gate, the notice, and its slowest stage."""
    total = timings.groupBy(message).agg(F.sum(ms).alias("total_ms"), F.max_by(stage, F.struct(ms, stage)).alias("slowest_stage"))
    return total.withColumn("exceeds", F.col("total_ms") > LATENCY_MS).withColumn("notice", degraded_notice(F.col("total_ms")))


def regressions(baseline: DataFrame, candidate: DataFrame, by: str, limit: float = REGRESSION) -> DataFrame:
    """Slices whose recall fell by more than ``limit`` of the baseline's."""
    base = baseline.select(by, F.col("recall").alias("base_recall")).where("base_recall > 0")
    both = candidate.select(by, "recall").join(base, by)
    fall = (F.col("base_recall") - F.col("recall")) / F.col("base_recall")
    return both.withColumn("regression", fall).where(F.col("regression") > limit)


def release_gates(reports: DataFrame, device: str, drained: Column, hours: Column, latencies: Column) -> DataFrame:
    """One row per violated gate and device: battery drain by the hour, message latency."""
    rate = F.when(hours > 0, drained / hours)
    over = F.size(F.filter(latencies, lambda x: x > LATENCY_MS))
    battery = reports.where(rate > DRAIN).select(device, F.lit("battery_drain").alias("gate"), rate.alias("value"))
    slow = reports.where(over > 0).select(device, F.lit("latency").alias("gate"), over.cast("double").alias("value"))
    return battery.union(slow)
