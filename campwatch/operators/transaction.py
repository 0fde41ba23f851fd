"""Payment rules: novelty, value, and recent manipulation flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGH_VALUE, RECENT_S = 500.0, 7200.0


def last_flag(events: DataFrame, user: str, ts: str, is_flag: Column, order: list[str]) -> DataFrame:
    """Adds ``last_flag_ts``: the newest flag of the user at or before each event (as-of)."""
    w = Window.partitionBy(user).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("last_flag_ts", F.last(F.when(is_flag, F.col(ts)), ignorenulls=True).over(w))


def novelty(payments: DataFrame, user: str, payee: str, amount: str, ts: str, order: list[str]) -> DataFrame:
    """Adds the three factors and whether at least two of them meet.

    A payee is new with the user's first payment to it. Expects ``last_flag_ts``.
    """
    first = Window.partitionBy(user, payee).orderBy(ts, *order)
    out = payments.withColumn("is_novel", F.row_number().over(first) == 1)
    out = out.withColumn("is_high_value", F.col(amount) >= HIGH_VALUE)
    recent = F.col("last_flag_ts").isNotNull() & (F.col(ts) - F.col("last_flag_ts") <= RECENT_S)
    out = out.withColumn("recent_flag", F.coalesce(recent, F.lit(False)))
    count = sum((F.col(c).cast("int") for c in ("is_novel", "is_high_value", "recent_flag")), F.lit(0))
    return out.withColumn("compound_risk", count >= 2)


def explanation(amount: Column) -> Column:
    """Why a payment is warned about, from its factor columns."""
    dollars = F.concat(F.lit("the amount ($"), F.format_number(amount, 2), F.lit(") is above the $500 threshold"))
    parts = F.array_compact(
        F.array(
            F.when(F.col("is_novel"), "this is a new payee"),
            F.when(F.col("is_high_value"), dollars),
            F.when(F.col("recent_flag"), "a manipulation pattern was flagged in a recent conversation"),
        )
    )
    risky = F.concat(F.lit("Compound risk: "), F.array_join(parts, "; "), F.lit("."))
    calm = "No compound risk: individual factors present are common and harmless on their own."
    return F.when(F.col("compound_risk"), risky).otherwise(calm)


def warnings(payments: DataFrame, amount: str) -> DataFrame:
    """Warned payments with headline, explanation and the two possible actions."""
    return payments.where("compound_risk").select(
        "*",
        F.lit("This payment matches a pattern seen in scam cases -- take a moment before continuing.").alias("headline"),
        explanation(F.col(amount)).alias("explanation"),
        F.array(F.lit("verify_first"), F.lit("continue_anyway")).alias("actions"),
    )
