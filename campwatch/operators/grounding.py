"""Grounding of candidates: specificity, negation, corroboration, verdicts, citations."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from campwatch.functions import taxonomy as T
from campwatch.functions import text as X
from campwatch.operators.cascade import CEILING, FLOOR

_WEIGHTS = {c: T.weight(c) for t in T.TACTICS for c in T.CUES[t]}


def specificity(spans: Column) -> Column:
    """Weight of the strongest cue."""
    table = F.create_map(*chain.from_iterable((F.lit(c), F.lit(w)) for c, w in _WEIGHTS.items()))
    return F.coalesce(F.array_max(F.transform(spans, lambda s: F.try_element_at(table, s))), F.lit(0.0))


def entail(df: DataFrame, round_to: int | None = 4) -> DataFrame:
    """Adds ``results``: per candidate its confidence, whether it survives, and why.

    The corroboration of other tactics is added only to results below the ceiling.
    Each step names what the next one reads, so no expression is repeated.
    """

    def rounded(x: Column) -> Column:
        return x if round_to is None else F.round(x, round_to)

    def judged(c: Column) -> Column:
        return F.struct(
            c["tactic"].alias("tactic"),
            c["spans"].alias("spans"),
            c["base"].alias("base"),
            F.when(X.has_negation(F.col("__low"), c["spans"]), 0.15).otherwise(1.0).alias("neg"),
            specificity(c["spans"]).alias("spec"),
        )

    def owned(c: Column) -> Column:
        own = F.least(F.lit(1.0), c["base"] * c["spec"] * F.col("__hyp") * c["neg"])
        return c.withField("own", rounded(own))

    def finished(c: Column) -> Column:
        lifted = (F.col("__lift") > 0) & (c["own"] < CEILING)
        more = rounded(F.least(F.lit(1.0), c["own"] + F.col("__lift")))
        return F.struct(
            c["tactic"].alias("tactic"),
            c["spans"].alias("spans"),
            c["neg"].alias("neg"),
            lifted.alias("lifted"),
            F.when(lifted, more).otherwise(c["own"]).alias("confidence"),
        )

    def explained(c: Column) -> Column:
        survived = c["confidence"] >= CEILING
        reason = (
            F.when(survived & c["lifted"], "corroborated")
            .when(survived, "entailed")
            .when(c["neg"] < 1, "negated")
            .when(F.col("__hyp") < 1, "hypothetical")
            .otherwise("fragmentary")
        )
        return F.struct(
            c["tactic"].alias("tactic"),
            c["spans"].alias("spans"),
            c["confidence"].alias("confidence"),
            survived.alias("survived"),
            reason.alias("reason"),
        )

    out = df.withColumns(
        {
            "__low": F.lower("norm"),
            "__hyp": F.when(X.is_hypothetical(F.col("norm")), 0.55).otherwise(1.0),
            "__lift": F.least(F.lit(0.30), F.lit(0.15) * F.greatest(F.lit(0), F.size("candidates") - 1)),
        }
    )
    results = F.col("candidates")
    for step in (judged, owned, finished, explained):
        results = F.transform(results, step)
    return out.withColumn("results", results).drop("__low", "__hyp", "__lift")


def gate(df: DataFrame) -> DataFrame:
    """Adds ``verdict`` to each result, and ``surfaced`` for the row."""
    calm = F.array_max(
        F.transform(
            F.filter("results", lambda r: r["survived"] & (r["tactic"] == T.CALMING)),
            lambda r: r["confidence"],
        )
    )

    def judged(r: Column) -> Column:
        contradicted = (r["tactic"] == T.URGENCY) & (F.coalesce(calm, F.lit(-1.0)) >= r["confidence"] * 0.7)
        verdict = (
            F.when(~r["survived"], "abstained_entailment_failed")
            .when(r["confidence"] < FLOOR, "abstained_low_confidence")
            .when(contradicted, "abstained_mutual_exclusion")
            .otherwise("surfaced")
        )
        return r.withField("verdict", verdict)

    out = df.withColumn("results", F.transform("results", judged))
    return out.withColumn("surfaced", F.exists("results", lambda r: r["verdict"] == "surfaced"))


def gate_edge(df: DataFrame) -> DataFrame:
    """The on-device gate: no floor above the ceiling."""
    out = entail(df, round_to=None)

    def judged(r: Column) -> Column:
        return r.withField("confidence", F.round(r["confidence"], 4)).withField(
            "verdict", F.when(r["survived"], "surfaced").otherwise("dropped")
        )

    out = out.withColumn("results", F.transform("results", judged))
    return out.withColumn("surfaced", F.exists("results", lambda r: r["verdict"] == "surfaced"))


def entail_by_model(df: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]] | None = None) -> DataFrame:
    """Adds ``entailment``: a model's probability for each candidate's tactic, null without a model.

    ``scorer`` takes (message, tactic label) pairs. The gate does not read it.
    """
    if scorer is None:
        return df.withColumn("entailment", F.lit(None).cast("array<double>"))

    @F.arrow_udf(ArrayType(DoubleType()))
    def judge(text: pa.Array, tactics: pa.Array) -> pa.Array:
        rows = list(zip(text.to_pylist(), tactics.to_pylist(), strict=True))
        found = iter(scorer([(t, T.LABELS[c]) for t, own in rows for c in own or ()]))
        return pa.array([None if own is None else [next(found) for _ in own] for _, own in rows], pa.list_(pa.float64()))

    named = df.withColumn("__tactics", F.transform("candidates", lambda c: c["tactic"]))
    return named.withColumn("entailment", judge("norm", "__tactics")).drop("__tactics")


def cite(kind: str, value: Column, locator: Column) -> Column:
    """A citation: what kind of evidence, its value, where it was found."""
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), locator.alias("locator"))


def explain(spans: Column) -> Column:
    """Quoted evidence, each phrase once, in order."""
    quoted = F.transform(F.array_distinct(spans), lambda s: F.concat(F.lit('"'), s, F.lit('"')))
    return F.array_join(quoted, ", ")


def flags(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per candidate with its confidence, verdict, reason and quoted evidence.

    The same gate as ``entail`` and ``gate`` on flat columns, for rows from
    ``cascade.candidate_rows`` (which never carry the calming tactic).
    """
    lift = F.least(F.lit(0.30), F.lit(0.15) * F.greatest(F.lit(0), F.col("n_candidates") - 1))
    rows = df.select(*keys, "norm", lift.alias("lift"), "tactic", "spans", "base")
    hyp = F.when(X.is_hypothetical(F.col("norm")), 0.55).otherwise(1.0)
    neg = F.when(X.has_negation(F.lower("norm"), F.col("spans")), 0.15).otherwise(1.0)
    rows = rows.select("*", hyp.alias("hyp"), neg.alias("neg"), specificity(F.col("spans")).alias("spec"))
    own = F.round(F.least(F.lit(1.0), F.col("base") * F.col("spec") * F.col("hyp") * F.col("neg")), 4)
    rows = rows.withColumn("own", own)
    rows = rows.withColumn("lifted", (F.col("lift") > 0) & (F.col("own") < CEILING))
    more = F.round(F.least(F.lit(1.0), F.col("own") + F.col("lift")), 4)
    rows = rows.withColumn("confidence", F.when(F.col("lifted"), more).otherwise(F.col("own")))
    verdict = (
        F.when(F.col("confidence") < CEILING, "abstained_entailment_failed")
        .when(F.col("confidence") < FLOOR, "abstained_low_confidence")
        .otherwise("surfaced")
    )
    reason = (
        F.when((F.col("confidence") >= CEILING) & F.col("lifted"), "corroborated")
        .when(F.col("confidence") >= CEILING, "entailed")
        .when(F.col("neg") < 1, "negated")
        .when(F.col("hyp") < 1, "hypothetical")
        .otherwise("fragmentary")
    )
    return rows.select(
        *keys, "tactic", "confidence", verdict.alias("verdict"), reason.alias("reason"),
        explain(F.col("spans")).alias("evidence"),
    )


def edge_flags(df: DataFrame, keys: list[str]) -> DataFrame:
    """Surfaced flags of the on-device gate, unrounded until the end, on flat columns."""
    lift = F.least(F.lit(0.30), F.lit(0.15) * F.greatest(F.lit(0), F.col("n_candidates") - 1))
    rows = df.select(*keys, "norm", lift.alias("lift"), "tactic", "spans", "base")
    hyp = F.when(X.is_hypothetical(F.col("norm")), 0.55).otherwise(1.0)
    neg = F.when(X.has_negation(F.col("norm"), F.col("spans")), 0.15).otherwise(1.0)
    rows = rows.select("*", hyp.alias("hyp"), neg.alias("neg"), specificity(F.col("spans")).alias("spec"))
    own = F.least(F.lit(1.0), F.col("base") * F.col("spec") * F.col("hyp") * F.col("neg"))
    rows = rows.withColumn("own", own)
    more = F.least(F.lit(1.0), F.col("own") + F.col("lift"))
    conf = F.when((F.col("lift") > 0) & (F.col("own") < CEILING), more).otherwise(F.col("own"))
    rows = rows.withColumn("confidence", conf).where(F.col("confidence") >= CEILING)
    return rows.select(*keys, "tactic", F.round("confidence", 4).alias("confidence"))
