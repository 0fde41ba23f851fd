"""Tiered scoring of messages: cue scan, escalation, compounding, exclusivity.

One message is one row from text to flags; hits and candidates are arrays of
structs, so scoring needs no shuffle. Only session compounding does, once, by
conversation.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from campwatch.functions import taxonomy as T
from campwatch.functions import text as X

ESCALATE, TIER2 = 0.28, 0.55
SEPARATOR = "\x1f"
CEILING, FLOOR = 0.35, 0.40


def cue_hits(lowered: Column, edge: bool = False) -> Column:
    """Per tactic with a match: name and matched cues in listed order.

    The scan is written out cue by cue, so it runs as compiled code; no cue
    contains the separator.
    """
    joined = F.array(*[
        F.concat_ws(SEPARATOR, *[F.when(F.contains(lowered, F.lit(c)), c) for c in T.cues(t, edge)]) for t in T.TACTICS
    ])
    names = F.array(*[F.lit(t) for t in T.TACTICS])
    # A name bound in a lambda is computed once; a column used twice would scan every text again.
    named = F.transform(joined, lambda j, i: F.struct(F.element_at(names, i + 1).alias("tactic"), j.alias("joined")))
    return F.transform(
        F.filter(named, lambda h: h["joined"] != ""),
        lambda h: F.struct(h["tactic"].alias("tactic"), F.split(h["joined"], SEPARATOR).alias("spans")),
    )


@lru_cache(maxsize=2)
def _automaton(edge: bool):
    """Automaton of all cues; a cue stands for every place at which it is listed."""
    import ahocorasick

    machine, places = ahocorasick.Automaton(), {}
    for i, (_, cue) in enumerate(listed(edge)):
        places.setdefault(cue, []).append(i)
    for cue, at in places.items():
        machine.add_word(cue, tuple(at))
    machine.make_automaton()
    return machine


def listed(edge: bool = False) -> list[tuple[str, str]]:
    """All cues with their tactics, in listed order."""
    return [(t, c) for t in T.TACTICS for c in T.cues(t, edge)]


def _matches(edge: bool):
    @F.arrow_udf(ArrayType(IntegerType()))
    def scan_text(lowered: pa.Array) -> pa.Array:
        machine = _automaton(edge)
        return pa.array(
            [None if x is None else sorted({i for _, at in machine.iter(x) for i in at}) for x in lowered.to_pylist()],
            pa.list_(pa.int32()),
        )

    return scan_text


def automaton_hits(lowered: Column, edge: bool = False) -> Column:
    """The same as ``cue_hits`` in one pass over the text, for taxonomies of many cues."""
    every = listed(edge)
    names = F.array(*[F.lit(c) for _, c in every])
    tactics = F.array(*[F.lit(t) for t, _ in every])
    found = _matches(edge)(lowered)

    def of(tactic: str) -> Column:
        own = F.filter(found, lambda i: tactics[i] == tactic)
        return F.struct(F.lit(tactic).alias("tactic"), F.transform(own, lambda i: names[i]).alias("spans"))

    return F.filter(F.array(*[of(t) for t in T.TACTICS]), lambda h: F.size(h["spans"]) > 0)


def any_cue(lowered: Column) -> Column:
    """Whether one union pattern of all cues matches."""
    return F.rlike(lowered, F.lit(_union(frozenset(c for t in T.TACTICS for c in T.CUES[t]))))


def _union(cues: frozenset[str]) -> str:
    """A pattern of all cues that tries common beginnings once, by code point."""
    rest: dict[str, set[str]] = {}
    for cue in cues:
        rest.setdefault(cue[:1], set()).add(cue[1:])
    whole = rest.pop("", None) is not None
    parts = [r"\Q" + first + r"\E" + _union(frozenset(rest[first])) for first in sorted(rest)]
    if len(parts) < 2 and not whole:
        return "".join(parts)
    if not parts:
        return ""
    return "(?:" + "|".join(parts) + ")" + ("?" if whole else "")


def prescreened_hits(lowered: Column, edge: bool = False) -> Column:
    """The same as ``cue_hits``, behind the union pattern, for texts that rarely match."""
    none = F.filter(cue_hits(F.lit(""), edge), lambda h: F.lit(False))
    return F.when(any_cue(lowered), cue_hits(lowered, edge)).otherwise(none)


#: Ways to scan, all with the same result.
STRATEGIES = {"naive": cue_hits, "prescreen": prescreened_hits, "automaton": automaton_hits}


def _total(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda n, h: n + F.size(h["spans"]))


def tier0(hits: Column) -> Column:
    """Diversity before volume: 0.18 a tactic, 0.05 a hit."""
    return F.least(F.lit(1.0), F.lit(0.18) * F.size(hits) + F.lit(0.05) * _total(hits))


def _base(hit: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.22) * F.size(hit["spans"]))


def scan(df: DataFrame, text_col: str = "text", variant: str = "server", strategy: str = "naive") -> DataFrame:
    """Adds ``norm``, ``hits`` and ``tier0``; ``strategy`` is one of STRATEGIES."""
    edge = variant == "edge"
    norm = X.normalize_edge(F.col(text_col)) if edge else X.normalize(F.col(text_col))
    # A column of its own: within the scan every cue would lower the text again.
    lowered = df.withColumn("norm", norm).withColumn("__lowered", F.lower("norm"))
    out = lowered.withColumn("hits", STRATEGIES[strategy](F.col("__lowered"), edge)).drop("__lowered")
    scored = F.filter("hits", lambda h: h["tactic"] != T.CALMING)
    return out.withColumn("tier0", tier0(scored if edge else F.col("hits")))


def refine(df: DataFrame, prior: Column | None = None, variant: str = "server") -> DataFrame:
    """Adds ``candidates`` (tactic, spans, base) after boosts and exclusivity, and ``tier``.

    ``prior`` holds the tactics flagged earlier in the session, if any.
    """
    edge = variant == "edge"
    prior = F.array().cast("array<string>") if prior is None else prior
    scored = F.filter("hits", lambda h: h["tactic"] != T.CALMING)
    compound = F.size(scored) >= (2 if edge else 3)
    calm = F.filter("hits", lambda h: h["tactic"] == T.CALMING)
    calm_base = F.when(F.size(calm) > 0, _base(F.try_element_at(calm, F.lit(1)))).otherwise(0.0)

    def boosted(h: Column) -> Column:
        pays = h["tactic"] == T.PAYMENT
        seen = F.when(F.array_contains(prior, h["tactic"]), 0.15).otherwise(0.0)
        session = F.when(pays & (F.size(prior) > 0), 0.20).otherwise(0.0)
        turn = F.when(pays & compound, 0.20).when(compound, 0.10).otherwise(0.0)
        return F.struct(
            h["tactic"].alias("tactic"),
            h["spans"].alias("spans"),
            F.least(F.lit(1.0), _base(h) + (seen + session + turn)).alias("base"),
        )

    kept = F.filter(
        F.transform(scored, boosted),
        lambda c: ~((c["tactic"] == T.URGENCY) & (calm_base >= c["base"] * 0.7)),
    )
    escalates = (F.col("tier0") >= ESCALATE) & (F.size(scored) > 0)
    out = df.withColumn("candidates", F.when(escalates, kept).otherwise(F.filter(kept, lambda c: F.lit(False))))
    top = F.coalesce(F.array_max(F.transform("candidates", lambda c: c["base"])), F.lit(0.0))
    if edge:
        return out.withColumn("tier", F.lit(0))
    return out.withColumn("tier", F.when(~escalates, 0).when(top < TIER2, 1).otherwise(2))


def candidate_rows(df: DataFrame, keys: list[str], variant: str = "server") -> DataFrame:
    """The candidates of ``refine`` as rows, from ``scan``'s output, without session flags.

    Whatever concerns the whole message (how many tactics, whether calming words
    contradict urgency) is settled before hits become rows, so plans stay flat.
    ``keys, norm, tactic, spans, base, n_candidates``.
    """
    least = 2 if variant == "edge" else 3

    def hits_of(tactic: str) -> Column:
        return F.aggregate(
            "hits", F.lit(0), lambda n, h: n + F.when(h["tactic"] == tactic, F.size(h["spans"])).otherwise(0)
        )

    # A filter here would be pushed below the scan and repeat it; an empty array is not.
    whole = df.withColumn("hits", F.when(F.col("tier0") >= ESCALATE, F.col("hits"))).select(
        *keys, "norm", "hits", hits_of(T.CALMING).alias("calm"), hits_of(T.URGENCY).alias("urgent"),
        F.size("hits").alias("n"),
    )
    whole = whole.withColumn("scored", F.col("n") - F.when(F.col("calm") > 0, 1).otherwise(0))

    def base(count: Column, extra: Column) -> Column:
        return F.least(F.lit(1.0), F.least(F.lit(1.0), F.lit(0.22) * count) + extra)

    lift = F.when(F.col("scored") >= least, 0.10).otherwise(0.0)
    calm_base = F.least(F.lit(1.0), F.lit(0.22) * F.col("calm"))
    dropped = (F.col("urgent") > 0) & (calm_base >= base(F.col("urgent"), lift) * 0.7)
    whole = whole.withColumn("dropped", dropped).select(
        *keys, "norm", "scored", "dropped",
        (F.col("scored") - F.col("dropped").cast("int")).alias("n_candidates"), F.inline_outer("hits"),
    )
    gone = (F.col("tactic") == T.CALMING) | (F.col("dropped") & (F.col("tactic") == T.URGENCY))
    extra = F.when(F.col("scored") < least, 0.0).when(F.col("tactic") == T.PAYMENT, 0.20).otherwise(0.10)
    return whole.where(~gone).select(
        *keys, "norm", "tactic", "spans", base(F.size("spans"), extra).alias("base"), "n_candidates"
    )


def blend(df: DataFrame, scores: DataFrame, keys: list[str], missing_is_zero: bool = False) -> DataFrame:
    """Average candidates' bases with model confidences, where a model gave one.

    ``scores`` has ``keys``, ``tactic`` and ``confidence``. A model can only
    re-weight candidates, never add one. With ``missing_is_zero`` a tactic the
    model does not know counts as confidence 0 for rows it scored.
    """
    by_row = scores.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("tactic", "confidence"))).alias("__model")
    )

    def mixed(c: Column) -> Column:
        given = F.try_element_at("__model", c["tactic"])
        if missing_is_zero:
            given = F.when(F.col("__model").isNotNull(), F.coalesce(given, F.lit(0.0)))
        half = F.when(given.isNotNull(), F.least(F.lit(1.0), F.lit(0.5) * c["base"] + F.lit(0.5) * given))
        return F.struct(c["tactic"].alias("tactic"), c["spans"].alias("spans"), F.coalesce(half, c["base"]).alias("base"))

    return df.join(by_row, keys, "left").withColumn("candidates", F.transform("candidates", mixed)).drop("__model")


def session(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Candidates with what earlier turns of the conversation flagged.

    Flags of earlier turns change which candidates there are only through
    urgency, and the first turn that flags urgency does so unboosted. So one
    pass without boosts settles membership, a running set of it gives every
    turn its prior flags, and a second pass scores. Both windows share one
    shuffle.
    """
    if T.EXCLUDES != {T.URGENCY: (T.CALMING,)}:
        raise ValueError("session scoring relies on urgency being the only excluded tactic")
    earlier = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    first = refine(df)
    flagged = F.transform("candidates", lambda c: c["tactic"])
    urgent_before = F.coalesce(
        F.max(F.array_contains(flagged, T.URGENCY)).over(earlier), F.lit(False)
    )
    first = first.withColumn("__urgent", urgent_before)
    prior = F.when(F.col("__urgent"), F.array(F.lit(T.URGENCY))).otherwise(F.array().cast("array<string>"))
    second = refine(first, prior).withColumn("__flagged", F.transform("candidates", lambda c: c["tactic"]))
    before = F.array_distinct(F.flatten(F.collect_list("__flagged").over(earlier)))
    third = second.withColumn("prior", F.array_sort(before))
    return refine(third, F.col("prior")).drop("__urgent", "__flagged")
