"""Citations, their plain rendering, and explanations of flags."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from campwatch.functions import taxonomy as T

WHY = {
    "urgency_injection": "it rushes you so that you act before checking",
    "isolation_instruction": "it tells you to keep others out who could warn you",
    "authority_impersonation": "it poses as an institution to make a demand feel official",
    "remote_access_solicitation": "it asks for a one-time code or for control of your device",
    "payment_channel_funneling": "it steers you to a payment that cannot be taken back",
    "too_good_to_be_true": "it promises something implausibly good",
    "coercion_threat": "it threatens harm unless you comply",
}
TIPS = {
    "urgency_injection": "A genuine request can wait until you have verified it.",
    "isolation_instruction": "Talk to someone you trust before you pay.",
    "authority_impersonation": "Call the institution on a number you looked up yourself.",
    "remote_access_solicitation": "Never pass on a code or install remote-access software.",
    "payment_channel_funneling": "Nobody honest is paid in gift cards, wires or crypto only.",
    "too_good_to_be_true": "Guaranteed gains do not exist.",
    "coercion_threat": "Do not pay; keep the evidence and contact the police.",
}
NOTHING = "No strong manipulation pattern was found. That is not a guarantee that the message is safe."


def cite(kind: str, value: Column, locator: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), locator.alias("locator"))


def cite_span(span: Column, turn: Column) -> Column:
    return cite("transcript_span", span, F.concat(F.lit("turn="), turn.cast("string")))


def cite_permission(name: Column, package: Column) -> Column:
    return cite("permission_name", name, F.concat(F.lit("package="), package))


def cite_region(text: Column, region: Column) -> Column:
    return cite("ocr_region", text, F.concat(F.lit("region="), region))


def cite_link(a: Column, b: Column, reports: Column) -> Column:
    return cite("graph_link", F.concat(a, F.lit(" <-> "), b), F.concat(F.lit("corroborating_reports="), reports.cast("string")))


def render(citations: Column) -> Column:
    """One plain line per citation."""

    def line(c: Column) -> Column:
        kind, value = c["kind"], c["value"]
        quoted = F.concat(F.lit('"'), value, F.lit('"'))
        return (
            F.when(kind == "transcript_span", F.concat(F.lit("- Message said: "), quoted))
            .when(kind == "permission_name", F.concat(F.lit("- App permission: "), value))
            .when(kind == "ocr_region", F.concat(F.lit("- On screen ("), F.replace(c["locator"], F.lit("region="), F.lit("")), F.lit("): "), quoted))
            .when(kind == "acoustic_segment", F.concat(F.lit("- Call audio: "), value))
            .when(kind == "graph_link", F.concat(F.lit("- Matches a pattern reported by other users: "), value))
            .otherwise(F.concat(F.lit("- "), value))
        )

    return F.when(F.size(citations) > 0, F.array_join(F.transform(citations, line), "\n")).otherwise(
        "No specific evidence cited."
    )


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def explain_flag(tactic: Column, evidence: Column, rationale: Column | None = None) -> Column:
    """Label, reason (a model's if there is one) and quoted evidence of one flag."""
    why = F.try_element_at(_table(WHY), tactic)
    if rationale is not None:
        why = F.coalesce(F.nullif(F.trim(rationale), F.lit("")), why)
    return F.concat(F.try_element_at(_table(T.LABELS), tactic), F.lit(": "), why, F.lit(". Seen: "), evidence, F.lit("."))


DEFAULT_TIP = "Stop, and check with the person or company through a channel that is not in this message."


def explanation(flags: Column) -> Column:
    """All surfaced flags of a message in plain words, the most confident first.

    ``flags`` is an array of ``confidence, tactic, evidence, rationale`` (a
    model's reason, or null); equally confident flags go by tactic.
    """
    ordered = F.array_sort(
        flags,
        lambda x, y: F.when(x["confidence"] > y["confidence"], -1).when(x["confidence"] < y["confidence"], 1)
        .when(x["tactic"] < y["tactic"], -1).when(x["tactic"] > y["tactic"], 1).otherwise(0),
    )
    lines = F.transform(ordered, lambda f: F.concat(F.lit("- "), explain_flag(f["tactic"], f["evidence"], f["rationale"])))
    n = F.size(flags)
    intro = F.when(n == 1, "This message shows a pattern that scams use:").otherwise(
        F.concat(F.lit("This message shows "), n.cast("string"), F.lit(" patterns that scams use:"))
    )
    first = F.coalesce(tip(F.try_element_at(ordered, F.lit(1))["tactic"]), F.lit(DEFAULT_TIP))
    found = F.concat(intro, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nWhat to do: "), first)
    return F.when(F.coalesce(n, F.lit(0)) > 0, found).otherwise(F.lit(NOTHING + " " + DEFAULT_TIP))


def check_result(flags: Column, tier: Column) -> Column:
    """``kind, finding, evidence`` of a message: its surfaced flags in order, or no strong pattern.

    ``flags`` is an array of ``tactic, confidence, spans, rationale``.
    """
    names = _table(T.LABELS)

    def cited(f: Column) -> Column:
        label = F.concat(
            F.lit("Tier "), tier.cast("string"), F.lit(": "), F.try_element_at(names, f["tactic"]),
            F.lit(" (confidence "), F.format_number(f["confidence"], 2), F.lit(")"),
        )
        return F.struct(
            F.lit("transcript_span").alias("kind"), F.array_join(f["spans"], ", ").alias("quoted_text"),
            label.alias("source_label"), f["tactic"].alias("tactic_id"), f["rationale"].alias("model_rationale"),
        )

    found = F.coalesce(F.size(flags), F.lit(0)) > 0
    return F.struct(
        F.when(found, "flag").otherwise("no_strong_pattern").alias("kind"),
        F.try_element_at(names, F.try_element_at(flags, F.lit(1))["tactic"]).alias("finding"),
        F.transform(flags, cited).alias("evidence"),
    )


def tip(tactic: Column) -> Column:
    return F.try_element_at(_table(TIPS), tactic)
