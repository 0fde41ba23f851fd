"""Text functions as column expressions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from campwatch.functions import taxonomy as T

ZERO_WIDTH = "​‌‍﻿"
# Cyrillic look-alikes and what they stand for.
LOOKALIKE_FROM, LOOKALIKE_TO = "аеорсх", "aeopcx"
# Patterns of phone numbers and wallet addresses.
PHONE = r"\+?\d(?:[\d\-\s().]{6,})\d"
WALLET = r"\b(?:bc1[a-z0-9]{20,}|0x[a-fA-F0-9]{40}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pc.utf8_normalize(text, form="NFKC")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize(text: Column) -> Column:
    """NFKC, zero-width characters out, look-alikes folded, white space collapsed.

    Plain ASCII reaches Python as null, so only other texts pay for the fold.
    """
    ascii_only = F.length(text) == F.octet_length(text)
    folded = F.coalesce(_nfkc(F.when(~ascii_only, text)), text)
    cleaned = F.translate(F.translate(folded, ZERO_WIDTH, ""), LOOKALIKE_FROM, LOOKALIKE_TO)
    return collapse(cleaned)


def normalize_edge(text: Column) -> Column:
    return collapse(F.lower(text))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def script_hash(text: Column) -> Column:
    """Identity of a message script: case and white space do not count."""
    return F.substring(F.sha2(F.lower(collapse(text)), 256), 1, 32)


def phones(text: Column) -> Column:
    digits = F.transform(
        F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)),
        lambda m: F.regexp_replace(m, "[^0-9]", ""),
    )
    return F.array_distinct(F.filter(digits, lambda d: F.length(d) >= 8))


def wallets(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WALLET), F.lit(0)))


def is_hypothetical(text: Column) -> Column:
    trimmed = F.trim(text)
    opening = F.lower(trimmed)
    starts = F.lit(False)
    for h in T.HYPOTHETICALS:
        starts = starts | F.startswith(opening, F.lit(h))
    return F.endswith(trimmed, F.lit("?")) | starts


def has_negation(lowered: Column, spans: Column) -> Column:
    """A negation within the six words before a word that begins like a span's first word.

    A window is part of the text, so texts without any negation are settled
    before the nested search.
    """

    def any_negation(part: Column) -> Column:
        found = F.lit(False)
        for n in T.NEGATIONS:
            found = found | F.contains(part, F.lit(n))
        return found

    w = words(lowered)
    stems = F.array_distinct(
        F.transform(spans, lambda s: F.substring(F.substring_index(s, " ", 1), 1, 4))
    )
    positions = F.when(F.size(w) > 1, F.sequence(F.lit(2), F.size(w))).otherwise(F.array())
    nearby = F.exists(
        positions,
        lambda i: F.exists(stems, lambda s: F.startswith(F.element_at(w, i), s))
        & any_negation(
            F.array_join(
                F.slice(w, F.greatest(F.lit(1), i - 6), F.least(F.lit(6), i - 1)), " "
            )
        ),
    )
    return F.when(any_negation(lowered), nearby).otherwise(F.lit(False))


def fit_prompt(text: Column, limit: int = 6000, head: int = 4200, tail: int = 1800) -> Column:
    """Keep the beginning and the end of a text that is too long for a prompt."""
    cut = F.concat(F.left(text, F.lit(head)), F.lit("\n[...]\n"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > limit, cut).otherwise(text)


# Message filter cues.
JUNK_STRONG = (
    "gift card", "wire transfer", "wire money", "only accept", "buy a gift card",
    "send the code", "western union",
)
JUNK_MODERATE = (
    "act now", "urgent", "don't tell", "do not tell", "guaranteed return", "you've won",
    "risk-free",
)


# Replies over the message channel.
CAUTION = "CAUTION: This message matches known scam patterns ({}). Do not send money or personal info.{} Reply STOP to opt out."
NO_PATTERN = "No strong scam pattern detected -- but if you're unsure, don't send money or personal info.{} Reply STOP to opt out."
TEMPLATE_NOTE = " Note: this message claims to be from a registered sender but doesn't match their approved template."


def template_signal(registered: Column, matched: Column) -> Column:
    """Only a registered sender that leaves its own template tells anything."""
    return F.coalesce(registered & ~matched, F.lit(False))


def sms_reply(tactics: Column, deviates: Column) -> Column:
    """Reply to a message, from its surfaced tactics and whether its sender left the template."""
    note = F.when(deviates, TEMPLATE_NOTE).otherwise("")
    names = F.array_join(F.array_sort(F.array_distinct(tactics)), ", ")
    one, two = (t.split("{}") for t in (CAUTION, NO_PATTERN))
    found = F.concat(F.lit(one[0]), names, F.lit(one[1]), note, F.lit(one[2]))
    return F.when(F.size(tactics) > 0, found).otherwise(F.concat(F.lit(two[0]), note, F.lit(two[1])))


def prewarm(reasons: Column) -> Column:
    """Whether any wake reason is one for loading the model ahead."""
    return F.arrays_overlap(reasons, F.array(F.lit("payment_app_foreground"), F.lit("flagged_incoming_call")))


def within_caps(text: Column, limit: int = 8000) -> Column:
    """Whether a request's text is short enough to be taken (8000 to analyse, 4000 to explain)."""
    return F.length(text) <= limit


def sms_junk(text: Column) -> Column:
    low = F.lower(text)

    def hits(cues: tuple[str, ...]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cues)), lambda c: F.contains(low, c)))

    return (hits(JUNK_STRONG) >= 1) | (hits(JUNK_MODERATE) >= 2)
