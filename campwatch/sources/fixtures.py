"""Fixed and generated inputs: the labelled corpus, demonstration incidents, synthetic messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campwatch.functions import taxonomy as T

# Labelled messages (text, is_manipulation, age_bracket, language, note).
CORPUS = (
    ("This is the IRS. Wire the money now or you'll be arrested. Do not tell your bank.", True, "65+", "en", ""),
    ("Only accept gift card payment, don't mention this to anyone, act now before it's too late.", True, "18-64", "en", ""),
    ("Guaranteed 40% return, no risk, act now to claim your spot, don't tell your family about this opportunity.", True, "18-64", "en", ""),
    ("I've never felt this way about anyone before. I need you to wire the money today, it's urgent, and please don't tell your family about us yet.", True, "65+", "en", ""),
    ("This is your bank's fraud department, we need you to buy a gift card immediately to secure your account.", True, "65+", "hi", ""),
    ("Hey, are we still on for lunch tomorrow?", False, "18-64", "en", ""),
    ("Take your time getting back to me, there's no rush at all.", False, "18-64", "en", ""),
    ("I would never send a gift card to someone I just met online.", False, "18-64", "en", ""),
    ("What if someone asked me to wire money? Would that be a scam?", False, "18-64", "en", ""),
    ("My mom is in the hospital, please call me back as soon as you can, it's urgent.", False, "65+", "en", ""),
    ("Please don't tell my parents I got a B on the exam, they'll be upset.", False, "13-17", "en", ""),
    ("I'm so glad we met. I'd love to tell you more about my situation soon.", True, "18-64", "en", "adversarial evasion example"),
)
EVASION = "adversarial evasion"


def corpus(spark: SparkSession, evasion: bool = False) -> DataFrame:
    """Labelled messages, numbered from 0; rows noted as evasion only on request."""
    rows = [(i, *row) for i, row in enumerate(CORPUS)]
    df = spark.createDataFrame(rows, "id long, text string, is_manipulation boolean, age_bracket string, language string, note string")
    return df if evasion else df.where(~F.contains("note", F.lit(EVASION)))


def demo_reports(spark: SparkSession, incidents: int = 5, start: float = 1_700_000_000.0) -> DataFrame:
    """Reports of a few incidents that all name the same phone, account and script: ``incident, ts, node``."""
    return reports_of(spark.range(incidents), start)


def reports_of(ids: DataFrame, start: float = 1_700_000_000.0) -> DataFrame:
    """One such incident for each ``id``; further columns stay."""
    named = F.array(*[F.lit(n) for n in ("phone_number:15550100", "payee_account:demo-payee", "script_hash:demo-script")])
    return ids.select(
        *[c for c in ids.columns if c != "id"],
        F.concat(F.lit("demo-"), F.col("id").cast("string")).alias("incident"),
        (F.lit(start) + F.col("id") * 60).alias("ts"),
        F.explode(named).alias("node"),
    )


def synthetic_messages(spark: SparkSession, n: int, seed: int = 1, share: float = 0.3) -> DataFrame:
    """``id, text``: 20 to 120 words by hash, of which ``share`` of the messages carry a cue."""
    return messages_of(spark.range(n), seed, share)


def messages_of(ids: DataFrame, seed: int = 1, share: float = 0.3) -> DataFrame:
    """One such message for each ``id``."""
    cues = F.array(*[F.lit(c) for t in T.SCORED for c in T.CUES[t]])
    letters = F.array(*[F.lit(w) for w in ("ba", "lo", "mi", "ru", "te", "sa", "ko", "ne")])

    def drawn(bound, *what):
        return F.pmod(F.xxhash64(F.lit(seed), "id", *what), F.lit(bound) if isinstance(bound, int) else bound)

    def word(i):
        return F.concat(*[F.element_at(letters, (drawn(8, i, F.lit(j)) + 1).cast("int")) for j in range(3)])

    words = F.transform(F.sequence(F.lit(1), (drawn(101, F.lit("n")) + 20).cast("int")), word)
    cue = F.element_at(cues, (drawn(F.size(cues), F.lit("cue")) + 1).cast("int"))
    body = F.array_join(words, " ")
    return ids.select(
        "id", F.when(drawn(1000, F.lit("has")) < int(share * 1000), F.concat(body, F.lit(" "), cue)).otherwise(body).alias("text")
    )
