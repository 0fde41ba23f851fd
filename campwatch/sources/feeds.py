"""Text sources: report feeds, payment links, screens, and the fixed evaluation corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds of patterns a report may carry.
KINDS = ("payee_account", "phone_number", "script_hash", "crypto_wallet")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Reports of a line feed ``kind,value,category,epoch,token``; malformed lines are dropped.

    No quoting: a line has exactly five comma-separated fields, each trimmed.
    """
    line = F.trim(column)
    parts = F.transform(F.split(line, ","), lambda p: F.trim(p))
    rows = lines.where((line != "") & ~F.startswith(line, F.lit("#"))).withColumn("__p", parts)
    rows = rows.where((F.size("__p") == 5) & F.col("__p")[0].isin(*KINDS) & F.col("__p")[3].rlike(NUMBER))
    names = ("pattern_kind", "pattern_value", "category", "reported_epoch", "device_attestation_token")
    return rows.select(
        *[c for c in lines.columns if c != column],
        *[(F.col("__p")[i].cast("double") if i == 3 else F.col("__p")[i]).alias(n) for i, n in enumerate(names)],
    )


def split_blob(blobs: DataFrame, column: str = "raw") -> DataFrame:
    """Lines of multi-line texts, as ``value``."""
    return blobs.select(F.explode(F.split(F.trim(column), r"\R")).alias("value"))


def parse_payment_link(url: Column) -> Column:
    """Payee, amount and name of a ``upi://pay`` link; null for any other URL."""
    fields = F.struct(
        F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("pa"))).alias("payee"),
        F.try_parse_url(url, F.lit("QUERY"), F.lit("am")).try_cast("double").alias("amount"),
        F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("pn"))).alias("name"),
    )
    right = (F.try_parse_url(url, F.lit("PROTOCOL")) == "upi") & (F.try_parse_url(url, F.lit("HOST")) == "pay")
    whole = fields["payee"].isNotNull() & fields["amount"].isNotNull()
    return F.when(right & whole, fields)


def actionable_text(nodes: DataFrame, packages: tuple[str, ...]) -> DataFrame:
    """Texts of nodes that can be acted on, in whitelisted apps only."""
    acts = F.col("clickable") | F.col("editable") | F.col("checkable")
    return nodes.where(F.col("package").isin(*packages) & acts & F.col("text").isNotNull())


def blocklist(exposed: DataFrame) -> DataFrame:
    """Phone numbers of exposed nodes, each once, ascending."""
    number = F.regexp_extract("node", r"^phone_number:(\d+)$", 1)
    return exposed.select(number.alias("digits")).where("digits <> ''").select(
        F.col("digits").cast("decimal(38,0)").alias("number")
    ).distinct().orderBy("number")


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
