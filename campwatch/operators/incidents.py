"""The incident graph: indicators, corroborated links, decay and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campwatch.functions import text as X
from campwatch.operators import pair_sums

K_FLOOR = 5
#: Nodes of a list; an incident that has more is split.
BLOCK = 256
PRUNE_DAYS, PHONE_DAYS, DORMANT_DAYS = 90, 270, 90


def indicators(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per indicator of each text: phones, wallets, and always the script hash."""
    text = F.col(text_col)

    def of(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(
        of("phone_number", X.phones(text)),
        of("crypto_wallet", X.wallets(text)),
        of("script_hash", F.array(X.script_hash(text))),
    )
    return df.select(*keys, F.inline(found))


def detections(messages: DataFrame, incident: str, ts: str, text_col: str = "text") -> DataFrame:
    """Reports of detected messages: every indicator of one message belongs to one incident."""
    found = indicators(messages, [incident, ts], text_col)
    return found.select(
        F.col(incident).alias("incident"), F.col(ts).alias("ts"), F.concat_ws(":", "kind", "value").alias("node")
    ).distinct()


def recorded(known: DataFrame, node: Column) -> DataFrame:
    """Whether the graph has ever held a node, pruned or not: ``known`` is its history of reports."""
    return known.where(F.col("node") == node).select("node").distinct()


def were_recorded(known: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (one row a ``node``) with whether its history of reports ``known`` holds each."""
    held = known.select("node").distinct().withColumn("held", F.lit(True))
    return asked.join(held, "node", "left").withColumn("recorded", F.coalesce("held", F.lit(False))).drop("held")


def nodes(reports: DataFrame) -> DataFrame:
    """Per node: first and last report, number of incidents."""
    return reports.groupBy("node").agg(
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.countDistinct("incident").alias("incidents"),
    )


def in_blocks(reports: DataFrame, block: int = BLOCK) -> DataFrame:
    """Node lists of incidents: ``incident, ts, blocks, block, ns``.

    An incident of more than ``block`` reports is several lists in several tasks,
    by the hash of the node; ``ts`` is the incident's own.
    """
    large = reports.groupBy("incident").agg(F.count("*").alias("n"), F.max("ts").alias("latest")).where(F.col("n") > block)
    marked = reports.join(large, "incident", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    lists = marked.groupBy("incident", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")).agg(
        F.collect_set("node").alias("ns"), F.max("ts").alias("ts"), F.any_value("latest").alias("latest")
    )
    return lists.withColumn("ts", F.coalesce("latest", "ts")).drop("latest")


def listed(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """As ``in_blocks``, of distinct rows ``incident, node, n, ts``: ``n`` rows an incident, ``ts`` the incident's own."""
    marked = nodes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    return marked.groupBy("incident", "ts", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")).agg(
        F.collect_list("node").alias("ns")
    )


def pairs(lists: DataFrame, other: DataFrame | None = None, split: bool | None = None) -> DataFrame:
    """``incident, ts, a, b``: every pair of nodes of an incident once, ``a`` before ``b``.

    With ``other`` (lists of the same incidents, with other nodes) the pairs that
    have one node in each. Lists meet two by two, and each meeting of a split
    incident is dealt to a task of its own; nothing holds all pairs of one.
    ``split`` leaves only the pairs of split incidents, or only those of all others:
    the lists are made anew for each of the two, and most tables have no split one.
    """
    left = lists.select("incident", "ts", "blocks", F.col("block").alias("i"), F.col("ns").alias("ls"))
    if split is False:
        met, once = left.where("blocks = 1").select("incident", "ts", "i", F.col("i").alias("j"), "ls", F.col("ls").alias("rs")), F.col("l") < F.col("r")
        return _opened(met, once)
    if other is None:
        alone = left.where("blocks = 1").select("incident", "ts", "i", F.col("i").alias("j"), "ls", F.col("ls").alias("rs"))
        left, other = left.where("blocks > 1"), lists.where("blocks > 1")
        right = other.select("incident", F.col("block").alias("j"), F.col("ns").alias("rs"))
        met = left.join(right, "incident").where("i <= j").drop("blocks")
        once = (F.col("i") < F.col("j")) | (F.col("l") < F.col("r"))
    else:
        alone, once = None, F.lit(True)
        right = other.select("incident", F.col("block").alias("j"), F.col("ns").alias("rs"))
        met = left.drop("blocks").join(right, "incident")
    met = met.repartition("incident", "i", "j").select("incident", "ts", "i", "j", "ls", "rs")
    return _opened(met if alone is None or split else alone.unionByName(met), once)


def _opened(met: DataFrame, once: Column) -> DataFrame:
    opened = met.select("incident", "ts", "i", "j", "rs", F.explode("ls").alias("l")).select("incident", "ts", "i", "j", "l", F.explode("rs").alias("r"))
    return opened.where(once).select("incident", "ts", F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))


def edges(reports: DataFrame, pieces: int | None = None) -> DataFrame:
    """Pairs of nodes reported together: distinct incidents and last activity.

    With ``pieces`` the pairs are dealt to that many slots, packed, and counted
    slot by slot. A slot is counted at once, so their number has to grow with
    the reports.
    """
    found = pairs(in_blocks(reports)).select("a", "b", "ts")
    if pieces is None:
        return found.groupBy("a", "b").agg(F.count("*").alias("corroboration"), F.max("ts").alias("last_active"))
    ones = found.select("a", "b", F.lit(1).alias("rose"), F.col("ts").alias("last_active"))
    return pair_sums.summed(ones, pieces).withColumnRenamed("rose", "corroboration")


def exposable(links: DataFrame, k: int = K_FLOOR) -> DataFrame:
    """Links that at least ``k`` distinct incidents report; nothing below ever leaves."""
    return links.where(F.col("corroboration") >= k)


def endpoints(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def age_days(now: Column, then: Column) -> Column:
    return (now - then) / F.lit(86_400.0)


def live_risk(kind: Column, age: Column) -> Column:
    """Phones stop being a live risk after 270 days; other kinds persist."""
    return F.when(kind == "phone_number", age <= PHONE_DAYS).otherwise(F.lit(True))


def prunable(found: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """Nodes without any link that nobody has reported for 90 days."""
    lonely = found.join(endpoints(links), "node", "left_anti")
    return lonely.where(age_days(now, F.col("last_seen")) >= PRUNE_DAYS)


def demotable(found: DataFrame, links: DataFrame, now: Column, days: float = DORMANT_DAYS) -> DataFrame:
    """Dormant nodes none of whose neighbours is active."""
    dormant = age_days(now, F.col("last_seen")) >= days
    active = found.where(~dormant).select(F.col("node").alias("other"))
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    kept = both.join(active, "other", "left_semi").select("node").distinct()
    return found.where(dormant).join(kept, "node", "left_anti")


def tiered(links: DataFrame, cold: DataFrame) -> DataFrame:
    """Links with their tier: cold as soon as one end is demoted. None is dropped."""
    gone = cold.select("node")
    frozen = links.join(gone.withColumnRenamed("node", "a"), "a", "left_semi").union(
        links.join(gone.withColumnRenamed("node", "b"), "b", "left_semi").select(links.columns)
    )
    marks = frozen.select("a", "b").distinct().withColumn("cold", F.lit(True))
    return links.join(marks, ["a", "b"], "left").withColumn(
        "tier", F.when(F.coalesce("cold", F.lit(False)), "cold").otherwise("hot")
    ).drop("cold")
