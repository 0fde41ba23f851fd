"""Hot and cold tiers of the link graph: observe, demote, rehydrate, look up.

The state is four tables, each a function of the one before: links move between
tiers, none is ever dropped, and a confirmed link stays confirmed. Every step
writes its tables to the checkpoint folder, so the next one starts from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campwatch.operators.graph import settle

DORMANT_S = 90 * 86_400.0
LINK = "a string, b string, confirmed boolean"


@dataclass(frozen=True)
class Tiers:
    """``seen`` (node, last_seen), ``nodes`` (the hot ones), ``hot`` and ``cold`` links (a < b)."""

    seen: DataFrame
    nodes: DataFrame
    hot: DataFrame
    cold: DataFrame


def empty(spark: SparkSession) -> Tiers:
    return Tiers(
        spark.createDataFrame([], "node string, last_seen double"), spark.createDataFrame([], "node string"),
        spark.createDataFrame([], LINK), spark.createDataFrame([], LINK),
    )


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _touching(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with an end in ``nodes``, each once."""
    one = links.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi")
    two = links.join(nodes.withColumnRenamed("node", "b"), "b", "left_semi")
    return one.select("a", "b", "confirmed").union(two.select("a", "b", "confirmed")).distinct()


def _merged(links: DataFrame) -> DataFrame:
    return links.groupBy("a", "b").agg(F.bool_or("confirmed").alias("confirmed"))


def _settled(*tables: DataFrame) -> Tiers:
    return Tiers(*map(settle, tables))


def observe(state: Tiers, batch: DataFrame) -> Tiers:
    """Add observations (``node_a, node_b, confirmed, ts``): their ends come back with all their cold links."""
    links = batch.where("node_a <> node_b").select(
        F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), "confirmed"
    )
    stamped = batch.select(F.explode(F.array("node_a", "node_b")).alias("node"), F.col("ts").alias("last_seen"))
    ends = stamped.select("node").distinct()
    back = settle(_touching(state.cold, ends))
    return _settled(
        state.seen.union(stamped).groupBy("node").agg(F.max("last_seen").alias("last_seen")),
        state.nodes.union(ends).union(_ends(back)).distinct(),
        _merged(state.hot.union(back).union(links.select("a", "b", "confirmed"))),
        state.cold.join(back.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "confirmed"),
    )


def dormant_nodes(state: Tiers, now: float, dormancy_s: float = DORMANT_S) -> DataFrame:
    """Hot nodes not seen for ``dormancy_s`` none of whose hot neighbours was seen since."""
    idle = F.lit(now) - F.col("last_seen") >= dormancy_s
    active = state.seen.where(~idle).select(F.col("node").alias("other"))
    both = state.hot.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        state.hot.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    kept = both.join(active, "other", "left_semi").select("node").distinct()
    return state.nodes.join(state.seen.where(idle), "node", "left_semi").join(kept, "node", "left_anti")


def demote(state: Tiers, now: float, dormancy_s: float = DORMANT_S) -> Tiers:
    """Dormant nodes leave the hot tier; their links go with them."""
    gone = settle(dormant_nodes(state, now, dormancy_s))
    moved = settle(_touching(state.hot, gone))
    return _settled(
        state.seen,
        state.nodes.join(gone, "node", "left_anti"),
        state.hot.join(moved.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "confirmed"),
        _merged(state.cold.union(moved)),
    )


def deep_lookup(state: Tiers) -> DataFrame:
    """Links of both tiers, each once; what the hot tier says of a link counts."""
    cold = state.cold.join(state.hot.select("a", "b"), ["a", "b"], "left_anti")
    return state.hot.withColumn("tier", F.lit("hot")).unionByName(cold.withColumn("tier", F.lit("cold")))


def confirmed_links(state: Tiers) -> DataFrame:
    """Links that either tier holds as confirmed."""
    return state.hot.union(state.cold).where("confirmed").select("a", "b").distinct()


def confirmed_exists(state: Tiers, a: str, b: str) -> bool:
    low, high = min(a, b), max(a, b)
    return not confirmed_links(state).where((F.col("a") == low) & (F.col("b") == high)).isEmpty()
