"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campwatch.llm._common import forget, saved


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node with a link; the root is the smallest node reachable.

    ``links`` has columns ``a`` and ``b``. Each round hangs the larger
    neighbours of a node, then its smaller ones, under its smallest neighbour,
    until nothing moves. Only counts and checksums reach the driver. No links
    give an empty result.
    """
    edges = saved(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        moved = saved(_small_star(_large_star(edges)), "edges")
        forget(edges)
        edges, before = moved, mark
        mark = _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return hung.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("u > v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()
