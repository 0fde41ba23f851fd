"""Hot incidents in blocks, and the stored incident view."""

import random

from pyspark.sql import functions as F

from campwatch.operators import incidents
from campwatch.streaming import view

SCHEMA = "incident string, ts double, node string"


def _links(df):
    return {(r["a"], r["b"]): (r["corroboration"], r["last_active"]) for r in df.collect()}


def _brute(rows):
    per = {}
    for incident, ts, node in rows:
        nodes, last = per.get(incident, (set(), 0.0))
        per[incident] = (nodes | {node}, max(last, ts))
    out = {}
    for nodes, ts in per.values():
        for a in nodes:
            for b in nodes:
                if a < b:
                    n, last = out.get((a, b), (0, 0.0))
                    out[a, b] = (n + 1, max(last, ts))
    return out


def _rows(rng, n):
    return [(f"i{rng.randrange(40)}", float(rng.randrange(1000)), f"n{rng.randrange(30):02d}") for _ in range(n)]


def test_split_incidents_give_the_same_pairs(spark):
    rng = random.Random(1)
    rows = _rows(rng, 400) + [("hot", float(i), f"h{i:03d}") for i in range(150)] + [("hot", 3.0, "n01")] * 20
    df = spark.createDataFrame(rows, SCHEMA)
    lists = incidents.in_blocks(df, 16)
    assert lists.where("incident = 'hot'").count() > 5
    got = incidents.pairs(lists).groupBy("a", "b").agg(F.count("*").alias("corroboration"), F.max("ts").alias("last_active"))
    assert _links(got) == _brute(rows) == _links(incidents.edges(df))


def test_a_hot_incident_is_spread_over_tasks(spark):
    df = spark.range(20_000).selectExpr("'hot' AS incident", "1.0D AS ts", "concat('n', id) AS node")
    met = incidents.pairs(incidents.in_blocks(df)).groupBy(F.spark_partition_id()).count().collect()
    spread = [r["count"] for r in met]
    assert sum(spread) == 20_000 * 19_999 // 2 and len(spread) > 1 and max(spread) < 0.6 * sum(spread)


def test_the_view_follows_batches(spark, tmp_path):
    rng, folder = random.Random(2), f"file://{tmp_path}/view"
    batches = [_rows(rng, 120) for _ in range(4)]
    batches[2] = []
    seen = []
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA)
        view.apply(df, folder, number)
        seen += rows
        assert _links(view.links(spark, folder)) == _brute(seen)
        view.apply(df, folder, number)
        assert _links(view.links(spark, folder)) == _brute(seen)
        if number == 1:
            view.compact(spark, folder, 1)
            view.apply(df, folder, number)
            assert _links(view.links(spark, folder)) == _brute(seen)
    view.compact(spark, folder, 3)
    assert _links(view.links(spark, folder)) == _brute(seen)


def test_a_batch_reads_and_writes_what_it_touches(spark, tmp_path):
    rng, folder = random.Random(3), f"file://{tmp_path}/view"
    view.apply(spark.createDataFrame(_rows(rng, 600), SCHEMA), folder, 0)
    view.apply(spark.createDataFrame([("new", 5.0, "a"), ("new", 6.0, "b")], SCHEMA), folder, 1)
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/links/batch=1").collect()] == [("a", "b", 1, 6.0)]
    # An earlier report of a known incident leaves the pairs of its old nodes alone.
    view.apply(spark.createDataFrame([("new", 1.0, "c")], SCHEMA), folder, 2)
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/links/batch=2").collect()} == {("a", "c", 1, 6.0), ("b", "c", 1, 6.0)}
    view.apply(spark.createDataFrame([("new", 9.0, "c")], SCHEMA), folder, 3)
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/links/batch=3").collect()} == {(x, y, 0, 9.0) for x, y in ("ab", "ac", "bc")}
