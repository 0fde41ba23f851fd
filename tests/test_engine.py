"""Rules, graphs, folds and federated statistics against closed forms."""

import math

from pyspark.sql import functions as F

from campwatch.operators import device, evaluation, federated, graph, incidents
from campwatch.streaming import folds


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def test_k_floor_hides_four_and_shows_five(spark):
    for n, shown in ((4, 0), (5, 1)):
        rows = [(i, 0.0, x) for i in range(n) for x in ("phone_number:1", "payee_account:2")]
        links = incidents.edges(spark.createDataFrame(rows, "incident long, ts double, node string"))
        assert incidents.exposable(links).count() == shown


def test_path_and_reach(spark):
    chain = _edges(spark, [(i, i + 1) for i in range(6)])
    assert graph.path_hops(chain, 0, 3)[0] == 3
    assert graph.path_hops(chain, 0, 6, 6)[0] == 6
    assert graph.path_hops(chain, 0, 6, 2)[0] is None
    assert graph.path_hops(chain, 0, 99)[0] is None
    assert graph.path_hops(chain, 2, 2)[0] == 0


def test_betweenness_of_a_path_is_highest_in_the_middle(spark):
    found = {r["node"]: r["betweenness"] for r in graph.betweenness(_edges(spark, [(i, i + 1) for i in range(4)])).collect()}
    assert max(found, key=found.get) == 2
    assert math.isclose(found[2], 4 / 6, rel_tol=1e-9)
    assert found[0] == 0


def test_triangle_clustering(spark):
    found = {r["node"]: r["clustering"] for r in graph.clustering(_edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3)])).collect()}
    assert found == {0: 1.0, 1: 1.0, 2: 1 / 3, 3: 0.0}


def test_bloom_bits(spark):
    row = spark.createDataFrame([("sig_abc123",)], "s string").select(device.bits(F.col("s"))).first()[0]
    assert row == [5457, 7724, 7568, 7303, 4173]


def test_folds(spark):
    xs = [10.1 if i % 2 == 0 else 9.9 for i in range(60)] + [15.0] * 5
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k long, n long, value double")
    out = folds.run_batch(df, folds.EWMA, "k", ["n"]).where("changepoint").select("n").collect()
    assert sorted(r[0] for r in out) == [60, 61, 62, 63, 64]
    times = [0, 1, 2, 3, 4, 5, 6, 60, 65, 66, 130, 131]
    df = spark.createDataFrame([("s", float(t)) for t in times], "k string, ts double")
    out = folds.run_batch(df, folds.TOKEN_BUCKET, "k", ["ts"]).orderBy("ts").collect()
    assert [int(r["allowed"]) for r in out] == [1, 1, 1, 1, 1, 0, 0, 0, 1, 0, 1, 0]
    heats = [(0.75, False), (0.90, False), (0.86, False), (0.84, False), (0.79, False), (0.90, True)]
    df = spark.createDataFrame([(1, i, *h) for i, h in enumerate(heats)], "k long, n long, heat double, fallback boolean")
    out = folds.run_batch(df, folds.THERMAL, "k", ["n"]).orderBy("n").collect()
    assert [r["level"] for r in out] == ["elevated", "severe", "severe", "severe", "elevated", "critical_compound"]


def test_stream_fold_agrees_with_batch(spark, tmp_path):
    df = spark.createDataFrame([("a", float(t)) for t in range(8)], "k string, ts double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = folds.run_stream(stream, folds.TOKEN_BUCKET, "k", "ts").writeStream.format("memory").queryName("bucket").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [r["allowed"] for r in spark.table("bucket").orderBy("ts").collect()]
    assert got == [True] * 5 + [False] * 3


def test_privacy_and_trimming(spark):
    rounds = spark.range(1, 101).select(F.col("id").alias("round"), F.lit(4.0).alias("noise_multiplier"), F.lit(0.01).alias("sampling_rate"))
    eps = {r["round"]: r["epsilon"] for r in federated.epsilon(rounds).collect()}
    assert round(eps[50], 6) == 0.863905 and round(eps[100], 6) == 1.230943
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(19)] + [(19, [1000.0, -1000.0, 1000.0])]
    out = federated.trimmed_mean(spark.createDataFrame(rows, "id long, v array<double>"), "v").orderBy("pos").collect()
    assert [r["mean"] for r in out] == [1.0, 2.0, 3.0]


def test_confusion_without_positives(spark):
    df = spark.createDataFrame([(False, False)], "y boolean, p boolean")
    row = evaluation.confusion(df, F.col("y"), F.col("p")).first()
    assert (row["precision"], row["recall"], row["f1"], row["tn"]) == (0.0, 0.0, 0.0, 1)
