"""Faults that show only on large, skewed or odd tables."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from campwatch.functions import taxonomy as T
from campwatch.operators import cascade, graph, incidents, pair_sums, vector_index, vectors
from campwatch.plans import campaign, detection, intel
from campwatch.streaming import view


_ROWS = pa.schema([("slot", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("rose", pa.int64()), ("last_active", pa.float64())])
_BLOCKS = pa.schema([("slot", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("pairs", pa.binary())])


def test_scan_is_dealt_by_rows_not_by_splits(spark, tmp_path):
    """One row group cut into many splits is one task with rows; all tasks must get some."""
    spark.range(40_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        dealt = detection.spread(spark.read.parquet(str(tmp_path / "one")))
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) == 20 and max(sizes) <= 2_200 and sum(sizes) == 40_000


def test_union_pattern_is_all_cues(spark):
    cues = sorted({c for t in T.TACTICS for c in T.CUES[t]})
    rows = [(c,) for c in cues] + [(c[:-1],) for c in cues] + [("x" + c + "y",) for c in cues] + [(None,)]
    found = spark.createDataFrame(rows, "t string").select("t", cascade.any_cue(F.col("t")).alias("any")).collect()
    assert all(r["any"] == (None if r["t"] is None else any(c in r["t"] for c in cues)) for r in found)


def test_scan_is_not_repeated_below_the_shuffle(spark):
    """A filter by the hits, pushed below, would scan in the file's own tasks, and lower the text for every cue."""
    plan = detection.cue_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("RoundRobinPartitioning"):]
    assert "Contains(" not in below and plan.count("lower(") < 3


def test_a_round_of_a_ranking_is_a_small_plan(spark, monkeypatch):
    """Plans of several rounds, and tables broadcast in each, filled the driver."""
    plans = []
    settle = graph.settle

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settle(df)

    edges = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(0, 3)], "a long, b long")
    monkeypatch.setattr(graph, "settle", noted)
    graph.personalized_pagerank(edges, spark.createDataFrame([(0,)], "node long"), tolerance=1e-2).count()
    graph.eigenvector(edges, tolerance=1e-2).count()
    assert max(p.count("Join ") for p in plans) <= 3


def test_no_time_means_no_betweenness(spark, monkeypatch):
    monkeypatch.setattr(graph, "betweenness", None)
    line = spark.createDataFrame([(i, i + 1) for i in range(4)], "a long, b long")
    assert graph.chokepoints(line, 1, budget_s=-1.0).first()["method"] == "eigenvector_fallback"


def test_every_vector_is_compared_whatever_its_code(spark, tmp_path):
    """Many vectors with one code: those kept by code are not the nearest."""
    rows = [(i, [1000.0 * (i % 2), 1e-4 * ((i * 7919) % 3000)]) for i in range(3000)]
    v = spark.createDataFrame(rows, "vid long, vec array<float>")
    q = v.where("vid % 100 = 0").selectExpr("vid AS qid", "vec AS qvec")
    index = vector_index.build(v, str(tmp_path / "index"), cells=1)
    got = {tuple(r) for r in vector_index.search_all(q, index, 5).select("qid", "rank", "vid").collect()}
    assert got == {tuple(r) for r in vectors.exact_top_k(q, v, 5).select("qid", "rank", "vid").collect()}
    bounded = vector_index.search(q, index, 5, probes=1, keep=64).select("qid", "rank", "vid").collect()
    assert got != {tuple(r) for r in bounded}


def test_reports_broadcast_no_table_and_pairs_are_dealt_by_size(spark, monkeypatch):
    """Small files may hold large tables; every task held a copy of all orders."""
    monkeypatch.setattr(intel, "LINES", 500)
    links = intel.k_anonymous_edges(spark, "/root/testdata/sf0.001")
    plan = links._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "_orderkey" in line or "_partkey" in line]
    pieces = intel._pieces(spark, "/root/testdata/sf0.001")
    assert pieces >= 12 and f", {pieces}), REPARTITION_BY_NUM" in plan


def test_a_text_with_a_wallet_agrees_with_the_sql(spark, tmp_path):
    import duckdb

    rows = [(1, "call 415 555 0142 now"), (2, "pay 1BoatSLRHtKNngkdXEeobR76b53LETtpyT now"), (3, "Pay  1BoatSLRHtKNngkdXEeobR76b53LETtpyT now")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(base.execute(campaign.ORACLES["detected_incidents"]).fetchall())
    assert sorted(tuple(r) for r in campaign.detected_incidents(spark, str(tmp_path)).collect()) == want


def test_a_filter_by_the_verdict_does_not_repeat_the_gate(spark):
    """The gate was spelled out in the filter for every use of a confidence, with its searches."""
    plan = detection.flag_explanations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter (" in line]
    assert filters and not [line for line in filters if "Contains(" in line or "RLIKE" in line.upper()]
    assert max(map(len, filters)) < 2_000


def _exchanged_rows(spark) -> int:
    context = spark.sparkContext
    none, doubles = context._gateway.jvm.java.util.ArrayList(), context._gateway.new_array(context._gateway.jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(none, False, False, doubles, none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_the_view_exchanges_reports_and_not_pairs(spark):
    """Every pair was a row of several exchanges: 200,000 rows for these 6,000 lines."""
    before = _exchanged_rows(spark)
    found = intel.incremental_links(spark, "/root/testdata/sf0.001")
    assert found.count() > 0
    assert _exchanged_rows(spark) - before < 100_000


def test_packed_sums_are_the_sums(spark, monkeypatch):
    """Odd names and times, blocks of several chunks, and all slots."""
    rng = random.Random(5)
    names = ["", "a", "\0", "é", "z" * 300, "phone_number:1", *(f"n{i}" for i in range(20))]
    times = [None, float("nan"), float("inf"), float("-inf"), -2.5, -1.0, 0.0, 3.25, 8.64e8]
    rows = [(rng.choice(names), rng.choice(names), rng.randrange(3), rng.choice(times[:1] if i % 3 else times)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string, rose long, last_active double")
    want = df.groupBy("a", "b").agg(F.sum("rose").alias("rose"), F.max("last_active").alias("last_active"))
    key = lambda r: tuple(map(repr, r))
    for slots in (1, 7):
        assert sorted(map(key, pair_sums.summed(df, slots).collect())) == sorted(map(key, want.collect()))
    assert pair_sums.summed(df.where("false"), 3).count() == 0
    monkeypatch.setattr(pair_sums, "CHUNK", 250)
    batches = [pa.RecordBatch.from_pylist([{"slot": len(a) % 5, "a": a, "b": b, "rose": n, "last_active": t} for a, b, n, t in rows[i : i + 100]], _ROWS) for i in range(0, 3000, 100)]
    blocks = [x for b in pair_sums._packed(batches) for x in b.to_pylist()]
    assert len(blocks) > 12 and len({b["slot"] for b in blocks}) == len({len(a) % 5 for a, *_ in rows})
    got = [r for slot in {b["slot"] for b in blocks} for r in pair_sums._merged(pa.Table.from_pylist([b for b in blocks if b["slot"] == slot], _BLOCKS)).to_pylist()]
    assert sorted(key(r.values()) for r in got) == sorted(map(key, want.collect()))


def test_wedges_are_dealt_by_the_number_of_edges(spark, monkeypatch):
    """A task of a join of Spark's own grew with the table, by its share of the wedges."""
    monkeypatch.setattr(graph, "EDGES", 10)
    edges = spark.createDataFrame([(i, j) for i in range(12) for j in range(i + 1, 12)] + [(0, 12)], "a long, b long")
    found = graph.clustering(edges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan and plan.count(", 7), REPARTITION_BY_NUM") == 2
    got = {r["node"]: (r["degree"], r["triangles"]) for r in found.collect()}
    assert got == {0: (12, 55), 12: (1, 0)} | {i: (11, 55) for i in range(1, 12)}


def _hubs(spark, hubs=9, leaves=400):
    """Every hub linked to nearly every leaf, and to no hub: nearly bipartite."""
    return spark.createDataFrame([(h, 100 + i) for h in range(hubs) for i in range(leaves) if (i + h) % 7], "a long, b long").union(
        spark.createDataFrame([(0, 1)], "a long, b long")
    )


def _matrix(edges):
    pairs = [tuple(r) for r in edges.collect()]
    nodes = sorted({x for p in pairs for x in p})
    at, a = {x: i for i, x in enumerate(nodes)}, np.zeros((len(nodes), len(nodes)))
    for x, y in pairs:
        a[at[x], at[y]] = a[at[y], at[x]] = 1.0
    return nodes, a


def test_eigenvector_settles_on_a_nearly_bipartite_graph(spark):
    """Powers of the matrix swing between hubs and leaves; they took more than 200 rounds at 60 times sf0.1."""
    edges = _hubs(spark)
    nodes, a = _matrix(edges)
    want = dict(zip(nodes, np.abs(np.linalg.eigh(a)[1][:, -1])))
    got = {r["node"]: r["score"] for r in graph.eigenvector(edges, rounds=20).collect()}
    assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in nodes) < 1e-5
    ranked = graph.chokepoints(edges, 5, exact_up_to=0, budget_s=-1.0).collect()
    assert {r["method"] for r in ranked} == {"eigenvector_fallback"} and len(ranked) == 5
    two = spark.createDataFrame([(1, 2)], "a long, b long")
    assert abs(graph.eigenvector(two, rounds=1).first()["score"] - 0.5**0.5) < 1e-12


def test_pagerank_takes_few_rounds(spark):
    """Every round leaves something in the driver: steps of the walk took more than a hundred."""
    edges = _hubs(spark)
    nodes, a = _matrix(edges)
    home = np.array([float(x in (100, 101)) / 2 for x in nodes])
    score = home
    for _ in range(300):
        score = 0.15 * home + 0.85 * (a / a.sum(1, keepdims=True)).T @ score
    seeds = spark.createDataFrame([(100,), (101,)], "node long")
    got = {r["node"]: r["score"] for r in graph.personalized_pagerank(edges, seeds, rounds=16).collect()}
    assert max(abs(got[x] - s) for x, s in zip(nodes, score)) < 1e-7 and min(got.values()) >= 0


def test_betweenness_is_exact_at_any_size(spark, monkeypatch):
    """Above 300 nodes it was from sampled sources."""
    monkeypatch.setattr(graph, "VISITED", 50)
    ring = [(i, (i + 1) % 330) for i in range(330)]
    found = graph.chokepoints(spark.createDataFrame([*ring, (0, 1000), (1000, 1001), (0, 100), (5, 200)], "a long, b long"), 332).collect()
    assert {r["method"] for r in found} == {"betweenness_exact"} and len(found) == 332
    near = {}
    for a, b in [*ring, (0, 1000), (1000, 1001), (0, 100), (5, 200)]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order, dep = {s: 0}, {s: 1}, [s], dict.fromkeys(near, 0.0)
        for u in order:
            for v in near[u]:
                if v not in dist:
                    dist[v], paths[v] = dist[u] + 1, 0
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        for v in reversed(order[1:]):
            want[v] += dep[v]
            for u in near[v]:
                if dist[u] == dist[v] - 1:
                    dep[u] += paths[u] / paths[v] * (1 + dep[v])
    assert max(abs(r["score"] - want[r["node"]] / (331 * 330)) for r in found) < 1e-12
    nodes = sorted(near)
    first = np.cumsum([0, *(len(near[u]) for u in nodes)])
    other = np.array([nodes.index(v) for u in nodes for v in near[u]], np.int32)
    monkeypatch.setattr(graph, "VISITED", 2)  # several looks at one level
    got = graph._brandes(first, other, np.arange(len(nodes)), range(len(nodes)))
    assert max(abs(x - want[u]) for u, x in zip(nodes, got)) < 1e-6


def test_nodes_with_the_same_neighbours_are_one_source(spark):
    """Hubs and leaves: all leaves of a hub, and those of two, swap places without a change."""
    pairs = [(0, i) for i in range(10, 15)] + [(h, i) for h in (0, 1) for i in range(20, 24)] + [(1, 30), (30, 31), (0, 31)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(edges).collect()}
    nodes, a = _matrix(edges)
    n, dist, paths = len(nodes), np.full(a.shape, 99), np.eye(len(nodes))
    power = np.eye(n)
    for d in range(n):
        new = (power > 0) & (dist == 99)
        dist[new], paths[new] = d, power[new]
        power = power @ a
    for v, node in enumerate(nodes):
        through = sum(
            paths[s, v] * paths[v, t] / paths[s, t] for s in range(n) for t in range(n)
            if len({s, t, v}) == 3 and dist[s, v] + dist[v, t] == dist[s, t]
        )
        assert abs(got[node] - through / ((n - 1) * (n - 2))) < 1e-12


def test_lists_of_a_batch_are_made_once(spark, tmp_path, monkeypatch):
    """They were made three times, twice for split incidents, of which there are hardly any."""
    made = []
    pairs = incidents.pairs
    monkeypatch.setattr(incidents, "pairs", lambda *a, **k: made.append(k.get("split")) or pairs(*a, **k))
    small = spark.createDataFrame([(str(i // 4), f"n{i % 7}", float(i)) for i in range(60)], "incident string, node string, ts double")
    view.apply(small, str(tmp_path / "v"), 0)
    assert made == [False]
    plan = pairs(incidents.listed(small.selectExpr("incident", "node", "4L AS n", "ts")), split=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Join" not in plan
    large = spark.createDataFrame([("x", f"m{i}", 1.0) for i in range(300)] + [("0", "n1", 99.0)], "incident string, node string, ts double")
    for number in (1, 1):
        view.apply(large, str(tmp_path / "v"), number)
    assert made == [False, False, True, False, True]
    got = sorted(tuple(r) for r in view.links(spark, str(tmp_path / "v")).collect())
    every = small.union(large).groupBy("incident", "node").agg(F.max("ts").alias("ts"))
    want = sorted(tuple(r) for r in incidents.edges(every).collect())
    assert len(got) > 300 * 299 // 2 and [r[:3] for r in got] == [r[:3] for r in want] and got == want


def test_a_ranking_that_is_late_anyway_is_not_made(spark, monkeypatch):
    """All nodes were sorted, and dropped, before the fallback."""
    noted, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: noted.append(df.columns) or settle(df))
    line = spark.createDataFrame([(i, i + 1) for i in range(4)], "a long, b long")
    assert graph.chokepoints(line, 2, budget_s=-1.0).count() == 2
    assert noted.count(["node", "score"]) == 1
