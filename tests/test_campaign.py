"""Link tiers, paths, rankings, masks, stores and streams against brute force and fixed scenarios."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from campwatch.functions import evidence, model_output, prompts
from campwatch.functions import taxonomy as T
from campwatch.functions import text as X
from campwatch.operators import cascade, conversation, evaluation, federated, graph, grounding, incidents, ocr, tiers, vectors
from campwatch.sources import fixtures, store
from campwatch.streaming import live


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


RNG = random.Random(4)
PAIRS = sorted({(a, b) for a, b in ((RNG.randrange(14), RNG.randrange(14)) for _ in range(30)) if a < b})


def _neighbours(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def _all_shortest(near, s):
    """Distance and number of shortest paths from ``s``."""
    dist, count, front = {s: 0}, {s: 1}, [s]
    while front:
        new = {}
        for u in front:
            for v in near[u]:
                if v not in dist:
                    new[v] = new.get(v, 0) + count[u]
        for v, c in new.items():
            dist[v], count[v] = dist[front[0]] + 1, c
        front = list(new)
    return dist, count


def test_betweenness_against_all_paths(spark):
    near = _neighbours(PAIRS)
    paths = {s: _all_shortest(near, s) for s in near}
    n = len(near)
    want = dict.fromkeys(near, 0.0)
    for s, t in itertools.permutations(near, 2):
        for v in near:
            if v in (s, t) or t not in paths[s][0] or v not in paths[s][0]:
                continue
            if paths[s][0][v] + paths[v][0].get(t, math.inf) == paths[s][0][t]:
                want[v] += paths[s][1][v] * paths[v][1][t] / paths[s][1][t]
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(_edges(spark, PAIRS)).collect()}
    assert got == pytest.approx({v: x / ((n - 1) * (n - 2)) for v, x in want.items()})


def test_rankings_against_matrices(spark):
    near = _neighbours(PAIRS)
    nodes = sorted(near)
    a = np.array([[float(v in near[u]) for v in nodes] for u in nodes])
    seed = np.array([float(u in nodes[:2]) / 2 for u in nodes])
    score = seed
    for _ in range(300):
        score = 0.15 * seed + 0.85 * (a / a.sum(1, keepdims=True)).T @ score
    seeds = spark.createDataFrame([(nodes[0],), (nodes[1],), (999,)], "node long")
    got = {r["node"]: r["score"] for r in graph.personalized_pagerank(_edges(spark, PAIRS), seeds, tolerance=1e-4).collect()}
    assert [got[u] for u in nodes] == pytest.approx(score.tolist(), abs=1e-3)
    assert graph.personalized_pagerank(_edges(spark, PAIRS), seeds.where("node = 999")).count() == 0
    big = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = {r["node"]: r["score"] for r in graph.eigenvector(_edges(spark, PAIRS), tolerance=1e-5).collect()}
    assert [got[u] for u in nodes] == pytest.approx(big.tolist(), abs=1e-3)


def test_paths_are_whole_and_shortest(spark):
    near = _neighbours(PAIRS)
    start = min(near)
    dist, _ = _all_shortest(near, start)
    edges = _edges(spark, PAIRS)
    for goal in sorted(dist)[-3:]:
        path, _ = graph.find_path(edges, start, goal)
        assert path[0] == start and path[-1] == goal and len(path) - 1 == dist[goal]
        assert all(b in near[a] for a, b in zip(path, path[1:]))
    chain = _edges(spark, [(i, i + 1) for i in range(6)])
    assert graph.find_path(chain, 0, 3) == ([0, 1, 2, 3], "found")
    assert graph.find_path(chain, 2, 2) == ([2], "same node")
    assert graph.find_path(chain, 0, 5, 2)[0] is None and "77" in graph.find_path(chain, 0, 77)[1]


def test_chokepoints_say_how_they_were_found(spark):
    line = _edges(spark, [(i, i + 1) for i in range(8)])
    exact = graph.chokepoints(line, 2).collect()
    assert exact[0]["node"] == 4 and {r["method"] for r in exact} == {"betweenness_exact"}
    assert graph.chokepoints(line, 1, exact_up_to=0).first()["method"] == "betweenness_sampled"
    assert graph.chokepoints(line, 1, budget_s=-1.0).first()["method"] == "eigenvector_fallback"
    assert graph.chokepoints(line.where("a < 0"), 3).count() == 0


def test_sage_layers_against_matrices(spark):
    near = _neighbours(PAIRS)
    nodes = sorted(near)
    edges = _edges(spark, PAIRS)
    feats = {r["node"]: r["f"] for r in graph.node_features(edges).collect()}
    x = np.array([feats[u] for u in nodes])
    mean = np.array([[1 / len(near[u]) if v in near[u] else 0 for v in nodes] for u in nodes])
    (n1, s1, b1), (n2, s2, b2) = graph.sage_weights(16, 32, 32)
    h = np.maximum(mean @ x @ n1.T + x @ s1.T + b1, 0)
    want = mean @ h @ n2.T + h @ s2.T + b2
    got = {r["node"]: r["embedding"] for r in graph.sage_embeddings(edges).collect()}
    assert np.abs(np.array([got[u] for u in nodes]) - want).max() < 1e-9


def test_walks_and_closest_nodes(spark):
    edges = _edges(spark, PAIRS)
    one, two = ({r["node"]: r["embedding"] for r in graph.walk_embeddings(edges).collect()} for _ in range(2))
    assert one.keys() == two.keys() and {len(e) for e in one.values()} == {16}
    assert all(one[n] == pytest.approx(two[n]) for n in one)
    found = graph.closest(graph.walk_embeddings(edges), PAIRS[0][0], 3).collect()
    assert len(found) == 3 and PAIRS[0][0] not in {r["node"] for r in found}
    with pytest.raises(KeyError):
        graph.closest(graph.walk_embeddings(edges), 999, 3)


@pytest.mark.parametrize("n", [2, 3, 6, 90])
def test_masks_hide_every_client_and_cancel(spark, n):
    rows = [(i, [float(i), 1.0, -2.0, 0.5]) for i in range(n)]
    df = spark.createDataFrame(rows, "client long, v array<double>")
    sent = {r["client"]: r["v"] for r in federated.mask(df, "client", "v").collect()}
    assert len(sent) == n
    for i, v in rows:
        assert max(abs(a - b) for a, b in zip(sent[i], v, strict=True)) > 100
    for c in range(4):
        assert sum(v[c] for v in sent.values()) == pytest.approx(sum(v[c] for _, v in rows), abs=1e-8)
    if n == 2:
        with pytest.raises(ValueError, match="two clients"):
            federated.mask(df.limit(1), "client", "v")


def test_rounds_are_deferred_below_the_floor(spark):
    for n, success in ((49, False), (60, True)):
        rows = [(i, [1.0, 2.0], True) for i in range(n)] + [(999, [9.0, 9.0], False)]
        out = federated.secure_round(spark.createDataFrame(rows, "c long, v array<double>, ok boolean"), "v", "ok").first()
        assert (out["success"], out["cohort_size"]) == (success, n) and (out["aggregate"] == [1.0, 2.0]) == success
    rounds = spark.createDataFrame([(1, 4.0, 0.01, True), (2, 4.0, 0.01, False)], "round long, noise_multiplier double, sampling_rate double, success boolean")
    got = [r["epsilon"] for r in federated.epsilon_of_successes(rounds).orderBy("round").collect()]
    assert got[0] == got[1] > math.log(1e5) / 30.5


def _observed(spark, *rows):
    return spark.createDataFrame(rows, "node_a string, node_b string, confirmed boolean, ts double")


def test_tiers_move_links_and_never_drop_them(spark):
    state = tiers.observe(tiers.empty(spark), _observed(spark, ("a", "b", True, 0.0), ("c", "d", False, 0.0), ("d", "e", False, 95.0)))
    state = tiers.demote(state, 120.0, 100.0)
    # c is idle but its neighbour d is not, so it stays.
    found = {(r["a"], r["b"]): r["tier"] for r in tiers.deep_lookup(state).collect()}
    assert found == {("a", "b"): "cold", ("c", "d"): "hot", ("d", "e"): "hot"}
    assert tiers.confirmed_exists(state, "b", "a") and not tiers.confirmed_exists(state, "c", "d")
    state = tiers.observe(state, _observed(spark, ("a", "z", False, 130.0), ("b", "a", False, 130.0)))
    found = {(r["a"], r["b"]): (r["tier"], r["confirmed"]) for r in tiers.deep_lookup(state).collect()}
    assert found[("a", "b")] == ("hot", True) and found[("a", "z")] == ("hot", False) and len(found) == 4
    assert state.cold.count() == 0


def test_strategies_of_the_scan_agree(spark):
    rng = random.Random(2)
    cues = [c for _, c in cascade.listed()]
    texts = [" ".join(rng.choice([*rng.sample(cues, 3), "plain", "wire the money", "ot", "p"]) for _ in range(rng.randrange(9))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "id long, t string")
    for edge in (False, True):
        found = df.select("id", *[scan(F.col("t"), edge).alias(n) for n, scan in cascade.STRATEGIES.items()]).collect()
        by_hand = {}
        for t, c in cascade.listed(edge):
            for i, text in enumerate(texts):
                if c in text:
                    by_hand.setdefault(i, {}).setdefault(t, []).append(c)
        for r in found:
            want = [(t, by_hand.get(r["id"], {})[t]) for t in T.TACTICS if t in by_hand.get(r["id"], {})]
            if r["id"] <= len(texts):
                assert [(h["tactic"], h["spans"]) for h in r["naive"]] == want
                assert r["naive"] == r["prescreen"] == r["automaton"]


def test_labelled_corpus(spark):
    judged = grounding.gate(grounding.entail(cascade.refine(cascade.scan(fixtures.corpus(spark, evasion=True)))))
    plain = judged.where("note = ''")
    row = evaluation.confusion(plain, F.col("is_manipulation"), F.col("surfaced")).first()
    assert (plain.count(), row["precision"], row["recall"], row["f1"]) == (11, 1.0, 1.0, 1.0)
    assert evaluation.confusion(judged, F.col("is_manipulation"), F.col("surfaced")).first()["recall"] == pytest.approx(5 / 6)
    assert fixtures.corpus(spark).count() == 11
    slices = evaluation.confusion_by_each(plain, F.col("is_manipulation"), F.col("surfaced"), ["age_bracket", "language"]).collect()
    assert sorted((r["slice"], r["value"]) for r in slices) == [("age_bracket", "13-17"), ("age_bracket", "18-64"), ("age_bracket", "65+"), ("language", "en"), ("language", "hi")]


def test_gate_drops_urgency_that_calming_contradicts(spark):
    row = "array(named_struct('tactic', 'urgency_injection', 'confidence', 0.5D, 'survived', true), named_struct('tactic', 'calming_reassurance', 'confidence', {}, 'survived', true))"
    for calm, verdict in (("0.35D", "abstained_mutual_exclusion"), ("0.349D", "surfaced")):
        got = grounding.gate(spark.range(1).withColumn("results", F.expr(row.format(calm)))).first()
        assert got["results"][0]["verdict"] == verdict


def test_vector_index_rejects_bad_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 2.0])], "vid long, vec array<double>")
    with pytest.raises(ValueError, match="vector 2"):
        vectors.checked(df)
    with pytest.raises(ValueError, match="id 1"):
        vectors.checked(df.union(df.where("vid = 1")))
    q = spark.createDataFrame([(7, [0.0, 0.0]), (8, [0.0, 1.0])], "qid long, qvec array<double>")
    got = vectors.search(q, df, 2, "nothing known", "cosine").orderBy("rank").collect()
    assert [(r["qid"], r["vid"]) for r in got] == [(8, 3), (8, 1)]


def test_blocks_of_queries_and_vectors_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 5)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vid long, vec array<double>").repartition(3)
    q = df.where("vid < 10").selectExpr("vid AS qid", "vec AS qvec")
    got = {(r["qid"], r["rank"]): r["vid"] for r in vectors.exact_top_k(q, df, 4, exclude_self=True).collect()}
    for i in range(10):
        order = [j for j in np.argsort(((v - v[i]) ** 2).sum(1)) if j != i][:4]
        assert [got[i, r + 1] for r in range(4)] == order


def test_incident_stream_feeds_the_view(spark, tmp_path):
    rows = [(i, float(i), "call +1 415-555-0142 now, act now", 0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, ts double, text string, turn long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # A restart reads nothing twice.
        query = live.record_incidents(stream, "id", "ts", str(tmp_path / "reports"), str(tmp_path / "state"))
        query.processAllAvailable()
        query.stop()
    view = live.incident_view(spark, str(tmp_path / "reports")).collect()
    assert len(view) == 1 and view[0]["corroboration"] == 5
    flags = live.analyze(df, ["id"])
    assert flags.isStreaming is False and live.analyze(stream, ["id"]).isStreaming


def test_conversation_streams(spark, tmp_path):
    rows = [(1, i, "s" if i < 4 else "v", t, 1000 + 400 * i) for i, t in enumerate(["send", "me", "the", "money now", *["x"] * 12])]
    df = spark.createDataFrame(rows, "conv long, turn long, sender string, text string, ms long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = live.ring_stream(stream, "conv", "turn", "text").writeStream.format("memory").queryName("rings").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    ring = spark.table("rings").first()
    assert ring["turn_count"] == 16 and ring["window"] == ["x"] * 12


def test_tables_are_replaced_whole_or_not_at_all(spark, tmp_path):
    path = "file://" + str(tmp_path / "kv")
    store.upsert(spark, path, spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], "k string, v string, ts int"))
    store.upsert(spark, path, spark.createDataFrame([("a", "2", 2), ("b", "0", 0)], "k string, v string, ts int"))
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", "2"), ("b", "1")]
    with pytest.raises(ValueError, match="1 rows were written, 2 expected"):
        store.overwrite_checked(spark.createDataFrame([("a", "2", 2)], "k string, v string, ts int"), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(FileNotFoundError):
        store.required(spark, path + "-missing")


def test_explanations_and_prompts(spark):
    flags = "array(named_struct('confidence', 0.4D, 'tactic', 'urgency_injection', 'evidence', '\"act now\"', 'rationale', null), named_struct('confidence', 0.9D, 'tactic', 'coercion_threat', 'evidence', '\"pay or\"', 'rationale', 'it threatens'))"
    row = spark.range(1).select(
        evidence.explanation(F.expr(flags)).alias("two"), evidence.explanation(F.slice(F.expr(flags), 1, 1)).alias("one"),
        evidence.explanation(F.slice(F.expr(flags), 1, 0)).alias("none"),
        prompts.grounding_prompt(F.lit("x" * 7000), F.array(F.lit("a"), F.lit("b"))).alias("p"),
        X.prewarm(F.array(F.lit("motion_anomaly_changepoint"))).alias("w"),
        X.template_signal(F.lit(True), F.lit(False)).alias("s"),
        X.sms_reply(F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.lit(True)).alias("r"),
    ).first()
    lines = row["two"].split("\n")
    assert lines[0].startswith("This message shows 2 patterns") and "it threatens" in lines[1] and lines[-1].endswith(evidence.TIPS["coercion_threat"])
    assert row["one"].startswith("This message shows a pattern") and row["none"].startswith(evidence.NOTHING)
    assert prompts.TO_ASSESS + "a, b\n" in row["p"] and "[...]" in row["p"] and row["p"].endswith(prompts.END_HEAD + "\n\n")
    assert not row["w"] and row["s"]
    assert row["r"] == "CAUTION: This message matches known scam patterns (a, b). Do not send money or personal info. Note: this message claims to be from a registered sender but doesn't match their approved template. Reply STOP to opt out."


def test_model_outputs(spark):
    df = spark.createDataFrame([('[{"tactic_id": "coercion_threat", "confidence": "2", "rationale": "%s"}]' % ("r" * 300),), ('{"tactic_id": "coercion_threat", "confidence": 1}',), ("nothing",)], "j string")
    got = [r[0] for r in df.select(model_output.refinements(F.col("j"))).collect()]
    assert got[0][0]["confidence"] == 1.0 and len(got[0][0]["rationale"]) == 200 and got[1] is None and got[2] is None
    p = [math.exp(x) / (1 + math.exp(1)) for x in (0, 1)]
    joint = spark.range(1).select(model_output.joint_confidence(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0)), ("x", "none"))).first()[0]
    assert [(r["tactic"], r["confidence"]) for r in joint] == [("x", pytest.approx(p[1] / 2))]


def test_a_model_may_judge_candidates(spark):
    rows = cascade.refine(cascade.scan(spark.createDataFrame([(0, "please wire the money"), (1, "hello")], "id long, text string")))
    assert [r["entailment"] for r in grounding.entail_by_model(rows).collect()] == [None, None]
    label = T.LABELS[T.PAYMENT]
    judged = grounding.entail_by_model(rows, lambda pairs: [float(b == label) / 2 for _, b in pairs]).orderBy("id").collect()
    assert [r["entailment"] for r in judged] == [[0.5], []]


def test_small_rules(spark):
    assert spark.range(1).select(evaluation.degraded_notice(F.lit(800.1))).first()[0] == evaluation.DEGRADED
    boxes = spark.createDataFrame([(1, 0, "t", 0.9, -40.0, 10.0, 2.0, 2.0)], "screen_id long, seq int, text string, confidence double, x_pct double, y_pct double, w_pct double, h_pct double")
    assert ocr.regions(boxes).first()["region"] == "top-center"
    assert conversation.cited(F.array().cast("array<string>"), F.lit("s")) is not None
    links = incidents.exposable(incidents.edges(fixtures.demo_reports(spark)))
    assert links.count() == 3 and incidents.exposable(incidents.edges(fixtures.demo_reports(spark, 4))).count() == 0
    reports = incidents.detections(spark.createDataFrame([(1, 2.0, "call +1 415-555-0142")], "i long, t double, text string"), "i", "t")
    assert incidents.recorded(reports, F.lit("phone_number:14155550142")).count() == 1
