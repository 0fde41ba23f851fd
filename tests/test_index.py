"""The stored nearest-neighbour index."""

import numpy as np
import pytest

from campwatch.operators import vector_index, vectors


def _table(spark, rows, name="vid", vec="vec"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} long, {vec} array<double>")


def _found(df):
    return {(r["qid"], r["rank"]): r["vid"] for r in df.collect()}


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 9)) * 2
    return [(i, centres[i % 12] + rng.normal(size=9) * 0.4) for i in range(1500)]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_index_finds_what_brute_force_finds(spark, cloud, metric, tmp_path):
    v = _table(spark, [*cloud, (9000, None), (9001, [0.0] * 9)])
    q = _table(spark, cloud[:40], "qid", "qvec")
    index = vector_index.build(v, f"file://{tmp_path}/index", metric)
    assert len(index.centroids) == vector_index.cells_for(1501 if metric == "l2" else 1500)
    truth = vectors.exact_top_k(q, v.where("vid != 9000"), 5, metric)
    found = vector_index.search(q, index, 5)
    assert vectors.recall(truth, found).first()["recall"] >= 0.95
    share = vector_index.shares(index, q, 5).first()
    assert share["compared_share"] < 0.03 and share["ranked_share"] < 0.75
    # With every cell and every vector it is the exact search.
    whole = vector_index.search(q, index, 5, probes=len(index.centroids), keep=400)
    assert _found(whole) == _found(truth)


def test_vectors_are_added_to_a_stored_index(spark, cloud, tmp_path):
    folder = f"file://{tmp_path}/index"
    vector_index.build(_table(spark, cloud[:1200]), folder)
    index = vector_index.add(_table(spark, cloud[1200:]), vector_index.load(spark, folder))
    assert index.size == 1500
    late = _table(spark, cloud[1200:1230], "qid", "qvec")
    found = vector_index.search(late, index, 1).collect()
    assert len(found) == 30 and all(r["qid"] == r["vid"] and r["distance"] == 0 for r in found)


def test_a_hot_cell_is_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CODES", 64)
    rows = [(i, [1.0, 1.0, 1.0]) for i in range(900)] + [(1000 + i, [float(i), 0.0, 9.0]) for i in range(20)]
    index = vector_index.build(_table(spark, rows).repartition(4), f"file://{tmp_path}/index", cells=6)
    blocks = spark.read.parquet(f"{index.folder}/codes").selectExpr("cell", "length(ids) div 8 AS n").collect()
    assert sum(r["n"] for r in blocks) == 920 and max(r["n"] for r in blocks) <= 64
    got = vector_index.search(_table(spark, [(7, [1.0, 1.0, 1.0])], "qid", "qvec"), index, 3).collect()
    assert [r["distance"] for r in got] == [0.0] * 3


def test_empty_index(spark, tmp_path):
    index = vector_index.build(_table(spark, []), f"file://{tmp_path}/index")
    assert vector_index.search(_table(spark, [(1, [1.0])], "qid", "qvec"), index, 3).collect() == []


def test_shares_fall_with_size():
    part = [vector_index.probes_for(n) / n for n in (90, 200, 450, 2000, 8192)]
    assert part == sorted(part, reverse=True) and part[-1] < 0.2
