"""Pairs that meet in many buckets of the n-gram join."""

from pyspark.sql import functions as F

from campwatch.llm import near_join


def test_a_pair_is_given_by_one_bucket(spark, monkeypatch):
    """Results against brute force. Too small to fail without owners; ``test_shared_buckets_give_a_pair_once`` does."""
    passage = [f"p{i}" for i in range(400)]
    rows = []
    for d in range(40):
        own = [f"d{d}w{i}" for i in range(25)]
        rows.append((d, " ".join(passage[: d * 9] + own + passage[d * 9 + 3 :])))
    rows += [(100 + d, " ".join(passage[d : d + 40] + [f"e{d}w{i}" for i in range(60)])) for d in range(40)]
    seen = []
    met = near_join._met

    def noted(*args, **kwargs):
        found = met(*args, **kwargs)
        seen.append((found.count(), found.distinct().count()))
        return found

    monkeypatch.setattr(near_join, "_met", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["row_id"]: r["component_id"] for r in near_join.jaccard_components(docs, k=4, num=70, den=100).collect()}
    assert len(seen) == 2 and all(raw <= 1.2 * distinct + 5 for raw, distinct in seen) and seen[0][0] > 0

    words = {d: t.split() for d, t in rows}
    sets = {d: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for d, w in words.items()}
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if root[a] != root[b] and 100 * both >= 70 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_owners_are_buckets_of_both(spark):
    """The owner of a pair is a bucket that both are in; the fullest ones are carried."""
    rows = [(s, 3 + s % 5, n) for s in range(60) for n in range(s % 4, 20, 1 + s % 3)]
    members = spark.createDataFrame(rows, "sig long, members long, nid long")
    nodes = spark.range(20).select(F.col("id").alias("nid"), F.lit(9).alias("n"), F.lit(b"").alias("cv"))
    for r in near_join._with_owners(nodes, members).collect():
        mine = {s: m for s, m, n in rows if n == r["nid"]}
        assert len(r["owners"]) == min(near_join.OWNERS, len(mine)) and set(r["owners"]) <= set(mine)
        assert min(mine[s] for s in r["owners"]) >= max([m for s, m in mine.items() if s not in r["owners"]], default=0)


def _given(owners):
    """Rows that twenty shared buckets, each in a task of its own, give for one pair."""
    import numpy as np
    import pyarrow as pa

    cv = near_join.count_vector(np.arange(50, dtype=np.uint64) << np.uint64(56))
    rows = 0
    for sig in range(20):
        columns = {"cell": [sig] * 2, "side": [2] * 2, "nid": [1, 2], "root": [1, 2], "n": [50] * 2, "cv": [cv] * 2,
                   "sig": [sig] * 2, "owners": pa.array([owners] * 2, pa.list_(pa.int64()))}
        rows += sum(b.num_rows for b in near_join._search(80, 100, False)(iter([pa.RecordBatch.from_pydict(columns)])))
    return rows


def test_shared_buckets_give_a_pair_once():
    assert _given(list(range(4, 20))) == 1 and _given([]) == 20
