"""Pairs are bounded closely before whole sets are shipped to each other."""

import random

import numpy as np

from campwatch.llm import near_join


def test_fine_vectors_bound_the_overlap_from_above():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m, both = rng.integers(1, 3000), rng.integers(1, 3000), rng.integers(0, 2000)
        shared = rng.integers(0, 1 << 64, both, np.uint64)
        x, y = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 64, k, np.uint64)])) for k in (n, m))
        fine = [np.frombuffer(near_join.fine_vector(s), "u1") for s in (x, y)]
        most, true = near_join.fine_bound(*fine), len(np.intersect1d(x, y))
        assert [int(f.sum()) for f in fine] == [len(x), len(y)] and true <= most <= min(len(x), len(y))
    full = near_join.fine_vector(np.arange(600, dtype=np.uint64))
    assert near_join.fine_bound(*[np.frombuffer(full, "u1")] * 2) is None


def test_sets_of_long_texts_that_share_half_are_not_shipped(spark, monkeypatch):
    """Of long texts the counts in 256 groups are all alike: every pair of them was verified in full."""
    rng, words = random.Random(5), [f"w{i}" for i in range(5000)]
    common = [rng.choice(words) for _ in range(4000)]
    rows = [(i, " ".join(common + [rng.choice(words) for _ in range(2400)])) for i in range(6)]
    rows.append((9, rows[0][1] + " and one more end"))
    seen = spark.sparkContext.accumulator(0)
    overlap = near_join._overlap

    def counted(num, den):
        check = overlap(num, den)

        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield from check(iter([batch]))

        return run

    monkeypatch.setattr(near_join, "_overlap", counted)
    found = near_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["row_id"]: r["component_id"] for r in found.collect()} == {**{i: i for i in range(6)}, 9: 0}
    assert seen.value == 1
