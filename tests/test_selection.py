"""Ranks found by sketches and counts: trimmed means and cohorts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from campwatch.operators import federated


def _means(df):
    return {r["pos"]: (r["mean"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 20_000])
@pytest.mark.parametrize("trim", [0.1, 0.0, 0.25])
def test_trimmed_means_are_exact(spark, n, trim):
    rng = np.random.default_rng(n)
    v = np.stack([rng.normal(size=n), np.round(rng.normal(size=n)), np.full(n, 3.0), np.exp(rng.normal(size=n) * 30)], 1)
    df = spark.createDataFrame([(x.tolist(),) for x in v], "v array<double>").repartition(5)
    got, k = _means(federated.trimmed_mean(df, "v", trim)), math.floor(n * trim)
    for pos in range(4):
        kept = np.sort(v[:, pos])[k : n - k]
        assert got[pos][1] == len(kept) and got[pos][0] == pytest.approx(kept.mean(), rel=1e-9, abs=1e-12)


def test_values_that_are_no_numbers_are_left_out(spark):
    rows = [([1.0, None],), ([float("nan"), 5.0],), ([3.0, 7.0],)]
    assert _means(federated.trimmed_mean(spark.createDataFrame(rows, "v array<double>"), "v")) == {0: (2.0, 2), 1: (6.0, 2)}


def test_work_of_a_trimmed_mean_follows_rows(spark):
    df = spark.range(200_000, numPartitions=8).select(F.array(F.rand(1), F.rand(2)).alias("v"))
    plan = federated.trimmed_mean(df, "v")._jdf.queryExecution().executedPlan().toString().splitlines()
    # Whatever is shuffled was aggregated where it lay.
    shuffled = [below for line, below in zip(plan, plan[1:], strict=False) if "Exchange hashpartitioning" in line]
    assert len(shuffled) >= 3 and all("Aggregate(" in below for below in shuffled)
    assert all(abs(m - 0.5) < 0.01 and k == 160_000 for m, k in _means(federated.trimmed_mean(df, "v")).values())


@pytest.mark.parametrize("n,share", [(0, 0.01), (5, 0.01), (400, 0.01), (5000, 0.01), (5000, 0.3), (5000, 1.0), (5000, 0.0)])
def test_cohorts(spark, n, share):
    rng = np.random.default_rng(n)
    order = rng.permutation(n * 3)[:n]
    rows = [(int(o), ("a", "b", None, "rare")[min(3, int(rng.integers(0, 200)) % 199 // 66)]) for o in order]
    df = spark.createDataFrame(rows, "seq long, stratum string")
    got = sorted(r["seq"] for r in federated.canary_cohort(df, "stratum", "seq", share).collect())
    per, picked = {}, []
    for seq, stratum in sorted(rows):
        per.setdefault(stratum, []).append(seq)
    for own in per.values():
        picked += own[:3]
    target = max(len(picked), math.floor(n * share))
    rest = [seq for seq, _ in sorted(rows) if seq not in set(picked)]
    assert got == sorted(picked + rest[: target - len(picked)])
