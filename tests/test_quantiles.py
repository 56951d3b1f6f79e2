"""Exact order statistics against sorting, in groups above and below the size from which the sketch's bounds count."""

from __future__ import annotations

import numpy as np

from tidemark.operators import quantiles as Q


def test_ranks_in_large_and_small_groups(spark):
    rng = np.random.default_rng(1)
    groups = {"far": np.append(rng.normal(size=25_000), [1e12, -1e12]), "few": rng.integers(0, 5, 21_000).astype(float), "small": rng.normal(size=7), None: np.array([3.0, 1.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("far", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999}
    out = {r["g"]: r for r in Q.nearest_ranks(df, ["g"], "v", shares).collect()}
    assert set(out) == set(groups)
    for g, vs in groups.items():
        assert [out[g][n] for n in shares] == [np.sort(vs)[int(len(vs) * s)] for s in shares.values()] and out[g]["n"] == len(vs)


def test_quantile_between_values(spark):
    rng = np.random.default_rng(2)
    for vs in (rng.exponential(size=30_000) ** 5, rng.normal(size=4), np.ones(3)):
        df = spark.createDataFrame([(float(v),) for v in vs], "v double")
        for share in (0.0, 0.3, 0.95, 1.0):
            assert abs(Q.quantile(df, "v", share) - np.quantile(vs, share)) <= 1e-12 * abs(np.quantile(vs, share))
    assert Q.quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None
