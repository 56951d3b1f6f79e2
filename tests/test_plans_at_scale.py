"""Forms of plans that keep a busy key apart give what the plain ones give."""

from __future__ import annotations

import datetime
import statistics

from conftest import DATA

from tidemark.operators.context import SLICE, velocity
from tidemark.operators.monitoring import bucket_stats
from tidemark.plans.registry import QUERIES

WEEK = 7 * 86_400


def test_velocity_over_borders_of_slices(spark):
    border = 7 * SLICE // 1_000_000
    steps = [-WEEK - 1, -WEEK, -WEEK + 1, -86_400, -3600, -1, 0, 0, 1, 3599, 3600, 86_400, WEEK - 1, WEEK, WEEK + 1, 3 * WEEK, 4 * WEEK - 1, 4 * WEEK, 5 * WEEK]
    times = [border + s for s in steps] + [-5, 5]  # before 1970 too
    zero = datetime.datetime(1970, 1, 1)
    rows = [(n, 1 + n % 5 // 4, zero + datetime.timedelta(seconds=t), 9000.0 + n) for n, t in enumerate(times)] + [(90, 1, None, 1.0), (91, None, zero, 9500.0), (92, None, zero, 1.0)]
    got = {r["id"]: r for r in velocity(spark.createDataFrame(rows, "id long, sender_account_id long, ts timestamp_ntz, amount double")).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, sender, ts, _ in rows:
        if ts is None:
            continue
        before = lambda seconds: [r for r in rows if r[1] == sender and r[2] is not None and ts - datetime.timedelta(seconds=seconds) <= r[2] < ts]  # noqa: B023, E731
        day = before(86_400)
        want = (len(before(3600)), len(day), len(before(WEEK)), sum(r[3] for r in day), sum(r[3] for r in before(WEEK)), sum(9000 <= r[3] < 10_000 for r in day))
        assert tuple(got[i][c] for c in ("n_1h", "n_24h", "n_7d", "sum_24h", "sum_7d", "structuring_24h")) == want


def test_nearest_ranks_with_ties_and_nulls(spark):
    log = [(datetime.datetime(2024, 1, 1 + n % 3), (n * n) % 11 if n % 5 else None, "ALLOW", n % 4) for n in range(100)]
    log += [(None, 7, None, None), (datetime.datetime(2024, 2, 1), None, "DECLINE", None)]
    got = {r["bucket"]: r for r in bucket_stats(spark.createDataFrame(log, "ts timestamp_ntz, final_score int, outcome string, processing_time_ms int")).collect()}
    assert set(got) == {None, "2024-01-01", "2024-01-02", "2024-01-03", "2024-02-01"}
    for bucket, r in got.items():
        rows = [x for x in log if (x[0] and x[0].strftime("%Y-%m-%d")) == bucket]
        score, ms = (sorted(x[at] for x in rows if x[at] is not None) for at in (1, 3))
        rank = lambda v, share: v[int(len(v) * share)] if v else None
        assert (r["n"], r["p50"], r["p95"], r["p95_ms"]) == (len(rows), rank(score, 0.5), rank(score, 0.95), rank(ms, 0.95))


def test_trained_ensemble_mixes_three_scores(spark):
    rows = QUERIES["trained_ensemble"](spark, str(DATA / "sf0.001")).collect()
    assert len({r["id"] for r in rows}) == len(rows) == spark.read.parquet(str(DATA / "sf0.001" / "orders.parquet")).count()
    assert len({r["ml_score"] for r in rows}) > 20 and len({r["svm_score"] for r in rows}) > 20
    for r in rows:
        three = (r["bayesian_score"], r["ml_score"], r["svm_score"])
        mixed = 0.4 * three[0] + 0.4 * three[1] + 0.2 * three[2] if three[1] or three[2] else three[0]
        assert abs(r["final_score"] - mixed) <= 0.5 + 1e-9
        assert r["outcome"] == ("ALLOW" if r["final_score"] <= 399 else "CHALLENGE" if r["final_score"] <= 699 else "DECLINE")
        assert abs(r["agreement"] - (100 - statistics.pstdev(three) / 999 * 100)) <= 0.5 + 1e-9
