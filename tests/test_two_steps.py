"""Accounts within two steps, counted in blocks, are those of a plain search; paths are not listed."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tidemark.operators import graph as G
from tidemark.operators import reach


@pytest.fixture(scope="module")
def payments():
    """(id, sender, receiver): two hubs that most accounts pay, chains, repeats, self transfers, nulls."""
    rng = random.Random(7)
    rows = [(a, 5000 + (a % 3 == 0)) for a in range(1500)] + [(rng.randrange(1500), rng.randrange(1500)) for _ in range(600)] + [(n, n + 1) for n in range(6000, 6030)]
    rows += [(7, 7), (8000, 8000), (9000, 9001), (9000, 9001), (9001, 9000), (9100, 9100), (9100, 9101), (None, 3), (3, None)]
    return [(n, a, b) for n, (a, b) in enumerate(rows)]


def _plain(payments) -> dict:
    ends = defaultdict(set)
    for n, a, b in payments:
        if a is not None and b is not None:
            ends[a].add((n, b))
            ends[b].add((n, a))
    return {a: len({b for _, b in x} | {c for n, b in x for m, c in ends[b] if m != n}) for a, x in ends.items()}


@pytest.mark.parametrize(("own", "among", "lot"), [(reach.OWN, reach.AMONG, reach.LOT), (900, 700, 50), (10**6, 1200, 10**6)])
def test_connected_accounts(spark, payments, monkeypatch, own, among, lot):
    monkeypatch.setattr(reach, "LOT", lot)
    monkeypatch.setattr(G, "within_two_steps", lambda near: reach.within_two_steps(near, own, among))
    account = spark.createDataFrame([(n,) for n in (*range(1500), 5000, 5001, *range(6000, 6032), 8000, 9000, 9001, 9100, 9101)], "id long")
    found = G.connected_accounts(account, spark.createDataFrame(payments, "id long, sender_account_id long, receiver_account_id long"))
    want = _plain(payments)
    assert {r["account_id"]: r["connected_accounts"] for r in found.collect()} == {r["id"]: want.get(r["id"], 0) for r in account.collect()}
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
