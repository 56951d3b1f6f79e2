"""Customers who share devices: by groups with the same devices, as by single pairs; pairs are not shuffled."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph as G


@pytest.fixture(scope="module")
def uses(spark):
    """(sender_account_id, device_id): twins of more customers than a cell holds, customers with odd sets, one alone, nulls."""
    rng = random.Random(4)
    rows = [(n, d) for n in range(G.CELL * 2 + 100) for d in (1, 2)] + [(n, rng.randrange(3, 40)) for n in range(1000, 1200) for _ in range(rng.randrange(1, 6))]
    rows += [(n, 1) for n in range(1000, 1020)] + [(5000, 900), (1000, None), (9999, 1), (7000, 2)]
    txn = spark.createDataFrame(rows, "sender_account_id long, device_id long")
    owners = {n: n - n % 2 for n in range(6000)} | {7000: None}
    account = spark.createDataFrame(list(owners.items()), "id long, customer_id long")
    of = defaultdict(set)
    for a, d in rows:
        if d is not None and owners.get(a) is not None:
            of[d].add(owners[a])
    pairs = defaultdict(set)
    for d, who in of.items():
        for a in who:
            for b in who - {a}:
                pairs[a, b].add(d)
    return txn, account, {p: sorted(d) for p, d in pairs.items()}


def _above_lists(df) -> str:
    """The plan of what is done after pairs are listed."""
    return df._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0]


def test_closest(uses):
    txn, account, pairs = uses
    by = defaultdict(list)
    for (a, b), devices in pairs.items():
        by[a].append((-len(devices), b, devices))
    got = G.closest_by_device(txn, account)
    rows = got.collect()
    assert {(r["customer_id"], r["other_id"]): r["devices"] for r in rows} == {(a, b): d for a, x in by.items() for _, b, d in sorted(x)[:15]}
    assert len(rows) == sum(min(15, len(x)) for x in by.values())
    assert "array_intersect" in got._jdf.queryExecution().optimizedPlan().toString()


def test_all_pairs(uses):
    txn, account, pairs = uses
    got = G.shared_device_network(txn, account)
    rows = got.collect()
    assert len(rows) == len(pairs) and {(r["customer_id"], r["other_id"]): r["devices"] for r in rows} == pairs
    assert "Exchange" not in _above_lists(got) and "Aggregate" not in _above_lists(got)
    one = G.shared_device_network(txn, account, 1000).collect()
    assert len(one) > 0 and {(r["customer_id"], r["other_id"]): r["devices"] for r in one} == {p: d for p, d in pairs.items() if p[0] == 1000}


def test_connections(spark, uses):
    txn, account, pairs = uses
    paid = [(2 * n, n % 7) for n in range(300)] + [(4, 5), (4, 4), (1, None), (None, 1), (9999, 3), (7000, 3), (1002, 1000), (1002, 1001)]
    both = txn.withColumn("receiver_account_id", F.lit(None).cast("long")).unionByName(spark.createDataFrame([(s, r, None) for s, r in paid], "sender_account_id long, receiver_account_id long, device_id long"))
    owner = {r["id"]: r["customer_id"] for r in account.collect()}
    want = {(owner[s], owner[r], "COUNTERPARTY") for s, r in paid if owner.get(s) is not None and owner.get(r) is not None and owner[s] != owner[r]} | {(a, b, "SHARED_DEVICE") for a, b in pairs}
    got = G.network_connections(both, account)
    rows = got.collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert "Exchange" not in _above_lists(got)
