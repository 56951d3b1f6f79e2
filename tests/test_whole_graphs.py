"""The graph queries over all customers and accounts, against plain versions."""

from __future__ import annotations

from collections import defaultdict

import pytest
from conftest import DATA

from tidemark.plans.registry import QUERIES
from tidemark.sources.adapter import Catalog

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def tables(spark):
    k = Catalog(spark, SF)
    return k.txn.select("sender_account_id", "receiver_account_id", "device_id").collect(), {r["id"]: r for r in k.account.collect()}


def test_device_pairs_of_all_customers(spark, tables):
    txn, account = tables
    users = defaultdict(set)
    for t in txn:
        if t["device_id"] is not None and t["sender_account_id"] in account:
            users[t["device_id"]].add(account[t["sender_account_id"]]["customer_id"])
    want = defaultdict(set)
    for device, of in users.items():
        for a in of:
            for b in of - {a}:
                want[a, b].add(device)
    found = {(r["customer_id"], r["other_id"]): r["devices"] for r in QUERIES["shared_device_network_all"](spark, SF).collect()}
    assert found == {pair: ",".join(map(str, sorted(devices))) for pair, devices in want.items()}
    assert max(a for a, _ in found) >= 100


def test_neighbours_of_all_accounts(spark, tables):
    txn, account = tables
    weight = defaultdict(int)
    for a, b in {(t["sender_account_id"], t["receiver_account_id"]) for t in txn}:
        if a in account and b in account and a != b:
            weight[a, b] += 1
            weight[b, a] += 1
    assert {(r["src"], r["dst"]): r["weight"] for r in QUERIES["induced_subgraph_all"](spark, SF).collect()} == weight
    total, n = defaultdict(float), defaultdict(int)
    for (a, b), w in weight.items():
        total[a] += account[b]["balance"] * w
        n[a] += w
    found = {r["account_id"]: r["nb_h"] for r in QUERIES["neighbor_mean_all"](spark, SF).collect()}
    assert set(found) == set(account) and {a % 3 for a in found} == {0, 1, 2}
    assert all(abs(found[a] - (total[a] / n[a] if n[a] else 0)) < 1e-5 for a in account)
