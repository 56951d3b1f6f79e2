"""Generated tables have the sizes and patterns asked for, and the same rows each time."""

from __future__ import annotations

from collections import Counter

from tidemark.sources import synthetic as S
from tidemark.sources.adapter import FRAUD_TYPES


def test_patterns(spark):
    rows = S.transactions(spark, 1000, 300, 6).collect()
    assert len(rows) == 1000 and len({r["id"] for r in rows}) == 1000
    assert Counter(r["fraud_type"] for r in rows if r["is_fraud"]) == {f: 6 * n for f, n in zip(FRAUD_TYPES, S.LEGS, strict=True)}
    assert all(9000 <= r["amount"] <= 9999 for r in rows if r["fraud_type"] == "STRUCTURING")
    assert all((r["receiver_account_id"] is None) == (r["fraud_type"] == "HIGH_RISK_CORRIDOR") for r in rows)
    trips = sorted((r for r in rows if r["fraud_type"] == "ROUND_TRIP"), key=lambda r: r["ts"])
    pairs = Counter((r["sender_account_id"], r["receiver_account_id"]) for r in trips)
    assert all((b, a) in pairs for a, b in pairs)
    chain = [(r["sender_account_id"], r["receiver_account_id"]) for r in rows if r["fraud_type"] == "LAYERING"]
    assert sum(b in {a for a, _ in chain} for _, b in chain) >= 18  # each leg but the last goes on
    assert sorted(rows) == sorted(S.transactions(spark, 1000, 300, 6).repartition(3).collect())


def test_customers_and_accounts(spark):
    c = S.customers(spark, 2000, weights=[10.0] + [1.0] * 24)
    by = {r["country"]: r["count"] for r in c.groupBy("country").count().collect()}
    assert sum(by.values()) == 2000 and by["US"] == max(by.values()) and len(by) == 25
    a = S.accounts(c)
    assert a.select("id").distinct().count() == a.count() and 2000 < a.count() < 6000
    assert {r["count"] for r in a.groupBy("customer_id").count().select("count").distinct().collect()} == {1, 2, 3}
