"""The graph network: gradients against differences, what it learns from neighbours, saved and trained further."""

from __future__ import annotations

import numpy as np

from tidemark.operators import sage as S
from tidemark.operators.evaluation import roc_auc


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = S.Sage.new(["a", "b"], 3)
    z, near, of, weight = rng.normal(size=(5, 4)), rng.normal(size=(7, 4)), np.array([0, 0, 1, 1, 1, 3, 4]), rng.uniform(0.5, 2, 7)
    y, share = np.array([1.0, 0, 1, 0, 1]), np.array([2.0, 1, 2, 1, 2])
    grads, loss = net.gradients(z, near, of, weight, y, share)
    p = net.probabilities(z, near, of, weight)
    assert abs(loss + (share * np.where(y == 1, np.log(p), np.log(1 - p))).sum()) < 1e-9
    for k, param in enumerate(net.params):
        for at in list(np.ndindex(param.shape))[:: max(1, param.size // 40)]:
            held = param[at]
            values = []
            for step in (1e-6, -1e-6):
                param[at] = held + step
                values.append(net.gradients(z, near, of, weight, y, share)[1])
            param[at] = held
            assert abs((values[0] - values[1]) / 2e-6 - grads[k][at]) < 1e-4, (k, at)


def graph(spark, n=600, seed=1):
    """A node is positive if most of its neighbours have a large first feature: its own features do not tell. Node 1 is a hub."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    src, dst = np.repeat(np.arange(n), 4), rng.integers(0, n, 4 * n)
    y = np.bincount(src, x[dst, 0], n) / 4 > 0.2
    y[1] = x[:, 0].mean() > 0.2
    edges = [(int(a), int(b), 1.0) for a, b in zip(src, dst, strict=True)] + [(1, b, 1.0) for b in range(n)]
    nodes = spark.createDataFrame([(k, *map(float, r), bool(t) if k % 10 else None) for k, (r, t) in enumerate(zip(x, y, strict=True))], "account_id long, a double, b double, c double, bad boolean")
    return nodes, spark.createDataFrame(list(set(edges)), "src long, dst long, weight double"), y


def test_it_learns_from_neighbours_and_goes_on(spark, tmp_path):
    nodes, edges, y = graph(spark)
    rows = S.training_rows(nodes, edges, ["a", "b", "c"], "bad")
    assert rows.count() == 540 and rows.selectExpr("max(size(near))").first()[0] == S.FAN
    net = S.train(S.Sage.new(["a", "b", "c"]), rows, epochs=25)
    truth = spark.createDataFrame([(k, bool(t)) for k, t in enumerate(y)], "account_id long, t boolean")

    def auc(own):
        return roc_auc(S.scored(own, nodes, edges).join(truth, "account_id"), "probability", "t").first()[0]

    S.save(net, str(tmp_path / "net"), spark)
    back = S.load(str(tmp_path / "net"), spark)
    assert back.steps == net.steps and auc(back) == auc(net) > 0.9
    assert S.more(back, nodes, edges, "bad", epochs=1).steps == net.steps + S.BATCHES


def test_edges_of_the_table(spark):
    nodes = spark.createDataFrame([(1, 1.0, True), (2, None, False), (3, 2.0, None), (None, 1.0, True)], "account_id long, a double, bad boolean")
    edges = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, weight double")
    net = S.fit(nodes, edges, ["a"], "bad", epochs=2)
    assert {r["account_id"] for r in S.scored(net, nodes, edges).collect()} == {1, 2, 3}
    assert all(np.isfinite(p).all() for p in net.params)
    none = S.fit(nodes.limit(0), edges, ["a"], "bad", epochs=2)
    assert S.scored(none, nodes.limit(0), edges).collect() == []
