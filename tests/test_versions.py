"""The life of model versions."""

from __future__ import annotations

import datetime

from tidemark.operators import versions as V


def row(spark, name, auc, n=1000):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(name, "candidate", at, n, 0.02, at, "full", auc, 0.5, None)], V.SCHEMA)


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "versions")
    table = V.load(spark, folder)
    assert table.count() == 0 and V.next_version_id(table) == "v1" and V.compare(table).count() == 0
    V.save(V.set_baseline(V.register(table, row(spark, "v1", 0.9)), "v1"), folder)
    table = V.load(spark, folder)
    assert V.next_version_id(table) == "v2"
    for name, auc in (("v2", 0.895), ("v3", 0.5), ("odd", None)):
        table = V.register(table, row(spark, name, auc, 1500))
    V.save(V.set_experimental(table, "v2"), folder)
    table = V.load(spark, folder)
    assert V.next_version_id(table) == "v4"
    found = {r["version_id"]: (r["status"], r["auc_delta"], r["n_samples_delta"], r["would_promote"]) for r in V.compare(table).collect()}
    assert found == {"v1": ("baseline", 0.0, 0, True), "v2": ("experimental", -0.005, 500, True), "v3": ("candidate", -0.4, 500, False), "odd": ("candidate", None, 500, False)}
    table = V.set_experimental(table, "v3")
    assert {r["version_id"]: r["status"] for r in table.collect()} == {"v1": "baseline", "v2": "retired", "v3": "experimental", "odd": "candidate"}
    table = V.retire(V.set_baseline(table, "v3", "better"), "odd")
    assert {r["version_id"]: (r["status"], r["promotion_reason"]) for r in table.collect()} == {"v1": ("retired", "manually promoted"), "v2": ("retired", None), "v3": ("baseline", "better"), "odd": ("retired", None)}
    assert V.register(table, row(spark, "v1", 0.7)).where("version_id = 'v1'").first()["roc_auc"] == 0.7
