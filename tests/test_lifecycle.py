"""Models are saved, loaded, trained again and compared in the shadow of another."""

from __future__ import annotations

import pytest

from tidemark.functions.risk import bounded
from tidemark.operators import evaluation as E
from tidemark.operators import lifecycle as L
from tidemark.operators import versions


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(900).selectExpr("id", "(id * 37 % 100) / 100.0D AS a", "(id * 91 % 50) / 50.0D AS b", "(id * 37 % 100) + (id % 7) > 80 AS bad")


def test_saved_models_score_as_fitted_ones(spark, rows, tmp_path):
    meta = L.train(rows, "id", ["a", "b"], "bad", f"{tmp_path}/v1", steps=60)
    assert meta["roc_auc"] > 0.95 and meta["n_samples"] == 900 and len(meta["training_scores"]) == E.split(rows, "id", "bad").where("is_test").count()
    model, again = L.load(f"{tmp_path}/v1", spark)
    assert again == meta
    fitted = L.fit(E.split(rows, "id", "bad").where("not is_test"), ["a", "b"], "bad", key="id", steps=60)
    assert sorted(L.scored(model, rows, "id").collect()) == sorted(L.scored(fitted, rows, "id").collect())
    out = L.shadow(rows, "id", model, L.fit(rows, ["b"], "bad", steps=5)).collect()
    assert len(out) == 900 and all(r["difference"] == r["shadow_score"] - r["score"] for r in out)
    assert {r["shadow_score"] for r in L.shadow(rows, "id", model, None).collect()} == {None}


def test_training_again_on_a_window(rows, tmp_path):
    few = rows.where("id < 100")
    assert L.retrain(few, "id", ["a", "b"], "bad", f"{tmp_path}/few", 0.9) == {"status": "skipped", "n_samples": 100, "roc_auc": None}
    assert L.retrain(few, "id", ["a", "b"], "bad", f"{tmp_path}/few", 0.5, force=True, steps=5)["status"] == "promoted"
    assert L.retrain(rows, "id", ["b"], "bad", f"{tmp_path}/worse", 0.99, steps=5)["status"] == "experimental"


def test_incremental_runs_go_on_from_the_baseline(spark, rows, tmp_path):
    at = rows.selectExpr("*", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id DIV 100 AS INT)) AS ts")
    old = at.where("ts < timestamp_ntz '2024-01-04 00:00:00'")
    assert L.incremental(at, "id", "bad", "ts", str(tmp_path))["status"] == "error"
    first = L.register_first(old, "id", ["a", "b"], "bad", "ts", str(tmp_path), rounds=6, depth=3)
    assert first["version_id"] == "v1" and first["n_samples"] == 300
    run = L.incremental(at, "id", "bad", "ts", str(tmp_path), rounds=4)
    assert (run["status"], run["version_id"], run["n_new"]) == ("promoted", "v2", 600)
    model, meta = L.load(f"{tmp_path}/v2", spark)
    assert len(model.trees) == 10 and meta["kind"] == "trees" and [t.feature.tolist() for t in model.trees[:6]] == [t.feature.tolist() for t in L.load(f"{tmp_path}/v1", spark)[0].trees]
    assert L.incremental(at, "id", "bad", "ts", str(tmp_path))["status"] == "skipped"  # nothing is newer than v2's last transaction
    table = {r["version_id"]: r for r in versions.load(spark, f"{tmp_path}/versions").collect()}
    assert (table["v1"]["status"], table["v2"]["status"], table["v2"]["training_type"]) == ("retired", "baseline", "incremental")
    assert table["v2"]["last_txn_ts"] > table["v1"]["last_txn_ts"]


def test_all_kinds_are_trained(spark, rows, tmp_path):
    out = L.train_all(rows, "id", ["a", "b"], "bad", str(tmp_path), trees={"rounds": 3, "depth": 2}, linear={"steps": 10})
    assert set(out) == {"trees", "linear"} and all(m["roc_auc"] > 0.8 and m["threshold"] is not None for m in out.values())
    assert L.retrain(rows, "id", ["a", "b"], "bad", f"{tmp_path}/next", 0.5, base=f"{tmp_path}/linear", epochs=1)["status"] == "promoted"


def test_a_fifth_of_each_label_is_held_out(spark):
    df = spark.range(10_003).selectExpr("id", "id % 97 = 0 AS y").unionByName(spark.createDataFrame([(20_000, None)], "id long, y boolean"))
    got = {(r["y"], r["is_test"]): r["count"] for r in E.split(df, "id", "y").groupBy("y", "is_test").count().collect()}
    bad = len(range(0, 10_003, 97))
    assert got[True, True] == round(0.2 * bad) and got[False, True] == round(0.2 * (10_003 - bad)) and sum(got.values()) == 10_004


def test_bounds():
    assert bounded("size", 5, 1, 10) == 5
    with pytest.raises(ValueError, match="size"):
        bounded("size", 0, 1, 10)
