"""Keyed tables: merges touch their buckets alone, repeated batches change nothing, readers see whole states."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import keyed as K


def files(folder) -> dict[str, float]:
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{folder}/data") for f in fs if f.endswith(".parquet")}


def test_merges_touch_their_buckets_alone(spark, tmp_path):
    folder = str(tmp_path / "t")
    K.create(spark.range(500).selectExpr("id", "id * 2 AS v", "'x' AS w"), folder, ["id"], buckets=16)
    before = files(folder)
    new = spark.createDataFrame([(7, 1), (7, 3), (9000, 5)], "id long, v long")
    state = K.merge(new, folder)
    touched = {b for b, v in state.versions.items() if v == state.number}
    assert 1 <= len(touched) <= 2 and all(files(folder)[f] == t for f, t in before.items())
    rows = {r["id"]: (r["v"], r["w"]) for r in K.read(spark, folder).collect()}
    assert len(rows) == 501 and rows[7] == (3, "x") and rows[9000] == (5, None) and rows[8] == (16, "x")
    found = K.lookup(spark.createDataFrame([(7,), (8,), (77_777,)], "id long"), folder).collect()
    assert {r["id"] for r in found} == {7, 8}
    assert K.vacuum(spark, folder) >= 1 and {r["id"]: (r["v"], r["w"]) for r in K.read(spark, folder).collect()} == rows


def test_edges_by_two_keys_with_sums(spark, tmp_path):
    folder = str(tmp_path / "edges")
    K.create(spark.createDataFrame([(1, 2, 1, 10.0), (2, None, 1, 1.0)], "src int, dst int, n int, total double"), folder, ["src", "dst"], buckets=4)
    add = {"n": F.col("old.n") + F.col("new.n"), "total": F.col("old.total") + F.col("new.total")}
    new = spark.createDataFrame([(1, 2, 2, 5.0), (2, None, 1, 1.0), (2, 1, 1, 7.0)], "src int, dst int, n int, total double")
    K.merge(new, folder, add, batch=("load", 3))
    want = {(1, 2, 3, 15.0), (2, None, 2, 2.0), (2, 1, 1, 7.0)}
    assert {tuple(r) for r in K.read(spark, folder).collect()} == want
    for number in (3, 2):  # repeated or earlier batches
        K.merge(new, folder, add, batch=("load", number))
    assert {tuple(r) for r in K.read(spark, folder).collect()} == want
    K.merge(new, folder, {}, batch=("load", 4))
    K.merge(spark.createDataFrame([(9, 9, 1, 1.0)], new.schema), folder, insert=False)
    K.merge(new.limit(0), folder, batch=("load", 5))
    assert {tuple(r) for r in K.read(spark, folder).collect()} == want and K.state(spark, folder).batches == {"load": 5}


def test_a_merge_that_fails_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no table"):
        K.read(spark, folder)
    K.create(spark.range(10).selectExpr("id", "1 AS v"), folder, ["id"], buckets=2)
    bad = spark.range(5).selectExpr("id", "CAST(IF(id = 4, raise_error('broken'), '2') AS INT) AS v")
    with pytest.raises(Exception, match="broken"):
        K.merge(bad, folder)
    assert K.read(spark, folder).agg(F.sum("v"), F.count("*")).first() == (10, 10)
    K.merge(spark.range(5).selectExpr("id", "2 AS v"), folder)
    assert K.read(spark, folder).agg(F.sum("v")).first()[0] == 15
    with pytest.raises(ValueError, match="there is a table"):
        K.create(spark.range(3), folder, ["id"])


def test_streams_of_scores_are_merged_once(spark, tmp_path):
    folder = str(tmp_path / "scores")
    schema = "id long, score int, at int"
    K.create(spark.createDataFrame([(1, 100, 0)], schema), folder, ["id"], buckets=4)
    for n in range(3):
        spark.createDataFrame([(1, 200 + n, n), (n + 10, n, n)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):  # started again without new files
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            K.merge_stream(stream, folder, "scorer", str(tmp_path / "mark"), order="at").awaitTermination()
    assert {tuple(r) for r in K.read(spark, folder).collect()} == {(1, 202, 2), (10, 0, 0), (11, 1, 1), (12, 2, 2)}
