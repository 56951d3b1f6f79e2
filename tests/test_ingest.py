"""Chained ingest over arriving files, and labels joined as streams."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import ingest as I
from tidemark.streaming.jobs import csv_stream

HEADER = "reference,sender_account_id,receiver_account_id,amount,currency,transaction_type,channel,timestamp,description,is_fraud,fraud_type\n"


@pytest.fixture(scope="module", autouse=True)
def states(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEADER + "".join(f"{r},A,B,10,USD,WIRE,ONLINE,{t},x,false,\n" for r, t in rows))


def test_three_runs_give_each_row_once(spark, tmp_path):
    arrive, folder = tmp_path / "in", str(tmp_path / "out")
    run = lambda: I.ingest_run(csv_stream(spark, str(arrive), "2024-01-01 00:00:00"), folder)
    put(arrive, "a.csv", [("r1", "2024-03-01T10:00:00"), ("r2", "2024-03-01T12:00:00"), ("r1", "2024-03-01T10:00:00")])
    first = run()
    assert (first["n_read"], first["n_new"], first["n_late"], first["n_repeated"], first["since"]) == (3, 2, 0, 1, None)
    put(arrive, "b.csv", [("r2", "2024-03-01T12:00:00"), ("r3", "2024-03-01T11:00:00"), ("r4", "2024-03-02T09:00:00")])
    second = run()
    assert (second["n_read"], second["n_new"], second["n_late"], second["n_repeated"]) == (3, 2, 1, 1) and second["since"] == first["last"] == datetime.datetime(2024, 3, 1, 12)
    third = run()  # nothing has arrived
    assert (third["run"], third["n_read"], third["n_new"]) == (3, 0, 0) and third["last"] == second["last"]
    put(arrive, "c.csv", [("r5", "2024-03-03T00:00:00")])
    assert run()["n_new"] == 1
    rows = {r["reference"]: r["is_late"] for r in spark.read.parquet(f"{folder}/rows").collect()}
    assert rows == {"r1": False, "r2": False, "r3": True, "r4": False, "r5": False}
    assert I.runs(spark, folder).agg(F.sum("n_new"), F.max("run")).first() == (5, 4)


def test_labels_late_early_repeated_and_missing(spark, tmp_path):
    at = lambda day, hour=0: datetime.datetime(2024, 3, day, hour)
    p_kind, l_kind = "transaction_id long, ts timestamp, score int", "transaction_id long, label_ts timestamp, is_fraud boolean"
    predictions = [[(1, at(1), 10), (2, at(1, 1), 20), (3, at(1, 2), 30), (6, at(1, 3), 60)], [(4, at(5), 40)], [(90, at(28), 0)], [(91, at(29), 0)]]
    labels = [[(1, at(2), True), (4, at(4), False), (5, at(2), True)], [(1, at(2, 5), False), (2, at(6), True), (6, at(12), True)], [(80, at(28), False)], [(81, at(29), False)]]
    # 1: repeated label, 2: late one, 3: none, 4: label before its prediction, 6: label too late
    for k in range(4):
        spark.createDataFrame(predictions[k], p_kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
        spark.createDataFrame(labels[k], l_kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        joined = I.labelled(*(spark.readStream.schema(kind).parquet(str(tmp_path / name)) for name, kind in (("p", p_kind), ("l", l_kind))))
        joined.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    found = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("transaction_id < 50").collect())
    batch = I.labelled(spark.read.schema(p_kind).parquet(str(tmp_path / "p")), spark.read.schema(l_kind).parquet(str(tmp_path / "l")))
    want = sorted(tuple(r) for r in batch.where("transaction_id < 50").collect())
    assert found == want and {r[0]: r[4] for r in want} == {1: True, 2: True, 3: None, 4: False, 6: None}
