"""CSV in and out, changes of tables, streams against their batch counterparts."""

from __future__ import annotations

import datetime

from tidemark.operators.context import velocity
from tidemark.sources import files
from tidemark.streaming import jobs

HEADER = ",".join(files.CSV_COLUMNS)
LOADED = "2024-02-01 00:00:00"


def test_csv_defaults(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ["R1,A,B,12.5,EUR,CARD,ATM,2024-01-02T03:04:05Z,text,Yes,SMURFING", ",A,,x,,,,,,maybe,", "R3, ,B,1,,,,,,,"]
    (tmp_path / "in/a.csv").write_text("\n".join([HEADER, *lines]))
    rows = {r["amount"]: r for r in files.read_csv(spark, str(tmp_path / "in"), LOADED).collect()}
    assert set(rows) == {12.5, 0.0}
    one, two = rows[12.5], rows[0.0]
    assert (one["reference"], one["currency"], one["is_fraud"], one["ts"]) == ("R1", "EUR", True, datetime.datetime(2024, 1, 2, 3, 4, 5))
    assert two["reference"].startswith("BLK") and (two["currency"], two["transaction_type"], two["channel"], two["is_fraud"], two["receiver_account_id"]) == ("USD", "WIRE", "ONLINE", False, None)
    assert two["ts"] == datetime.datetime(2024, 2, 1)
    files.write_csv(files.read_csv(spark, str(tmp_path / "in"), LOADED), str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out"), LOADED).count() == 2
    query = jobs.ingest(jobs.csv_stream(spark, str(tmp_path / "in"), LOADED), str(tmp_path / "table"), str(tmp_path / "mark"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "id int, v string")
    assert sorted(map(tuple, files.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(r["id"] for r in files.insert_if_absent(old, new, "id").collect()) == [1, 2, 3]
    assert sorted(map(tuple, files.set_column(old, new.where("id = 2"), "id", "v").collect())) == [(1, "a"), (2, "c")]
    assert [r["id"] for r in files.repeated_keys(new, "id").collect()] == [3]


def test_streaming_buckets(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(n, at + datetime.timedelta(hours=5 * n), 100 * (n % 9), ["ALLOW", "DECLINE", None][n % 3]) for n in range(20)]
    spark.createDataFrame(rows, "id long, ts timestamp, final_score int, outcome string").write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema("id long, ts timestamp, final_score int, outcome string").parquet(str(tmp_path / "log"))
    q = jobs.bucket_trend(log).writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    found = {str(r["bucket"])[:10]: (r["n"], r["decline"]) for r in spark.table("buckets").collect()}
    want: dict = {}
    for _, ts, _, o in rows:
        n, d = want.get(str(ts)[:10], (0, 0))
        want[str(ts)[:10]] = (n + 1, d + (o == "DECLINE"))
    assert found == want


def test_velocity_leaves_out_its_own_time(spark):
    at = datetime.datetime(2024, 1, 8)
    offsets = [0, 0, 3600, 3601, 86_400, 7 * 86_400]
    rows = [(n, 1, None, at + datetime.timedelta(seconds=s), 10.0) for n, s in enumerate(offsets)]
    got = {r["id"]: (r["n_1h"], r["n_24h"], r["n_7d"]) for r in velocity(spark.createDataFrame(rows, "id long, sender_account_id long, receiver_account_id long, ts timestamp_ntz, amount double")).collect()}
    assert got == {0: (0, 0, 0), 1: (0, 0, 0), 2: (2, 2, 2), 3: (1, 3, 3), 4: (0, 4, 4), 5: (0, 0, 5)}


def test_score_on_arrival(spark, tmp_path):
    rows = spark.createDataFrame([(n, 250.0 * n) for n in range(8)], "id long, amount double")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    limits = spark.createDataFrame([(0, 1000.0)], "k int, most double")

    def score(batch):
        return batch.join(limits, batch["amount"] > limits["most"], "left").selectExpr("id", "if(most is null, 'ALLOW', 'CHALLENGE') AS outcome")

    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        jobs.score_on_arrival(stream, score, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    found = {r["id"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {n: "CHALLENGE" if n > 4 else "ALLOW" for n in range(8)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_streaming_velocity_is_the_batch_one(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = datetime.datetime(2024, 1, 1)
    rows = [(n, n % 3, None, at + datetime.timedelta(minutes=37 * n * (1 + n % 5 // 4)), float(n)) for n in range(120)]
    rows.sort(key=lambda r: r[3])
    schema = "id long, sender_account_id long, receiver_account_id long, ts timestamp, amount double"
    for k in range(3):  # a batch holds later times than those before it
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = jobs.streaming_velocity(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        out = query.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start()
        out.awaitTermination()
    columns = ["id", "sender_account_id", "n_1h", "n_24h", "n_7d", "sum_24h", "sum_7d"]
    want = velocity(spark.createDataFrame(rows, schema)).select(columns)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect())) == sorted(map(tuple, want.collect()))
