"""Ingest in runs that go on from each other, and labels that arrive after the predictions they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.risk import count_if

RUNS = "run long, since timestamp, last timestamp, n_read long, n_new long, n_late long, n_repeated long, finished_at timestamp"


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of ingest_run() so far, a row each."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/runs")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(RUNS).parquet(f"{folder}/runs") if there else spark.createDataFrame([], RUNS)


def ingest_run(stream: DataFrame, folder: str, key: str = "reference", at: str = "ts", late: str = "7 days") -> dict:
    """Read what has arrived in a stream since the last run and append it to folder/rows; returns the run's numbers, which folder/runs keeps.

    Each file is read once over all runs, and rows that repeat a key within `late` of its first row are dropped; both survive restarts, as they are
    part of the stream's own checkpoint. Rows at or before the newest time of the runs before count as late: they are kept and told apart
    by the column is_late. A run without new files adds a row of zeros and keeps the newest time.
    """
    spark = stream.sparkSession
    past = runs(spark, folder).agg(F.max("run").alias("run"), F.max("last").alias("last")).first()
    number, since = (past["run"] or 0) + 1, past["last"]
    stamp = F.col(at).cast("timestamp")
    is_late = F.coalesce(stamp <= F.lit(since), F.lit(False)) if since else F.lit(False)
    read = stream.withColumn(at, stamp).observe("read", F.count(F.lit(1)).alias("n"))
    once = read.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    kept = once.withColumn("is_late", is_late).observe("kept", F.count(F.lit(1)).alias("n"), count_if(F.col("is_late")).alias("late"), F.unix_micros(F.max(at)).alias("last"))
    query = kept.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start()
    query.awaitTermination()
    steps = [p.observedMetrics for p in query.recentProgress]
    total = {name: sum(s[of][name] or 0 for s in steps if of in s) for of, name in (("kept", "late"),)}
    n_read, n_kept = (sum(s[of]["n"] or 0 for s in steps if of in s) for of in ("read", "kept"))
    last = max((s["kept"]["last"] for s in steps if "kept" in s and s["kept"]["last"] is not None), default=None)
    row = spark.createDataFrame([(number, last, n_read, n_kept, total["late"], n_read - n_kept)], "run long, last long, n_read long, n_new long, n_late long, n_repeated long")
    before = F.lit(since).cast("timestamp")
    row = row.withColumns({"since": before, "last": F.greatest(F.timestamp_micros("last"), before), "finished_at": F.current_timestamp()}).select(*runs(spark, folder).columns)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/runs")
    return runs(spark, folder).where(F.col("run") == number).first().asDict()


def labelled(predictions: DataFrame, labels: DataFrame, wait: str = "7 days", late: str = "1 hour") -> DataFrame:
    """(transaction_id, ts, ..., label_ts, is_fraud): predictions (transaction_id, ts, ...) with the label (transaction_id, label_ts, is_fraud) that comes within `wait` of them, before or after.

    Streams or tables. Of repeated labels of a transaction the first counts. In a stream a prediction leaves once, with its label as soon as both are there, without
    one when the watermarks, which trail by `late`, have passed its time.
    """
    if labels.isStreaming:
        once = labels.withWatermark("label_ts", late).dropDuplicatesWithinWatermark(["transaction_id"])
        own = predictions.withWatermark("ts", late)
    else:
        first = F.min(F.struct("label_ts", "is_fraud"))
        once = labels.groupBy("transaction_id").agg(first.alias("l")).select("transaction_id", "l.label_ts", "l.is_fraud")
        own = predictions
    p, q = own.alias("p"), once.alias("q")
    near = (F.col("q.label_ts") >= F.col("p.ts") - F.expr(f"INTERVAL {wait}")) & (F.col("q.label_ts") <= F.col("p.ts") + F.expr(f"INTERVAL {wait}"))
    return p.join(q, (F.col("p.transaction_id") == F.col("q.transaction_id")) & near, "left_outer").select("p.*", "q.label_ts", "q.is_fraud")
