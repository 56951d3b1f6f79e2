"""Structured Streaming counterparts of the batch operators."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.functions.risk import count_if
from tidemark.sources.files import CSV_SCHEMA, parse_rows

HOUR, DAY, WEEK = (n * 1_000_000 for n in (3600, 86_400, 7 * 86_400))


def csv_stream(spark: SparkSession, folder: str, loaded_at: str, files_at_once: int = 10) -> DataFrame:
    """Transactions of CSV files as they arrive in a folder."""
    return parse_rows(spark.readStream.schema(CSV_SCHEMA).option("header", True).option("maxFilesPerTrigger", files_at_once).csv(folder), loaded_at)


def ingest(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files; a file that was read is not read again after a restart."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_on_arrival(stream: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch against the static tables that `score` joins, and append the outcomes; a batch repeated after a failure replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucket_trend(log: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(bucket, n, allow, challenge, decline, total_score) by time bucket; a bucket is final once the watermark has passed it. The column ts is a timestamp."""
    o = F.coalesce("outcome", F.lit("ALLOW"))
    by = log.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
    return by.agg(F.count("*").alias("n"), *(count_if(o == x).alias(x.lower()) for x in ("ALLOW", "CHALLENGE", "DECLINE")), F.sum("final_score").alias("total_score")).select(F.col("w.start").alias("bucket"), "n", "allow", "challenge", "decline", "total_score")


class _Velocity(StatefulProcessor):
    """Keeps a sender's last seven days of (time, amount), up to the watermark's delay more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "t long, amount double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        held = [(int(t), float(a)) for t, a in self.recent.get()] if self.recent.exists() else []
        t = new["t"].tolist()
        events = sorted(held + list(zip(t, new["amount"].tolist(), strict=True)))
        times = [e[0] for e in events]
        sums = [0.0, *accumulate(e[1] for e in events)]
        out = []
        for row_id, at in zip(new["id"].tolist(), t, strict=True):
            end = bisect_left(times, at)  # ties at its own time are left out
            hour, day, week = (bisect_left(times, at - w) for w in (HOUR, DAY, WEEK))
            out.append((row_id, key[0], end - hour, end - day, end - week, sums[end] - sums[day], sums[end] - sums[week]))
        oldest = min(times[-1], timerValues.getCurrentWatermarkInMs() * 1000 or times[-1]) - WEEK
        self.recent.put([e for e in events if e[0] >= oldest])
        # an idle sender's rows go when the last of them can count no more
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((times[-1] + WEEK) // 1000 + 1)
        yield pd.DataFrame(out, columns=["id", "sender_account_id", "n_1h", "n_24h", "n_7d", "sum_24h", "sum_7d"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def streaming_velocity(txn: DataFrame, late: str = "1 hour") -> DataFrame:
    """(id, sender_account_id, n_1h, n_24h, n_7d, sum_24h, sum_7d): the batch windows, over what has arrived. ts is a timestamp.

    Rows that come in order of time by batch give the batch operator's numbers; later ones see what came before them.
    """
    rows = txn.withWatermark("ts", late).select("id", "sender_account_id", F.unix_micros("ts").alias("t"), F.col("amount").cast("double").alias("amount"), "ts")
    kind = "id long, sender_account_id long, n_1h long, n_24h long, n_7d long, sum_24h double, sum_7d double"
    return rows.groupBy("sender_account_id").transformWithStateInPandas(_Velocity(), kind, "Append", "EventTime")
