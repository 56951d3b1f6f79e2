"""Keyed tables, order statistics by group, and drift by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.risk import half_even
from tidemark.operators import monitoring as M
from tidemark.operators.quantiles import nearest_ranks
from tidemark.operators.tables import shared_folder
from tidemark.plans.base import even, query
from tidemark.plans.monitors import _LEVEL, SPLIT, _psi_of, _sides
from tidemark.sources import keyed

#: Edges of transactions up to here are loaded at once, later ones are merged.
LOADED_TO = "1998-01-01 00:00:00"


@query("SELECT sender_account_id AS src, receiver_account_id AS dst, count(*) AS n, CAST(round_even(sum(amount), 8) AS DOUBLE) AS total, max(ts) AS last_ts FROM k_txn GROUP BY 1, 2")
def merged_edges(k):
    """Edges by sender and receiver from a keyed table: loaded to a day, then merged with what came later, a batch that is repeated once."""
    edge = lambda t: t.groupBy(F.col("sender_account_id").alias("src"), F.col("receiver_account_id").alias("dst")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.max("ts").alias("last_ts"))
    at, spark = F.lit(LOADED_TO).cast("timestamp_ntz"), k.txn.sparkSession
    folder = shared_folder(spark, "edges")
    keyed.create(edge(k.txn.where(F.col("ts") < at)), folder, ["src", "dst"], buckets=8)
    add = {"n": F.col("old.n") + F.col("new.n"), "total": F.col("old.total") + F.col("new.total"), "last_ts": F.greatest("old.last_ts", "new.last_ts")}
    for _ in range(2):
        keyed.merge(edge(k.txn.where(F.col("ts") >= at)), folder, add, batch=("later", 1))
    return keyed.read(spark, folder).withColumn("total", half_even(F.col("total"), 8))


@query("SELECT a.id, a.balance, a.status, coalesce(t.last_ts, a.last_active) AS last_active FROM k_account a LEFT JOIN (SELECT sender_account_id AS id, max(ts) AS last_ts FROM k_txn WHERE amount >= 20000 GROUP BY 1) t ON t.id = a.id")
def merged_accounts(k):
    """Accounts in a keyed table, whose last activity large transactions change; accounts that are not there are not inserted."""
    spark = k.txn.sparkSession
    folder = shared_folder(spark, "accounts")
    keyed.create(k.account.select("id", "balance", "status", "last_active"), folder, ["id"], buckets=8)
    seen = k.txn.where("amount >= 20000").groupBy(F.col("sender_account_id").alias("id")).agg(F.max("ts").alias("last_active"))
    keyed.merge(seen, folder, insert=False)
    return keyed.read(spark, folder)


_RANK = "list_sort(list({0}))[CAST(floor(count({0}) * CAST({1} AS DOUBLE)) AS INT) + 1]"


@query(f"SELECT outcome, count(processing_time_ms) AS n, {_RANK.format('processing_time_ms', 0.5)} AS p50, {_RANK.format('processing_time_ms', 0.9)} AS p90, {_RANK.format('processing_time_ms', 0.99)} AS p99 FROM k_log WHERE processing_time_ms IS NOT NULL GROUP BY 1")
def latency_by_outcome(k):
    return nearest_ranks(k.log, ["outcome"], "processing_time_ms", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


HISTORY = f"""cur AS (SELECT strftime(ts, '%Y-%m-%d') AS day, final_score, least(final_score // 100, 9) AS bucket FROM k_log WHERE ts >= timestamp'{SPLIT}' AND final_score BETWEEN 0 AND 999),
    past AS (SELECT final_score, least(final_score // 100, 9) AS bucket FROM k_log WHERE ts < timestamp'{SPLIT}' AND final_score BETWEEN 0 AND 999),
    day_bins AS (SELECT d.day, b.range AS bucket, coalesce(r.n, 0) AS r, coalesce(c.n, 0) AS c FROM (SELECT DISTINCT day FROM cur) d CROSS JOIN range(10) b LEFT JOIN (SELECT bucket, count(*) AS n FROM past GROUP BY 1) r ON r.bucket = b.range
    LEFT JOIN (SELECT day, bucket, count(*) AS n FROM cur GROUP BY 1, 2) c ON c.day = d.day AND c.bucket = b.range),
    history AS (SELECT s.day, s.n, s.avg_score, p.psi, s.avg_score - (SELECT avg(final_score) FROM past) AS change FROM (SELECT day, count(*) AS n, avg(final_score) AS avg_score FROM cur GROUP BY 1) s JOIN {_psi_of("day_bins", "day")} p ON p.day = s.day)"""
_HISTORY_COLUMNS = f"day, n, {even('avg_score', 6)} AS avg_score, {even('psi', 6)} AS psi, {_LEVEL.format('psi')} AS level, CASE WHEN round_even(change, 6) > 0 THEN 'up' WHEN round_even(change, 6) < 0 THEN 'down' ELSE 'same' END AS direction"


@query(f"SELECT {_HISTORY_COLUMNS} FROM history", HISTORY)
def drift_history(k):
    return M.drift_history(*_sides(k))


@query(f"SELECT {_HISTORY_COLUMNS} FROM history ORDER BY day DESC LIMIT 1", HISTORY)
def latest_drift(k):
    return M.latest_drift(M.drift_history(*_sides(k)))
