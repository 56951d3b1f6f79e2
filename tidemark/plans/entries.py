"""Lookups, pages, labels and small answers, as a client asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.risk import answered, band, bounded, challenge, contributions, count_if, distance_words, fits_band, half_even, named, pages, payer_question
from tidemark.plans.accounts import KNN, SNAP, composite, snapshot
from tidemark.plans.base import NOW, even, query
from tidemark.sources.adapter import AS_OF


def lookup(df: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of a few keys; the test on the plain column reaches the scan."""
    return df.where(F.col(key).isin(values))


@query("SELECT id, amount, status FROM k_txn WHERE id IN (1, 7, 32, 33, 4000)")
def txn_lookup(k):
    return lookup(k.txn, "id", [1, 7, 32, 33, 4000]).select("id", "amount", "status")


def page(df: DataFrame, cursor: str | None, size: int) -> DataFrame:
    """The `size` newest rows (id, ts, ...) before cursor, or of all without one, with next_cursor: the oldest of their times."""
    rows = df if cursor is None else df.where(F.col("ts") < F.lit(cursor).cast("timestamp_ntz"))
    rows = rows.orderBy(F.desc("ts"), "id").limit(int(bounded("size", size, 1, 1000)))
    return rows.join(F.broadcast(rows.agg(F.min("ts").alias("next_cursor"))))  # one row


@query("SELECT *, (SELECT min(ts) FROM p) AS next_cursor FROM p", "p AS (SELECT id, ts, amount FROM k_txn ORDER BY ts DESC, id LIMIT 25)")
def txn_page_first(k):
    return page(k.txn.select("id", "ts", "amount"), None, 25)


@query("SELECT *, (SELECT min(ts) FROM p) AS next_cursor FROM p", "p AS (SELECT id, ts, amount FROM k_txn WHERE ts < timestamp'1998-01-01 00:00:00' ORDER BY ts DESC, id LIMIT 25)")
def txn_page_next(k):
    return page(k.txn.select("id", "ts", "amount"), "1998-01-01 00:00:00", 25)


@query("SELECT status, count(*) AS n, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages FROM k_txn GROUP BY 1 UNION ALL SELECT 'NONE', 0, 1")
def page_counts(k):
    n = k.txn.groupBy("status").agg(F.count("*").alias("n")).unionByName(k.spark.createDataFrame([("NONE", 0)], "status string, n long"))
    return n.select("status", "n", pages(F.col("n"), 50).alias("pages"))


@query(
    """SELECT id, count(*) OVER w AS prior, count(CASE WHEN amount >= 9000 AND amount < 10000 THEN 1 END) OVER w AS prior_structuring, count(CASE WHEN is_fraud THEN 1 END) OVER w AS prior_fraud FROM k_txn
    WINDOW w AS (PARTITION BY sender_account_id ORDER BY ts, id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"""
)
def last_fifty(k):
    """What the 50 transactions before each one, by its sender, were."""
    w = Window.partitionBy("sender_account_id").orderBy("ts", "id").rowsBetween(-50, -1)
    return k.txn.select("id", F.count("*").over(w).alias("prior"), count_if(fits_band(F.col("amount"))).over(w).alias("prior_structuring"), count_if(F.col("is_fraud")).over(w).alias("prior_fraud"))


_QUESTION = "CASE id % 3 WHEN 0 THEN 'Did you yourself send ' || m || '?' WHEN 1 THEN 'Who is to receive ' || m || '?' ELSE 'What are the ' || m || ' for?' END"


@query(f"SELECT id, {_QUESTION} AS question FROM (SELECT id, 'USD ' || format('{{:,.2f}}', floor(amount * 100) / 100) AS m FROM k_txn WHERE status = 'FLAGGED')")
def challenge_questions(k):
    return k.txn.where("status = 'FLAGGED'").select("id", challenge(F.floor(F.col("amount") * 100) / 100, F.lit(None).cast("string"), F.col("id")).alias("question"))


_SEVEN = """CASE id % 7 WHEN 0 THEN 'Which code did we just send to your phone?' WHEN 1 THEN 'Which code did we just send to your mail address?' WHEN 2 THEN 'What are the last four digits of your phone number?' WHEN 3 THEN 'What are the ' || m || ' meant for?'
    WHEN 4 THEN 'Do you want ' || coalesce(upper(left(name, 1)) || lower(substr(name, 2)), 'the payee') || ' to receive ' || m || '?' WHEN 5 THEN 'In whose name is the account that receives ' || m || '?' ELSE 'Where do the ' || m || ' come from?' END"""


@query(f"SELECT id, {_SEVEN} AS question FROM (SELECT t.id, c.name, 'USD ' || format('{{:,.2f}}', floor(t.amount * 100) / 100) AS m FROM k_txn t LEFT JOIN k_account a ON a.id = t.receiver_account_id LEFT JOIN k_customer c ON c.id = a.customer_id WHERE t.status IN ('FLAGGED', 'PENDING'))")
def payer_questions(k):
    """A question for each transaction that is held, with the name of who is to receive it."""
    held = k.txn.where("status in ('FLAGGED', 'PENDING')").select("id", "amount", F.col("receiver_account_id").alias("to"))
    names = k.account.select(F.col("id").alias("to"), "customer_id").join(k.customer.select(F.col("id").alias("customer_id"), "name"), "customer_id", "left").select("to", "name")
    return held.join(names, "to", "left").select("id", payer_question(F.floor(F.col("amount") * 100) / 100, F.lit(None).cast("string"), F.col("name"), F.col("id")).alias("question"))


_ANSWER = "CASE {} % 4 WHEN 0 THEN ' test ' WHEN 1 THEN 'TEST' WHEN 2 THEN 'tset' END"


@query(f"SELECT id, CASE WHEN upper(trim({_ANSWER.format('id')})) = 'TEST' THEN 'COMPLETED' ELSE status END AS status FROM k_txn WHERE status IN ('FLAGGED', 'PENDING')")
def challenge_answers(k):
    """Status after the answers given; a wrong or missing one leaves it as it is."""
    held = k.txn.where("status in ('FLAGGED', 'PENDING')")
    return held.select("id", answered(F.expr(_ANSWER.format("id")), F.col("status")).alias("status"))


@query("SELECT account_id, CASE WHEN anomaly_score >= 70 THEN 'HIGH' WHEN anomaly_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM composite", KNN)
def score_bands(k):
    return composite(k).select("account_id", band(F.col("anomaly_score")).alias("band"))


_INTS = "CAST(round_even(raw, 0) AS BIGINT) AS knn, CAST(rule_score AS BIGINT) AS rule"


@query(f"SELECT account_id, CASE WHEN abs(knn - rule) * 9.99 > 200 THEN 'far' WHEN abs(knn - rule) * 9.99 > 100 THEN 'apart' ELSE 'close' END AS words FROM (SELECT account_id, {_INTS} FROM composite)", KNN)
def score_distance(k):
    """How far an account's two scores are apart, on the scale to 999."""
    c = composite(k).select("account_id", *_whole())
    return c.select("account_id", distance_words(F.col("knn") * 9.99, F.col("rule") * 9.99).alias("words"))


def _whole() -> list[Column]:
    return [half_even(F.col("knn_raw")).cast("long").alias("knn"), F.col("rule_score").cast("long").alias("rule")]


@query(f"SELECT account_id, CAST(floor(knn * 60 / 100.0 + 0.5) AS BIGINT) || ',' || CAST(floor(rule * 40 / 100.0 + 0.5) AS BIGINT) AS points, CASE WHEN rule * 40 > knn * 60 THEN 'rules' ELSE 'knn' END AS top FROM (SELECT account_id, {_INTS} FROM composite)", KNN)
def score_contributions(k):
    c = composite(k).select("account_id", *_whole())
    points, top = contributions([("knn", F.col("knn"), 60), ("rules", F.col("rule"), 40)])
    return c.select("account_id", F.array_join(F.transform(points, lambda x: x.cast("string")), ",").alias("points"), top.alias("top"))


_SEVEN = [
    ("FRAUD_RATIO", "evaluation_count > 0 AND decline_count * 100.0 / evaluation_count >= 30"), ("PASS_THROUGH", "turnover_ratio BETWEEN 0.7 AND 5 AND in_volume > 1000"), ("SENDER_DIVERSITY", "unique_senders > 10"), ("STRUCTURING", "structuring_count >= 2"),
    ("TOR", "tor_count > 0"), ("PEP_SANCTIONS", "pep_flag"), ("HIGH_TIER", "risk_tier IN ('HIGH', 'CRITICAL')"),
]


@query(
    f"SELECT account_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {n!r} END' for n, c in _SEVEN)}], lambda x: x IS NOT NULL), ',') AS indicators FROM (SELECT snap.*, turnover AS turnover_ratio, c.pep_flag, c.risk_tier FROM snap JOIN k_account a ON a.id = account_id LEFT JOIN k_customer c ON c.id = a.customer_id)",
    SNAP,
)
def snapshot_indicators(k):
    """The seven marks that a client shows on an account's snapshot."""
    owner = k.account.select(F.col("id").alias("account_id"), "customer_id").join(k.customer.select(F.col("id").alias("customer_id"), "pep_flag", "risk_tier"), "customer_id", "left").select("account_id", "pep_flag", "risk_tier")
    s = snapshot(k).select("account_id", "evaluation_count", "decline_count", "turnover_ratio", "in_volume", "unique_senders", "structuring_count", "tor_count").join(owner, "account_id")
    return s.select("account_id", F.array_join(named(*((n, F.expr(c)) for n, c in _SEVEN)), ",").alias("indicators"))


def redact_pii(df: DataFrame, names: list[str], ids: list[str]) -> DataFrame:
    """df with names cut to their first letter and ids to their last four characters; null stays null."""
    return df.withColumns({c: F.concat(F.substring(c, 1, 1), F.lit("***")) for c in names} | {c: F.concat(F.lit("****"), F.right(F.col(c).cast("string"), F.lit(4))) for c in ids})


@query("SELECT '****' || right(CAST(id AS VARCHAR), 4) AS id, name[1:1] || '***' AS name, risk_tier FROM k_customer")
def redacted_customers(k):
    return redact_pii(k.customer.select("id", "name", "risk_tier"), ["name"], ["id"])


@query("SELECT id, to_json({'id': id, 'score': final_score, 'outcome': outcome}) AS json FROM k_log")
def log_as_json(k):
    return k.log.select("id", F.to_json(F.struct("id", F.col("final_score").alias("score"), "outcome")).alias("json"))


@query(f"SELECT a.id AS account_id FROM k_account a WHERE NOT EXISTS (SELECT 1 FROM k_txn t WHERE t.sender_account_id = a.id AND t.ts >= {NOW} - INTERVAL 1000 DAY AND t.amount >= 20000)")
def accounts_without_large_txns(k):
    large = k.txn.where((F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval '1000' day")) & (F.col("amount") >= 20000)).select(F.col("sender_account_id").alias("account_id"))
    return k.account.select(F.col("id").alias("account_id")).join(large, "account_id", "left_anti")


@query(f"SELECT a.customer_id, count(*) FILTER (ts >= {NOW} - INTERVAL 24 HOUR) AS n_24h, count(*) AS n_7d, {even('sum(amount)', 6)} AS total_7d FROM k_txn JOIN k_account a ON a.id = sender_account_id WHERE ts >= {NOW} - INTERVAL 7 DAY GROUP BY 1")
def customer_velocity_week(k):
    """The last seven days and, inside them, the last day; sparse tables may have none."""
    now = F.lit(AS_OF).cast("timestamp_ntz")
    t = k.txn.where(F.col("ts") >= now - F.expr("interval '7' day")).join(k.account.select(F.col("id").alias("sender_account_id"), "customer_id"), "sender_account_id")
    return t.groupBy("customer_id").agg(count_if(F.col("ts") >= now - F.expr("interval '24' hour")).alias("n_24h"), F.count("*").alias("n_7d"), half_even(F.sum("amount"), 6).alias("total_7d"))


@query("SELECT day, account_id, n FROM (SELECT CAST(ts AS DATE)::VARCHAR AS day, sender_account_id AS account_id, count(*) AS n FROM k_txn WHERE ts >= timestamp'2000-06-01 00:00:00' GROUP BY 1, 2)")
def account_series(k):
    """Each account's days, for a series of snapshots by time."""
    t = k.txn.where("ts >= timestamp_ntz'2000-06-01 00:00:00'")
    return t.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("sender_account_id").alias("account_id")).agg(F.count("*").alias("n"))


@query("SELECT id, account_id, ts FROM (SELECT id, sender_account_id AS account_id, ts, row_number() OVER (ORDER BY ts, id) AS n FROM k_txn WHERE ts > timestamp'1997-06-01 00:00:00') WHERE n <= 50000")
def delta_batch(k):
    """The oldest rows after a checkpoint, 50,000 at most: what one incremental run takes."""
    return k.txn.where("ts > timestamp_ntz'1997-06-01 00:00:00'").orderBy("ts", "id").limit(50_000).select("id", F.col("sender_account_id").alias("account_id"), "ts")
