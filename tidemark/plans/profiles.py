"""Customer profiles and histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.risk import count_if, fits_band, half_even, total
from tidemark.plans.base import NOW, even, query
from tidemark.sources.adapter import AS_OF
from tidemark.sources.files import stub_accounts

# Score and outcome of a labelled transaction that was never scored.
SEEDED = {
    "STRUCTURING": (720, "DECLINE"), "SMURFING": (700, "DECLINE"), "LAYERING": (750, "DECLINE"), "ROUND_TRIP": (710, "DECLINE"), "DORMANT_BURST": (680, "CHALLENGE"), "HIGH_RISK_CORRIDOR": (730, "DECLINE"), "RAPID_VELOCITY": (760, "DECLINE"),
}


@query(f"SELECT t.sender_account_id AS account_id, count(*) AS n, {even('avg(final_score)', 6)} AS avg_score, max(final_score) AS max_score, count(*) FILTER (outcome = 'DECLINE') AS declines FROM k_log l JOIN k_txn t ON t.id = l.transaction_id GROUP BY 1")
def prediction_history(k):
    seen = k.log.join(k.txn.select(F.col("id").alias("transaction_id"), F.col("sender_account_id").alias("account_id")), "transaction_id")
    return seen.groupBy("account_id").agg(F.count("*").alias("n"), half_even(F.avg("final_score"), 6).alias("avg_score"), F.max("final_score").alias("max_score"), count_if(F.col("outcome") == "DECLINE").alias("declines"))


WEEK, DAY = f"timestamp'{AS_OF}' - INTERVAL 300 DAY", f"timestamp'{AS_OF}' - INTERVAL 200 DAY"


@query(
    f"""SELECT a.customer_id, count(*) AS n, {even("sum(amount)", 6)} AS total, count(*) FILTER (ts >= {DAY}) AS n_late, count(*) FILTER (is_fraud) AS fraud, count(*) FILTER (amount >= 9000 AND amount < 10000) AS structuring, {even("avg(amount)", 6)} AS avg_amount, max(amount) AS max_amount
    FROM k_txn JOIN k_account a ON a.id = sender_account_id WHERE ts >= {WEEK} GROUP BY 1"""
)
def customer_velocity(k):
    """One pass over the base period with a shorter one inside it; the tables are sparse, so the periods are long."""
    now = F.lit(AS_OF).cast("timestamp_ntz")
    t = k.txn.where(F.col("ts") >= now - F.expr("interval '300' day")).join(k.account.select(F.col("id").alias("sender_account_id"), "customer_id"), "sender_account_id")
    return t.groupBy("customer_id").agg(
        F.count("*").alias("n"), half_even(F.sum("amount"), 6).alias("total"), count_if(F.col("ts") >= now - F.expr("interval '200' day")).alias("n_late"), count_if(F.col("is_fraud")).alias("fraud"), count_if(fits_band(F.col("amount"))).alias("structuring"),
        half_even(F.avg("amount"), 6).alias("avg_amount"), F.max("amount").alias("max_amount"),
    )


_MAP = " ".join(f"WHEN '{n}' THEN {s}" for n, (s, _) in SEEDED.items())
SCORED_TXN = f"""last_log AS (SELECT transaction_id, arg_max(final_score, (ts, id)) AS score FROM k_log GROUP BY 1),
    history AS (SELECT t.*, a.customer_id, a.country AS s_country, coalesce(l.score, CASE WHEN is_fraud THEN CASE fraud_type {_MAP} END END) AS score FROM k_txn t JOIN k_account a ON a.id = t.sender_account_id LEFT JOIN last_log l ON l.transaction_id = t.id)"""


def history(k):
    """Each transaction with its customer and score: of its latest log row, or by its label, or null."""
    last = k.log.groupBy(F.col("transaction_id").alias("id")).agg(F.max_by("final_score", F.struct("ts", "id")).alias("logged"))
    own = k.account.select(F.col("id").alias("sender_account_id"), "customer_id", F.col("country").alias("s_country"))
    by_label = F.create_map(*(F.lit(x) for n, (s, _) in SEEDED.items() for x in (n, s)))
    seeded = F.when(F.col("is_fraud") & F.col("fraud_type").isNotNull(), by_label[F.col("fraud_type")])
    return k.txn.join(own, "sender_account_id").join(last, "id", "left").withColumn("score", F.coalesce("logged", seeded)).drop("logged")


@query("SELECT customer_id, id, ts, amount, score FROM history", SCORED_TXN)
def customer_txn_history(k):
    return history(k).select("customer_id", "id", "ts", "amount", "score")


@query(
    f"""SELECT customer_id, code, count(*) AS txn_count, {even("sum(amount)", 6)} AS volume, count(*) FILTER (is_fraud) AS fraud_count, CAST(round_even(avg(score), 0) AS DOUBLE) AS avg_score, max(score) AS max_score,
    CASE WHEN max(score) >= 700 THEN 'CRITICAL' WHEN max(score) >= 400 THEN 'HIGH' WHEN count(*) FILTER (is_fraud) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
    FROM (SELECT h.customer_id, h.amount, h.is_fraud, h.score, unnest([h.s_country, r.country, b.country]) AS code FROM history h LEFT JOIN k_account r ON r.id = h.receiver_account_id LEFT JOIN k_beneficiary b ON b.id = h.beneficiary_id) WHERE code IS NOT NULL GROUP BY 1, 2""",
    SCORED_TXN,
)
def customer_country_map(k):
    to = k.account.select(F.col("id").alias("receiver_account_id"), F.col("country").alias("r_country"))
    out = k.beneficiary.select(F.col("id").alias("beneficiary_id"), F.col("country").alias("b_country"))
    h = history(k).join(to, "receiver_account_id", "left").join(out, "beneficiary_id", "left")
    rows = h.select("customer_id", "amount", "is_fraud", "score", F.explode(F.array("s_country", "r_country", "b_country")).alias("code")).where("code is not null")
    g = rows.groupBy("customer_id", "code").agg(F.count("*").alias("txn_count"), half_even(F.sum("amount"), 6).alias("volume"), count_if(F.col("is_fraud")).alias("fraud_count"), half_even(F.avg("score")).alias("avg_score"), F.max("score").alias("max_score"))
    level = F.when(F.col("max_score") >= 700, "CRITICAL").when(F.col("max_score") >= 400, "HIGH").when(F.col("fraud_count") > 0, "MEDIUM").otherwise("LOW")
    return g.withColumn("risk_level", level)


NEWEST = f"{SCORED_TXN}, newest AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts DESC, id) AS k, count(*) OVER (PARTITION BY customer_id) AS n FROM history WHERE score IS NOT NULL)"


def _newest(k):
    w = Window.partitionBy("customer_id")
    return history(k).where("score is not null").withColumns({"k": F.row_number().over(w.orderBy(F.desc("ts"), "id")), "n": F.count("*").over(w)})


@query(f"SELECT customer_id, count(*) AS n, {even('avg(score)', 2)} AS avg_score, max(score) AS max_score, count(*) FILTER (score <= 399) AS allow, count(*) FILTER (score BETWEEN 400 AND 699) AS challenge, count(*) FILTER (score >= 700) AS decline, count(*) FILTER (is_fraud) AS fraud FROM newest WHERE k <= 20 GROUP BY 1", NEWEST)
def customer_risk_profile(k):
    s = F.col("score")
    return _newest(k).where("k <= 20").groupBy("customer_id").agg(F.count("*").alias("n"), half_even(F.avg(s), 2).alias("avg_score"), F.max(s).alias("max_score"), count_if(s <= 399).alias("allow"), count_if(s.between(400, 699)).alias("challenge"), count_if(s >= 700).alias("decline"), count_if(F.col("is_fraud")).alias("fraud"))


@query("SELECT customer_id, CASE WHEN max(n) < 4 THEN 'STABLE' WHEN avg(score) FILTER (k <= n // 2) - avg(score) FILTER (k > n // 2) > 50 THEN 'RISING' WHEN avg(score) FILTER (k <= n // 2) - avg(score) FILTER (k > n // 2) < -50 THEN 'FALLING' ELSE 'STABLE' END AS trend FROM newest GROUP BY 1", NEWEST)
def risk_trend(k):
    new = F.col("k") <= F.floor(F.col("n") / 2)
    change = F.avg(F.when(new, F.col("score"))) - F.avg(F.when(~new, F.col("score")))
    return _newest(k).groupBy("customer_id").agg(F.when(F.max("n") < 4, "STABLE").when(change > 50, "RISING").when(change < -50, "FALLING").otherwise("STABLE").alias("trend"))


@query("SELECT transaction_id, id, ts, final_score FROM k_log QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY ts DESC, id DESC) = 1")
def latest_snapshot(k):
    last = k.log.groupBy("transaction_id").agg(F.max_by(F.struct("id", "ts", "final_score"), F.struct("ts", "id")).alias("s"))
    return last.select("transaction_id", "s.id", "s.ts", "s.final_score")


@query("SELECT transaction_id, id, ts, final_score, row_number() OVER (PARTITION BY transaction_id ORDER BY ts, id) AS place FROM k_log WHERE ts >= timestamp'2024-01-15 00:00:00'")
def snapshots_over_time(k):
    w = Window.partitionBy("transaction_id").orderBy("ts", "id")
    return k.log.where("ts >= timestamp_ntz'2024-01-15 00:00:00'").select("transaction_id", "id", "ts", "final_score", F.row_number().over(w).alias("place"))


_RANKS = {"tor": ("critical", 0), "velocity": ("high", 1), "night": ("medium", 2), "round_amount": ("low", 3)}


@query(
    "SELECT id, array_to_string(list_transform(list_sort(list_filter([CASE WHEN id % 2 = 0 THEN '1velocity' END, CASE WHEN id % 3 = 0 THEN '3round_amount' END, CASE WHEN id % 4 = 0 THEN '2night' END, CASE WHEN id % 5 = 0 THEN '0tor' END, CASE WHEN id % 7 = 0 THEN '4other' END], lambda x: x IS NOT NULL)), lambda x: x[2:]), ',') AS factors FROM k_log"
)
def risk_factor_details(k):
    """Factors from the most severe on; unknown ones come last."""
    found = F.array_compact(F.array(*(F.when(F.col("id") % n == 0, F.lit(x)) for n, x in ((2, "velocity"), (3, "round_amount"), (4, "night"), (5, "tor"), (7, "other")))))
    rank = F.create_map(*(F.lit(x) for n, (_, r) in _RANKS.items() for x in (n, r)))
    order = F.array_sort(F.transform(found, lambda x: F.struct(F.coalesce(rank[x], F.lit(4)).alias("r"), x.alias("x"))))
    return k.log.select("id", F.array_join(F.transform(order, lambda s: s["x"]), ",").alias("factors"))


@query("SELECT DISTINCT t.receiver_account_id AS id FROM k_txn t WHERE receiver_account_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k_account a WHERE a.id = t.receiver_account_id AND a.status = 'ACTIVE') UNION SELECT t.sender_account_id FROM k_txn t WHERE NOT EXISTS (SELECT 1 FROM k_account a WHERE a.id = t.sender_account_id AND a.status = 'ACTIVE')")
def missing_accounts(k):
    return stub_accounts(k.txn, k.account.where("status = 'ACTIVE'"))


@query(f"SELECT sender_account_id, {even('coalesce(sum(amount) FILTER (ts >= {0}), 0)'.format(DAY), 6)} AS late_total, date_sub('day', max(ts), {NOW}) AS idle_days FROM k_txn GROUP BY 1")
def sender_activity(k):
    now = F.lit(AS_OF).cast("timestamp_ntz")
    late = F.when(F.col("ts") >= now - F.expr("interval '200' day"), F.col("amount"))
    return k.txn.groupBy("sender_account_id").agg(half_even(total(late), 6).alias("late_total"), F.timestamp_diff("DAY", F.max("ts"), now).alias("idle_days"))
