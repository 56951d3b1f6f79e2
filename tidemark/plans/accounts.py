"""Account and customer scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.risk import count_if, half_even
from tidemark.operators import accounts as A
from tidemark.operators import evaluation as E
from tidemark.operators import ivfpq as I
from tidemark.operators import nearest as N
from tidemark.operators import pivots as P
from tidemark.operators.tables import settled
from tidemark.plans.base import NOW, SINCE_30D, even, query
from tidemark.plans.graphs import NODE_STATS, node_stats
from tidemark.sources.adapter import AS_OF

SINCE = f"timestamp'{SINCE_30D}'"
STATS = f"""s_out AS (SELECT sender_account_id AS id, sum(amount_usd) AS out_volume, avg(amount_usd) AS avg_out, count(*) FILTER (amount >= 9000 AND amount < 10000) AS structuring, count(*) FILTER (ts >= {SINCE}) AS out_30d FROM k_txn GROUP BY 1),
    s_in AS (SELECT receiver_account_id AS id, sum(amount_usd) AS in_volume, avg(amount_usd) AS avg_in, count(DISTINCT sender_account_id) AS unique_senders FROM k_txn WHERE receiver_account_id IS NOT NULL GROUP BY 1),
    stats AS (SELECT a.id AS account_id, coalesce(a.average_monthly_volume, 0) AS avg_monthly_vol, coalesce(out_volume, 0) AS out_volume, coalesce(avg_out, 0) AS avg_out, coalesce(structuring, 0) AS structuring, coalesce(out_30d, 0) AS out_30d,
    coalesce(in_volume, 0) AS in_volume, coalesce(avg_in, 0) AS avg_in, coalesce(unique_senders, 0) AS unique_senders, coalesce(out_volume, 0) / greatest(coalesce(in_volume, 0), 1) AS ptr FROM k_account a LEFT JOIN s_out o ON o.id = a.id LEFT JOIN s_in i ON i.id = a.id)"""
RULES = "CASE WHEN ptr BETWEEN 0.8 AND 1.2 AND in_volume > 5000 THEN 35 ELSE 0 END + CASE WHEN unique_senders >= 5 THEN 25 ELSE 0 END + CASE WHEN structuring >= 2 THEN 25 ELSE 0 END + CASE WHEN out_30d >= 10 AND ptr > 0.7 THEN 15 ELSE 0 END"


def stats(k):
    return A.account_stats(k.account, k.txn, SINCE_30D)


@query(f"SELECT account_id, {even('out_volume', 8)} AS out_volume, {even('avg_out', 8)} AS avg_out, structuring, out_30d, {even('in_volume', 8)} AS in_volume, {even('avg_in', 8)} AS avg_in, unique_senders, {even('avg_monthly_vol', 8)} AS avg_monthly_vol FROM stats", STATS)
def account_stats(k):
    return stats(k).withColumns({c: half_even(F.col(c), 8) for c in ("out_volume", "avg_out", "in_volume", "avg_in", "avg_monthly_vol")})


@query(
    f"""SELECT account_id, {even("ptr", 3)} AS pass_through_ratio, {RULES} AS rule_score, array_to_string(list_filter([CASE WHEN ptr BETWEEN 0.8 AND 1.2 AND in_volume > 5000 THEN 'PASS_THROUGH' END, CASE WHEN unique_senders >= 5 THEN 'HIGH_SENDER_COUNT' END,
    CASE WHEN structuring >= 2 THEN 'STRUCTURING' END, CASE WHEN out_30d >= 10 AND ptr > 0.7 THEN 'RAPID_DISBURSEMENT' END], lambda x: x IS NOT NULL), ',') AS indicators FROM stats""",
    STATS,
)
def anomaly_rule_score(k):
    return A.rule_score(stats(k)).withColumn("indicators", F.array_join("indicators", ","))


VECTORS = """vin AS (SELECT *, CASE WHEN in_volume = 0 THEN 1 ELSE in_volume END AS iv FROM stats), vectors AS (SELECT account_id, least(out_volume / greatest(iv, 1), 5) AS v0, least(unique_senders, 100) AS v1, least(structuring, 50) AS v2, least(out_30d, 500) AS v3,
    least(avg_out, 100000) AS v4, least(avg_in, 100000) AS v5, least(avg_monthly_vol, 1000000) AS v6, least(greatest(out_volume, iv) / greatest(least(out_volume, iv), 1), 50) AS v7 FROM vin)"""
V = [f"v{n}" for n in range(8)]


@query("SELECT account_id, " + ", ".join(f"{even(v, 8)} AS {v}" for v in V) + " FROM vectors", f"{STATS}, {VECTORS}")
def account_vectors(k):
    return A.account_vectors(stats(k)).select("account_id", *(half_even(F.col(v), 8).alias(v) for v in V))


@query("SELECT account_id, " + ", ".join(f"{even(f'({v} - (SELECT avg({v}) FROM vectors)) / coalesce(nullif((SELECT stddev_pop({v}) FROM vectors), 0), 1)', 6)} AS z_{v}" for v in V[:4]) + " FROM vectors", f"{STATS}, {VECTORS}")
def standard_scale(k):
    z = E.standard_scaled(A.account_vectors(stats(k)), ["account_id"], V[:4])
    return z.select("account_id", *(half_even(F.col(f"z_{v}"), 6).alias(f"z_{v}") for v in V[:4]))


def composite(k):
    s = settled(stats(k))
    return N.anomaly(A.account_vectors(s), A.rule_score(s), V)


def _nearest(rows: str, index: str, columns: list[str]) -> str:
    """SQL for (account_id, distance): mean of the 7 least squared distances."""
    d = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in columns)
    return f"(SELECT account_id, avg(d) AS distance FROM (SELECT a.account_id, {d} AS d, row_number() OVER (PARTITION BY a.account_id ORDER BY {d}) AS n FROM {rows} a CROSS JOIN {index} b) WHERE n <= 7 GROUP BY 1)"


KNN = f"""{STATS}, {VECTORS}, normal AS (SELECT * FROM vectors WHERE v0 < 0.6 OR (SELECT count(*) FROM vectors WHERE v0 < 0.6) < 10),
    moments AS (SELECT {", ".join(f"avg({v}) AS m_{v}, coalesce(nullif(stddev_pop({v}), 0), 1) AS s_{v}" for v in V)} FROM normal), scaled AS (SELECT account_id, {", ".join(f"({v} - m_{v}) / s_{v} AS {v}" for v in V)} FROM vectors CROSS JOIN moments),
    knn_index AS (SELECT * FROM scaled WHERE account_id IN (SELECT account_id FROM normal)), dist AS {_nearest("scaled", "knn_index", V)}, p95 AS (SELECT coalesce(nullif(quantile_cont(distance, 0.95), 0), 1) AS p FROM dist WHERE account_id IN (SELECT account_id FROM normal)),
    composite AS (SELECT account_id, least(100, distance / p * 50) AS raw, {RULES} AS rule_score, {even(f"0.5 * least(100, distance / p * 50) + 0.5 * ({RULES})", 1)} AS anomaly_score FROM dist CROSS JOIN p95 JOIN stats USING (account_id))"""


@query(f"SELECT account_id, {even('raw', 1)} AS knn_score, rule_score, anomaly_score, anomaly_score >= 40 AS is_mule_suspect FROM composite", KNN)
def knn_anomaly(k):
    return composite(k).drop("knn_raw")


@query(
    """SELECT vec_id, arg_max(y, (w, -y)) AS label_pred FROM (SELECT vec_id, y, sum(CASE WHEN d > 0 THEN 1 / d ELSE 1e6 END) AS w FROM (SELECT a.vec_id, b.label AS y, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE n <= 5 GROUP BY 1, 2) GROUP BY 1"""
)
def knn_classify(k):
    return N.classify(k.raw("embeddings"), "vec_id", "embedding", "label")


@query()
def knn_classify_indexed(k):
    """Labels from an inverted file with product codes, which looks at as many cells as 0.95 of the neighbours of a sample need."""
    rows = k.raw("embeddings")
    index = I.build(rows, "vec_id", "embedding", "label")
    return I.classify(rows, index, "vec_id", "embedding", probes=I.probes_for(index))


@query(f"SELECT account_id, {even('distance', 4)} AS distance FROM {_nearest('vectors', 'vectors', V)}", f"{STATS}, {VECTORS}")
def knn_distance(k):
    v = A.account_vectors(stats(k)).select("account_id", F.array(*V).alias("x"))
    return P.mean_distances(v, P.build(v), "account_id").select("account_id", half_even(F.col("distance"), 4).alias("distance"))


@query("SELECT account_id FROM (SELECT sender_account_id AS account_id, count(*) FILTER (is_fraud) / count(*) AS rate FROM k_txn GROUP BY 1) WHERE rate >= 0.30")
def fraud_ratio_accounts(k):
    g = k.txn.groupBy(F.col("sender_account_id").alias("account_id")).agg((count_if(F.col("is_fraud")) / F.count("*")).alias("rate"))
    return g.where("rate >= 0.30").select("account_id")


@query("SELECT account_id, structuring FROM stats WHERE structuring >= 2", STATS)
def structuring_accounts(k):
    return stats(k).where("structuring >= 2").select("account_id", "structuring")


@query("SELECT a.account_id, c.name, a.anomaly_score FROM composite a JOIN k_account k ON k.id = a.account_id LEFT JOIN k_customer c ON c.id = k.customer_id WHERE anomaly_score >= 40 ORDER BY anomaly_score DESC, account_id LIMIT 50", KNN)
def mule_suspects(k):
    own = k.account.select(F.col("id").alias("account_id"), "customer_id").join(k.customer.select(F.col("id").alias("customer_id"), "name"), "customer_id", "left")
    return knn_anomaly(k).where("is_mule_suspect").join(own, "account_id").orderBy(F.desc("anomaly_score"), "account_id").select("account_id", "name", "anomaly_score").limit(50)


@query(f"SELECT count(*) AS total, count(*) FILTER (anomaly_score >= 40) AS suspects, count(*) FILTER (anomaly_score >= 70) AS high, {even('count(*) FILTER (anomaly_score >= 40) / count(*) * 100', 2)} AS suspect_pct FROM composite", KNN)
def anomaly_summary(k):
    s = F.col("anomaly_score")
    return knn_anomaly(k).agg(F.count("*").alias("total"), count_if(s >= 40).alias("suspects"), count_if(s >= 70).alias("high"), half_even(count_if(s >= 40) / F.count("*") * 100, 2).alias("suspect_pct"))


@query("SELECT k.customer_id, max(anomaly_score) AS max_score, bool_or(anomaly_score >= 40) AS any_suspect FROM composite s JOIN k_account k ON k.id = s.account_id GROUP BY 1", KNN)
def customer_anomaly(k):
    own = k.account.select(F.col("id").alias("account_id"), "customer_id")
    return knn_anomaly(k).join(own, "account_id").groupBy("customer_id").agg(F.max("anomaly_score").alias("max_score"), F.bool_or("is_mule_suspect").alias("any_suspect"))


@query(f"SELECT account_id, {even('ptr', 3)} AS pass_through_ratio, {RULES} AS rule_score FROM stats WHERE {RULES} >= 40 ORDER BY rule_score DESC, account_id LIMIT 50", STATS)
def rule_suspects(k):
    return A.rule_score(stats(k)).where("rule_score >= 40").orderBy(F.desc("rule_score"), "account_id").select("account_id", "pass_through_ratio", "rule_score").limit(50)


@query(
    """SELECT ind AS indicator, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN ptr BETWEEN 0.8 AND 1.2 AND in_volume > 5000 THEN 'PASS_THROUGH' END, CASE WHEN unique_senders >= 5 THEN 'HIGH_SENDER_COUNT' END,
    CASE WHEN structuring >= 2 THEN 'STRUCTURING' END, CASE WHEN out_30d >= 10 AND ptr > 0.7 THEN 'RAPID_DISBURSEMENT' END], lambda x: x IS NOT NULL)) AS ind FROM stats) GROUP BY 1""",
    STATS,
)
def indicator_distribution(k):
    return A.rule_score(stats(k)).select(F.explode("indicators").alias("indicator")).groupBy("indicator").agg(F.count("*").alias("n"))


SNAP = f"""p_out AS (SELECT sender_account_id AS id, count(*) AS out_count, sum(amount) AS out_volume, count(*) FILTER (amount >= 9000 AND amount < 10000) AS structuring_count, count(*) FILTER (is_vpn) AS vpn_count, count(*) FILTER (is_tor) AS tor_count,
    count(DISTINCT receiver_account_id) AS unique_receivers FROM k_txn t LEFT JOIN k_ip i ON i.ip = t.ip_id WHERE ts >= {SINCE} GROUP BY 1),
    p_in AS (SELECT receiver_account_id AS id, count(*) AS in_count, sum(amount) AS in_volume, count(DISTINCT sender_account_id) AS unique_senders FROM k_txn WHERE receiver_account_id IS NOT NULL AND ts >= {SINCE} GROUP BY 1),
    p_log AS (SELECT t.sender_account_id AS id, count(*) AS evaluation_count, avg(final_score) AS avg_score, max(final_score) AS max_score, count(*) FILTER (outcome = 'DECLINE') AS decline_count FROM k_log l JOIN k_txn t ON t.id = l.transaction_id GROUP BY 1),
    p AS (SELECT a.id AS account_id, coalesce(out_count, 0) AS out_count, coalesce(out_volume, 0) AS out_volume, coalesce(structuring_count, 0) AS structuring_count, coalesce(vpn_count, 0) AS vpn_count, coalesce(tor_count, 0) AS tor_count, coalesce(unique_receivers, 0) AS unique_receivers,
    coalesce(in_count, 0) AS in_count, coalesce(in_volume, 0) AS in_volume, coalesce(unique_senders, 0) AS unique_senders, coalesce(evaluation_count, 0) AS evaluation_count, coalesce(avg_score, 0) AS avg_score, coalesce(max_score, 0) AS max_score, coalesce(decline_count, 0) AS decline_count,
    coalesce(out_volume, 0) / greatest(coalesce(in_volume, 0), 1) AS turnover, date_sub('day', a.created_at, {NOW}) AS account_age_days, date_sub('day', a.last_active, {NOW}) > 90 AS is_dormant
    FROM k_account a LEFT JOIN p_out o ON o.id = a.id LEFT JOIN p_in i ON i.id = a.id LEFT JOIN p_log l ON l.id = a.id),
    snap AS (SELECT *, turnover BETWEEN 0.7 AND 1.3 AND in_volume > 1000 AS is_pass_through, least(100, CASE WHEN turnover BETWEEN 0.7 AND 1.3 AND in_volume > 1000 THEN 30 ELSE 0 END + CASE WHEN unique_senders > 5 THEN 20 ELSE 0 END + CASE WHEN structuring_count >= 2 THEN 15 ELSE 0 END
    + CASE WHEN is_dormant THEN 10 ELSE 0 END + CASE WHEN tor_count > 0 THEN 20 ELSE 0 END + CASE WHEN decline_count / greatest(evaluation_count, 1) > 0.3 THEN 5 ELSE 0 END) AS mule_score FROM p)"""


def snapshot(k):
    return A.feature_snapshot(k.account, k.customer, k.txn, k.ip, k.log, AS_OF, SINCE_30D)


@query(
    f"""SELECT account_id, out_count, {even("out_volume", 6)} AS out_volume, in_count, {even("in_volume", 6)} AS in_volume, structuring_count, vpn_count, tor_count, unique_senders, unique_receivers, evaluation_count, decline_count,
    {even("avg_score", 6)} AS avg_score, max_score, {even("turnover", 6)} AS turnover_ratio, account_age_days, is_dormant, is_pass_through, mule_score, mule_score >= 50 AS is_likely_mule FROM snap""",
    SNAP,
)
def feature_snapshot(k):
    s = snapshot(k).withColumns({c: half_even(F.col(c), 6) for c in ("out_volume", "in_volume", "avg_score", "turnover_ratio")})
    names = ["account_id", "out_count", "out_volume", "in_count", "in_volume", "structuring_count", "vpn_count", "tor_count", "unique_senders", "unique_receivers", "evaluation_count", "decline_count", "avg_score", "max_score", "turnover_ratio", "account_age_days", "is_dormant", "is_pass_through", "mule_score", "is_likely_mule"]
    return s.select(names)


@query("SELECT count(*) FILTER (mule_score >= 70) AS high, count(*) FILTER (mule_score >= 40 AND mule_score < 70) AS medium, count(*) AS with_snapshot FROM snap", SNAP)
def feature_store_summary(k):
    m = F.col("mule_score")
    return snapshot(k).agg(count_if(m >= 70).alias("high"), count_if((m >= 40) & (m < 70)).alias("medium"), F.count("*").alias("with_snapshot"))


TIERS = f"""{SNAP}, {STATS}, fr AS (SELECT sender_account_id AS id, count(*) FILTER (is_fraud) / count(*) AS rate FROM k_txn GROUP BY 1),
    tiers AS (SELECT account_id, 1 AS tier, mule_score * 1.0 AS score FROM snap WHERE mule_score >= 40 OR tor_count > 0 UNION ALL SELECT account_id, 2, ({RULES}) * 1.0 FROM stats WHERE {RULES} >= 40 UNION ALL SELECT id, 3, CAST(round_even(rate * 100, 6) AS DOUBLE) FROM fr WHERE rate >= 0.30)"""


@query("SELECT account_id, tier, CAST(score AS DOUBLE) AS score FROM (SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY tier) = 1) ORDER BY tier, score DESC, account_id LIMIT 200", TIERS)
def high_risk_accounts(k):
    one = snapshot(k).where("is_likely_mule or mule_score >= 40 or has_tor_activity").select("account_id", F.lit(1).alias("tier"), F.col("mule_score").cast("double").alias("score"))
    two = A.rule_score(stats(k)).where("rule_score >= 40").select("account_id", F.lit(2).alias("tier"), F.col("rule_score").cast("double").alias("score"))
    g = k.txn.groupBy(F.col("sender_account_id").alias("account_id")).agg((count_if(F.col("is_fraud")) / F.count("*")).alias("rate")).where("rate >= 0.30")
    rows = one.unionByName(two).unionByName(g.select("account_id", F.lit(3).alias("tier"), half_even(F.col("rate") * 100, 6).alias("score")))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("account_id").orderBy("tier"))).where("n = 1").drop("n")
    return first.orderBy("tier", F.desc("score"), "account_id").limit(200)


CMI = f"""o AS (SELECT customer_id, sum(amount) AS outbound, count(*) FILTER (amount >= 9000 AND amount < 10000) AS structuring FROM k_txn JOIN k_account a ON a.id = sender_account_id WHERE ts >= {SINCE} GROUP BY 1),
    i AS (SELECT customer_id, sum(amount) AS inbound, count(DISTINCT sender_account_id) AS unique_senders FROM k_txn JOIN k_account a ON a.id = receiver_account_id WHERE ts >= {SINCE} GROUP BY 1),
    b AS (SELECT customer_id, count(*) FILTER (date_sub('day', last_active, {NOW}) > 90) AS dormant_accounts FROM k_account GROUP BY 1),
    m AS (SELECT b.customer_id, coalesce(outbound, 0) AS outbound, coalesce(structuring, 0) AS structuring, coalesce(inbound, 0) AS inbound, coalesce(unique_senders, 0) AS unique_senders, dormant_accounts, coalesce(outbound, 0) / greatest(coalesce(inbound, 0), 1) AS turnover
    FROM b LEFT JOIN o ON o.customer_id = b.customer_id LEFT JOIN i ON i.customer_id = b.customer_id),
    ms AS (SELECT *, CASE WHEN turnover BETWEEN 0.7 AND 1.3 AND inbound > 1000 THEN 30 ELSE 0 END + CASE WHEN unique_senders > 5 THEN 20 ELSE 0 END + CASE WHEN turnover > 0.8 AND outbound > 5000 THEN 25 ELSE 0 END + CASE WHEN structuring >= 2 THEN 15 ELSE 0 END + CASE WHEN dormant_accounts > 0 THEN 10 ELSE 0 END AS score FROM m)"""


@query(
    f"""SELECT customer_id, {even("inbound", 6)} AS inbound, {even("outbound", 6)} AS outbound, {even("turnover", 6)} AS turnover_ratio, turnover BETWEEN 0.7 AND 1.3 AND inbound > 1000 AS is_pass_through, unique_senders, turnover > 0.8 AND outbound > 5000 AS rapid_disbursement, dormant_accounts, structuring, score AS mule_score, score >= 50 AS is_likely_mule FROM ms""",
    CMI,
)
def customer_mule_indicators(k):
    out = A.customer_mule_indicators(k.account, k.txn, AS_OF, SINCE_30D)
    return out.withColumns({c: half_even(F.col(c), 6) for c in ("inbound", "outbound", "turnover_ratio")})


BOTH = f"{KNN}, {NODE_STATS}, graph_flags AS (SELECT account_id, fraud_ratio >= 0.30 OR pattern_count >= 2 OR (unique_senders >= 5 AND ptr BETWEEN 0.7 AND 1.5 AND in_volume > 10000) AS is_mule FROM rated)"


def _detectors(k):
    """(account_id, anomaly_score, is_mule_suspect, is_mule): what the nearest-neighbour composite and the graph rules say."""
    return knn_anomaly(k).join(A.mule_labels(node_stats(k)).select("account_id", "is_mule"), "account_id")


@query("SELECT account_id FROM composite WHERE anomaly_score >= 40 INTERSECT SELECT account_id FROM graph_flags WHERE is_mule", BOTH)
def flagged_by_both(k):
    return _detectors(k).where("is_mule_suspect and is_mule").select("account_id")


@query(
    f"SELECT {even('avg(CASE WHEN (anomaly_score >= 40) = coalesce(is_mule, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100', 1)} AS agreement_pct, count(*) AS n FROM (SELECT * FROM composite JOIN graph_flags USING (account_id) ORDER BY anomaly_score DESC, account_id LIMIT 200)",
    BOTH,
)
def model_comparison(k):
    """Agreement of two detectors over the 200 accounts that score highest."""
    top = _detectors(k).orderBy(F.desc("anomaly_score"), "account_id").limit(200)
    same = F.coalesce("is_mule_suspect", F.lit(False)) == F.coalesce("is_mule", F.lit(False))
    return top.agg(half_even(F.avg(F.when(same, 1.0).otherwise(0.0)) * 100, 1).alias("agreement_pct"), F.count("*").alias("n"))
