"""Filters, joins, pages and simple aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.risk import count_if, fits_band, half_even
from tidemark.operators.context import txn_context, velocity_since
from tidemark.plans.base import even, query
from tidemark.sources.adapter import Catalog


def context(k: Catalog) -> DataFrame:
    return txn_context(k.txn, k.account, k.customer, k.ip, k.merchant, k.beneficiary)


@query("SELECT id, ts, amount, fraud_type FROM k_txn WHERE is_fraud")
def fraud_transactions(k):
    return k.txn.where("is_fraud").select("id", "ts", "amount", "fraud_type")


@query("SELECT id, amount FROM k_txn WHERE amount >= 9000 AND amount < 10000")
def structuring_band(k):
    return k.txn.where(fits_band(F.col("amount"))).select("id", "amount")


@query("SELECT id, ts, amount FROM k_txn ORDER BY ts DESC, id LIMIT 50 OFFSET 100")
def txn_page_offset(k):
    return k.txn.select("id", "ts", "amount").orderBy(F.desc("ts"), "id").offset(100).limit(50)


@query("SELECT id, ts, amount FROM k_txn WHERE ts < timestamp'1998-01-01 00:00:00' ORDER BY ts DESC, id LIMIT 50")
def txn_page_cursor(k):
    return k.txn.where("ts < timestamp_ntz'1998-01-01 00:00:00'").select("id", "ts", "amount").orderBy(F.desc("ts"), "id").limit(50)


@query("SELECT t.id, t.sender_account_id, a.country, a.status, t.amount FROM k_txn t JOIN k_account a ON a.id = t.sender_account_id")
def txn_with_sender(k):
    return k.txn.join(k.account.select(F.col("id").alias("sender_account_id"), "country", F.col("status").alias("st")), "sender_account_id").select("id", "sender_account_id", "country", F.col("st").alias("status"), "amount")


@query(
    """SELECT t.id, t.amount, t.sender_account_id, sa.country AS sender_country, sc.name AS sender_name, sc.pep_flag AS sender_pep, t.receiver_account_id, ra.country AS receiver_country, rc.name AS receiver_name,
    i.country AS ip_country, i.is_tor, m.mcc_code, b.country AS beneficiary_country
    FROM k_txn t JOIN k_account sa ON sa.id = t.sender_account_id LEFT JOIN k_customer sc ON sc.id = sa.customer_id LEFT JOIN k_account ra ON ra.id = t.receiver_account_id
    LEFT JOIN k_customer rc ON rc.id = ra.customer_id LEFT JOIN k_ip i ON i.ip = t.ip_id LEFT JOIN k_merchant m ON m.id = t.merchant_id LEFT JOIN k_beneficiary b ON b.id = t.beneficiary_id"""
)
def txn_context_all(k):
    return context(k).select("id", "amount", "sender_account_id", "sender_country", "sender_name", "sender_pep", "receiver_account_id", "receiver_country", "receiver_name", "ip_country", "is_tor", "mcc_code", "beneficiary_country")


@query(
    f"""SELECT count(*) AS total, {even("sum(amount)", 6)} AS volume, {even("avg(amount)", 6)} AS avg_amount, max(amount) AS max_amount, count(*) FILTER (is_fraud) AS fraud_count,
    {even("count(*) FILTER (is_fraud) / greatest(count(*), 1) * 100", 2)} AS fraud_pct, (SELECT count(*) FROM k_customer) AS customers, (SELECT count(*) FROM k_account) AS accounts FROM k_txn"""
)
def txn_stats(k):
    t = k.txn.agg(F.count("*").alias("total"), half_even(F.sum("amount"), 6).alias("volume"), half_even(F.avg("amount"), 6).alias("avg_amount"), F.max("amount").alias("max_amount"), count_if(F.col("is_fraud")).alias("fraud_count"),
        half_even(count_if(F.col("is_fraud")) / F.greatest(F.count("*"), F.lit(1)) * 100, 2).alias("fraud_pct"))
    return t.crossJoin(k.customer.agg(F.count("*").alias("customers"))).crossJoin(k.account.agg(F.count("*").alias("accounts")))  # one row each


@query("SELECT fraud_type, count(*) AS n FROM k_txn WHERE is_fraud GROUP BY 1")
def fraud_by_type(k):
    return k.txn.where("is_fraud").groupBy("fraud_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (is_fraud) AS fraud, count(*) FILTER (is_fraud) / count(*) AS rate FROM k_txn")
def class_balance(k):
    return k.txn.agg(F.count("*").alias("n"), count_if(F.col("is_fraud")).alias("fraud"), (count_if(F.col("is_fraud")) / F.count("*")).alias("rate"))


@query("SELECT max(ts) AS checkpoint FROM k_txn")
def max_txn_ts(k):
    return k.txn.agg(F.max("ts").alias("checkpoint"))


@query("SELECT id, ts, amount FROM k_txn WHERE ts > timestamp'2000-06-01 00:00:00'")
def delta_since(k):
    return k.txn.where("ts > timestamp_ntz'2000-06-01 00:00:00'").select("id", "ts", "amount")


@query(f"SELECT sender_account_id, count(*) AS n, {even('sum(amount)', 6)} AS total, count(*) FILTER (amount >= 9000 AND amount < 10000) AS structuring FROM k_txn WHERE ts >= timestamp'2000-01-01 00:00:00' GROUP BY 1")
def structuring_since(k):
    return velocity_since(k.txn, "2000-01-01 00:00:00").withColumn("total", half_even(F.col("total"), 6))


@query("SELECT a.id AS account_id FROM k_account a WHERE NOT EXISTS (SELECT 1 FROM k_txn t WHERE t.sender_account_id = a.id)")
def accounts_without_txns(k):
    return k.account.join(k.txn, F.col("sender_account_id") == k.account["id"], "left_anti").select(F.col("id").alias("account_id"))


@query("SELECT a.id AS account_id, c.name, a.balance FROM k_account a JOIN k_customer c ON c.id = a.customer_id WHERE a.status = 'ACTIVE' ORDER BY c.name, a.id LIMIT 100")
def active_accounts(k):
    own = k.customer.select(F.col("id").alias("customer_id"), "name")
    return k.account.where("status = 'ACTIVE'").join(own, "customer_id").orderBy("name", "id").select(F.col("id").alias("account_id"), "name", "balance").limit(100)


@query("SELECT t.id, t.amount, coalesce(a.balance, 0) AS balance, t.amount > coalesce(a.balance, 0) AS insufficient_funds FROM k_txn t LEFT JOIN k_account a ON a.id = t.sender_account_id")
def balance_check(k):
    b = F.coalesce("balance", F.lit(0.0))
    return k.txn.join(k.account.select(F.col("id").alias("sender_account_id"), "balance"), "sender_account_id", "left").select("id", "amount", b.alias("balance"), (F.col("amount") > b).alias("insufficient_funds"))


@query("SELECT c.id AS customer_id, c.name, c.risk_tier, count(a.id) AS accounts FROM k_customer c LEFT JOIN k_account a ON a.customer_id = c.id WHERE c.risk_tier = 'HIGH' GROUP BY ALL ORDER BY c.risk_tier DESC, c.name LIMIT 200")
def customer_list(k):
    n = k.account.groupBy("customer_id").agg(F.count("*").alias("accounts"))
    c = k.customer.where("risk_tier = 'HIGH'").select(F.col("id").alias("customer_id"), "name", "risk_tier")
    return c.join(n, "customer_id", "left").select("customer_id", "name", "risk_tier", F.coalesce("accounts", F.lit(0).cast("long")).alias("accounts")).orderBy(F.desc("risk_tier"), "name").limit(200)


@query("SELECT id AS customer_id, name FROM k_customer WHERE contains(lower(name), lower('99'))")
def customer_search(k):
    return k.customer.where(F.lower("name").contains(F.lower(F.lit("99")))).select(F.col("id").alias("customer_id"), "name")


@query("SELECT country_of_residence AS country, count(*) AS n FROM k_customer GROUP BY 1 ORDER BY n DESC, country LIMIT 10")
def customers_by_country(k):
    return k.customer.groupBy(F.col("country_of_residence").alias("country")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(10)


RISK_SQL = "CASE WHEN code IN ('IR','KP','SY') THEN 3 WHEN code IN ('MM','RU','VE','AF','PK','LA','TZ','YE') THEN 2 WHEN code IN ('KY','VG','PA','CH','MX','TR','UA','TH') THEN 1 ELSE 0 END"


@query(f"SELECT code, fatf_risk, {RISK_SQL} AS country_risk FROM k_country")
def country_risk_lookup(k):
    from tidemark.functions.risk import country_risk

    return k.country.select("code", "fatf_risk", country_risk(F.col("code")).alias("country_risk"))


@query("SELECT c_custkey % 2 = 0 AS even, n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY CUBE (even, n_name)")
def cube_counts(k):
    c = k.raw("customer").join(F.broadcast(k.raw("nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # nation has a fixed size
    return c.withColumn("even", F.col("c_custkey") % 2 == 0).cube("even", "n_name").agg(F.count("*").alias("n"))


SIDES = """sides AS (SELECT a.country AS code, t.amount, t.is_fraud, t.fraud_type FROM k_txn t JOIN k_account a ON a.id = t.sender_account_id
    UNION ALL SELECT a.country, t.amount, t.is_fraud, t.fraud_type FROM k_txn t JOIN k_account a ON a.id = t.receiver_account_id)"""


def _sides(k: Catalog) -> DataFrame:
    a = k.account.select("id", F.col("country").alias("code"))
    one = lambda key: k.txn.join(a, F.col(key) == a["id"]).select("code", "amount", "is_fraud", "fraud_type")
    return one("sender_account_id").unionByName(one("receiver_account_id"))


@query(
    f"""SELECT s.code, c.name, count(*) AS txn_count, {even("sum(amount)", 6)} AS volume, count(*) FILTER (is_fraud) AS fraud_count, coalesce(array_to_string(list_sort(list(DISTINCT fraud_type) FILTER (fraud_type IS NOT NULL)), ','), '') AS fraud_types,
    CASE WHEN c.fatf_risk = 'BLACKLIST' OR count(*) FILTER (is_fraud) / count(*) >= 0.25 THEN 'CRITICAL' WHEN c.fatf_risk = 'HIGH' OR count(*) FILTER (is_fraud) / count(*) >= 0.10 THEN 'HIGH'
    WHEN count(*) FILTER (is_fraud) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM sides s LEFT JOIN k_country c ON c.code = s.code GROUP BY s.code, c.name, c.fatf_risk""",
    SIDES,
)
def world_map(k):
    g = _sides(k).groupBy("code").agg(F.count("*").alias("txn_count"), half_even(F.sum("amount"), 6).alias("volume"), count_if(F.col("is_fraud")).alias("fraud_count"), F.array_join(F.array_sort(F.collect_set("fraud_type")), ",").alias("fraud_types"))
    rate = F.col("fraud_count") / F.col("txn_count")
    level = F.when((F.col("fatf_risk") == "BLACKLIST") | (rate >= 0.25), "CRITICAL").when((F.col("fatf_risk") == "HIGH") | (rate >= 0.10), "HIGH").when(F.col("fraud_count") > 0, "MEDIUM").otherwise("LOW")
    return g.join(k.country, "code", "left").select("code", "name", "txn_count", "volume", "fraud_count", "fraud_types", level.alias("risk_level"))


@query("SELECT fraud_type, sum(n) AS n FROM (SELECT code, count(*) FILTER (is_fraud) AS n, list(DISTINCT fraud_type) FILTER (fraud_type IS NOT NULL) AS types FROM sides GROUP BY code), unnest(types) AS u(fraud_type) GROUP BY 1", SIDES)
def fraud_pattern_distribution(k):
    g = _sides(k).groupBy("code").agg(count_if(F.col("is_fraud")).alias("n"), F.collect_set("fraud_type").alias("types"))
    return g.select(F.explode("types").alias("fraud_type"), "n").groupBy("fraud_type").agg(F.sum("n").alias("n"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_event(k):
    return k.raw("events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query("SELECT id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM k_log WHERE CAST(json_extract(props, '$.k') AS BIGINT) IS NOT NULL")
def json_decode(k):
    return k.log.select("id", F.from_json("props", "k long")["k"].alias("k")).where("k is not null")
