"""Account-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.risk import half_even
from tidemark.operators import accounts as A
from tidemark.operators import graph as G
from tidemark.operators.context import velocity
from tidemark.plans.base import even, query

EDGES = "edges AS (SELECT DISTINCT sender_account_id AS src, receiver_account_id AS dst FROM k_txn WHERE receiver_account_id IS NOT NULL)"
ENDS = """ends AS (SELECT sender_account_id AS account, id AS txn, receiver_account_id AS other FROM k_txn WHERE receiver_account_id IS NOT NULL
    UNION ALL SELECT receiver_account_id, id, sender_account_id FROM k_txn WHERE receiver_account_id IS NOT NULL AND receiver_account_id <> sender_account_id)"""


@query("SELECT src, dst FROM edges", EDGES)
def account_edges(k):
    return G.edges(k.txn)


@query("SELECT dst AS account_id, count(*) AS unique_senders FROM edges GROUP BY 1 HAVING count(*) >= 5", EDGES)
def fan_in(k):
    return G.fan_in(k.txn)


@query("SELECT a.sender_account_id AS account_id, a.receiver_account_id AS partner_id, count(*) AS round_trip_count FROM k_txn a JOIN k_txn b ON a.sender_account_id = b.receiver_account_id AND a.receiver_account_id = b.sender_account_id GROUP BY 1, 2")
def round_trip(k):
    return G.round_trips(k.txn)


@query(
    """SELECT t.id, count(a.id) AS round_trip_count FROM k_txn t LEFT JOIN (SELECT a.id, a.sender_account_id, least(a.ts, b.ts) AS first FROM k_txn a JOIN k_txn b ON a.sender_account_id = b.receiver_account_id
    AND a.receiver_account_id = b.sender_account_id) a ON a.sender_account_id = t.sender_account_id AND a.first >= t.ts - INTERVAL 48 HOUR GROUP BY t.id"""
)
def round_trip_48h(k):
    return G.round_trips_since(k.txn)


@query(
    """SELECT a.id AS account_id, CASE WHEN m >= 2 THEN 4 WHEN m >= 1 THEN 2 ELSE 1 END AS max_hops FROM k_account a LEFT JOIN
    (SELECT e.account, max(d.n) AS m FROM ends e JOIN (SELECT account, count(*) AS n FROM ends GROUP BY 1) d ON d.account = e.other GROUP BY 1) x ON x.account = a.id""",
    ENDS,
)
def network_hops(k):
    return G.network_hops(k.account, k.txn)


@query(
    """SELECT a.id AS account_id, count(DISTINCT r.other) AS connected_accounts FROM k_account a LEFT JOIN
    (SELECT account, other FROM ends UNION SELECT e.account, f.other FROM ends e JOIN ends f ON f.account = e.other AND f.txn <> e.txn) r ON r.account = a.id GROUP BY 1""",
    ENDS,
)
def connected_accounts(k):
    return G.connected_accounts(k.account, k.txn)


@query("SELECT t.id, greatest(coalesce(u.n, 1), 1) AS device_users FROM k_txn t LEFT JOIN (SELECT device_id, count(DISTINCT customer_id) AS n FROM k_txn JOIN k_account a ON a.id = sender_account_id GROUP BY 1) u ON u.device_id = t.device_id")
def shared_device(k):
    return G.shared_devices(k.txn, k.account)


USES = "uses AS (SELECT DISTINCT device_id, customer_id FROM k_txn JOIN k_account a ON a.id = sender_account_id WHERE device_id IS NOT NULL)"


def _as_text(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


@query(
    """SELECT customer_id, other_id, array_to_string(devices, ',') AS devices FROM (SELECT a.customer_id, b.customer_id AS other_id, list_sort(list(DISTINCT a.device_id)) AS devices,
    row_number() OVER (PARTITION BY a.customer_id ORDER BY count(DISTINCT a.device_id) DESC, b.customer_id) AS n FROM uses a JOIN uses b ON a.device_id = b.device_id AND a.customer_id <> b.customer_id GROUP BY 1, 2) WHERE n <= 15""",
    USES,
)
def shared_device_network(k):
    """Each customer's 15 closest others by shared devices, as a client shows them."""
    return G.closest_by_device(k.txn, k.account).withColumn("devices", _as_text(F.col("devices")))


@query("SELECT a.customer_id, b.customer_id AS other_id, array_to_string(list_sort(list(DISTINCT a.device_id)), ',') AS devices FROM uses a JOIN uses b ON a.device_id = b.device_id AND a.customer_id <> b.customer_id GROUP BY 1, 2", USES)
def shared_device_network_all(k):
    return G.shared_device_network(k.txn, k.account, shown=_as_text)


@query(
    """SELECT a.customer_id, b.customer_id AS other_id, 'SHARED_DEVICE' AS kind FROM uses a JOIN uses b ON a.device_id = b.device_id AND a.customer_id <> b.customer_id
    UNION SELECT s.customer_id, r.customer_id, 'COUNTERPARTY' FROM k_txn t JOIN k_account s ON s.id = t.sender_account_id JOIN k_account r ON r.id = t.receiver_account_id WHERE r.customer_id <> s.customer_id""",
    USES,
)
def network_connections(k):
    return G.network_connections(k.txn, k.account)


NODES = f"{EDGES}, nodes AS (SELECT id FROM k_account WHERE balance > 0), inside AS (SELECT src, dst FROM edges WHERE src <> dst AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)), graph AS (SELECT src, dst, count(*) AS weight FROM (SELECT src, dst FROM inside UNION ALL SELECT dst, src FROM inside) GROUP BY 1, 2)"


def _nodes(k):
    return k.account.where("balance > 0").select(F.col("id").alias("account_id"), F.col("balance").alias("h"))


@query("SELECT src, dst, weight FROM graph", NODES)
def induced_subgraph(k):
    return G.induced_subgraph(_nodes(k), k.txn)


@query(f"SELECT a.id AS account_id, {even('coalesce(sum(b.balance * g.weight) / sum(g.weight), 0)', 10)} AS nb_h FROM k_account a LEFT JOIN graph g ON g.src = a.id LEFT JOIN k_account b ON b.id = g.dst WHERE a.balance > 0 GROUP BY 1", NODES)
def neighbor_mean(k):
    return G.neighbour_mean(_nodes(k), G.induced_subgraph(_nodes(k), k.txn), ["h"]).withColumn("nb_h", half_even(F.col("nb_h"), 10))


WHOLE = f"{EDGES}, graph AS (SELECT src, dst, count(*) AS weight FROM (SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT dst, src FROM edges WHERE src <> dst) WHERE src IN (SELECT id FROM k_account) AND dst IN (SELECT id FROM k_account) GROUP BY 1, 2)"


def _all_nodes(k):
    return k.account.select(F.col("id").alias("account_id"), F.col("balance").alias("h"))


@query("SELECT src, dst, weight FROM graph", WHOLE)
def induced_subgraph_all(k):
    return G.induced_subgraph(_all_nodes(k), k.txn)


@query(f"SELECT a.id AS account_id, {even('coalesce(sum(b.balance * g.weight) / sum(g.weight), 0)', 10)} AS nb_h FROM k_account a LEFT JOIN graph g ON g.src = a.id LEFT JOIN k_account b ON b.id = g.dst GROUP BY 1", WHOLE)
def neighbor_mean_all(k):
    return G.neighbour_mean(_all_nodes(k), G.induced_subgraph(_all_nodes(k), k.txn), ["h"]).withColumn("nb_h", half_even(F.col("nb_h"), 10))


@query(
    f"""SELECT id, sender_account_id, count(*) OVER h AS n_1h, count(*) OVER d AS n_24h, count(*) OVER w AS n_7d, {even("coalesce(sum(amount) OVER d, 0)", 6)} AS sum_24h, {even("coalesce(sum(amount) OVER w, 0)", 6)} AS sum_7d,
    count(CASE WHEN amount >= 9000 AND amount < 10000 THEN 1 END) OVER d AS structuring_24h FROM k_txn WINDOW
    h AS (PARTITION BY sender_account_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    d AS (PARTITION BY sender_account_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
    w AS (PARTITION BY sender_account_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"""
)
def velocity_features(k):
    return velocity(k.txn).withColumns({"sum_24h": half_even(F.col("sum_24h"), 6), "sum_7d": half_even(F.col("sum_7d"), 6)})


NODE_STATS = """n_out AS (SELECT sender_account_id AS id, count(*) AS out_count, avg(amount_usd) AS avg_amount, sum(amount_usd) AS out_volume, count(*) FILTER (is_fraud) AS fraud_count, count(fraud_type) AS pattern_count,
    max(CASE WHEN is_fraud THEN amount_usd ELSE 0 END) AS max_fraud_amount, count(DISTINCT receiver_account_id) AS unique_receivers FROM k_txn WHERE receiver_account_id IS NOT NULL GROUP BY 1),
    n_in AS (SELECT receiver_account_id AS id, count(*) AS in_count, sum(amount_usd) AS in_volume, count(DISTINCT sender_account_id) AS unique_senders FROM k_txn WHERE receiver_account_id IS NOT NULL GROUP BY 1),
    nodes AS (SELECT a.id AS account_id, a.country, coalesce(out_count, 0) AS out_count, coalesce(in_count, 0) AS in_count, coalesce(avg_amount, 0) AS avg_amount, coalesce(out_volume, 0) AS out_volume, coalesce(in_volume, 0) AS in_volume,
    coalesce(fraud_count, 0) AS fraud_count, coalesce(pattern_count, 0) AS pattern_count, coalesce(max_fraud_amount, 0) AS max_fraud_amount, coalesce(unique_senders, 0) AS unique_senders, coalesce(unique_receivers, 0) AS unique_receivers,
    CASE a.account_type WHEN 'CURRENT' THEN 0 WHEN 'SAVINGS' THEN 1 WHEN 'BUSINESS' THEN 2 WHEN 'PREPAID' THEN 3 ELSE 4 END AS acct_type_enc, CASE c.kyc_level WHEN 'SIMPLIFIED' THEN 1 WHEN 'ENHANCED' THEN 2 ELSE 0 END AS kyc_enc,
    CASE c.risk_tier WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'CRITICAL' THEN 3 ELSE 0 END AS risk_tier_enc, coalesce(c.pep_flag, false) AS pep_flag, coalesce(c.sanctions_flag, false) AS sanctions_flag
    FROM k_account a LEFT JOIN k_customer c ON c.id = a.customer_id LEFT JOIN n_out o ON o.id = a.id LEFT JOIN n_in i ON i.id = a.id),
    rated AS (SELECT *, fraud_count / greatest(out_count, 1) AS fraud_ratio, CASE WHEN in_volume > 100 THEN out_volume / greatest(in_volume, 1) ELSE 0.0 END AS ptr,
    CASE WHEN out_count > 0 THEN greatest(0, least(1, 1 - unique_receivers / greatest(out_count, 1))) ELSE 0.0 END AS funnel, least(1.0, greatest(0.0, in_volume - out_volume) / greatest(in_volume, 1)) AS kept FROM nodes)"""


def node_stats(k):
    return A.graph_node_stats(k.account, k.customer, k.txn)


@query(f"SELECT account_id, country, out_count, in_count, {even('avg_amount', 8)} AS avg_amount, {even('out_volume', 8)} AS out_volume, {even('in_volume', 8)} AS in_volume, fraud_count, pattern_count, max_fraud_amount, unique_senders, unique_receivers, acct_type_enc, kyc_enc, risk_tier_enc, pep_flag, sanctions_flag FROM nodes", NODE_STATS)
def graph_node_stats(k):
    return node_stats(k).withColumns({c: half_even(F.col(c), 8) for c in ("avg_amount", "out_volume", "in_volume")})


@query(f"SELECT account_id, {even('fraud_ratio', 6)} AS fraud_ratio, {even('ptr', 6)} AS pass_through, unique_senders >= 5 AND ptr BETWEEN 0.7 AND 1.5 AND in_volume > 10000 AS is_structural, fraud_ratio >= 0.30 OR pattern_count >= 2 OR (unique_senders >= 5 AND ptr BETWEEN 0.7 AND 1.5 AND in_volume > 10000) AS is_mule FROM rated", NODE_STATS)
def mule_labels(k):
    return A.mule_labels(node_stats(k)).withColumns({c: half_even(F.col(c), 6) for c in ("fraud_ratio", "pass_through")})


@query("SELECT account_id FROM rated WHERE unique_senders >= 5 AND ptr BETWEEN 0.7 AND 1.5 AND in_volume > 10000", NODE_STATS)
def structural_mules(k):
    return A.mule_labels(node_stats(k)).where("is_structural").select("account_id")


_RISK = "CASE country " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in A.GRAPH_COUNTRY_RISK.items()) + " ELSE 0.2 END"
_F = [
    "least(out_count, 1000) / 1000", "least(in_count, 1000) / 1000", "least(avg_amount, 100000) / 100000", "least(out_volume, 1e7) / 1e7", "least(in_volume, 1e7) / 1e7", "fraud_ratio", "least(fraud_count, 50) / 50", "least(pattern_count, 20) / 20",
    "least(max_fraud_amount, 500000) / 500000", "acct_type_enc / 4", "kyc_enc / 2", "risk_tier_enc / 3", "CASE WHEN pep_flag THEN 1.0 ELSE 0.0 END", "CASE WHEN sanctions_flag THEN 1.0 ELSE 0.0 END", _RISK, "least(ptr, 5) / 5",
    "least(unique_senders / greatest(in_count, 1), 1)", "least(unique_receivers, 100) / 100", "funnel", "kept",
]


@query("SELECT account_id, " + ", ".join(f"{even(x, 6)} AS f{n}" for n, x in enumerate(_F)) + " FROM rated", NODE_STATS)
def graph_node_features(k):
    return A.graph_node_features(node_stats(k)).select("account_id", *(half_even(F.col(f"f{n}"), 6).alias(f"f{n}") for n in range(20)))


@query(
    """SELECT account_id, array_to_string(list_filter([CASE WHEN fraud_ratio >= 0.30 THEN 'HIGH_FRAUD_RATIO' END, CASE WHEN pattern_count >= 2 THEN 'FRAUD_PATTERN_MATCH' END,
    CASE WHEN unique_senders >= 5 AND ptr BETWEEN 0.7 AND 1.5 AND in_volume > 10000 THEN 'STRUCTURAL_RELAY' END, CASE WHEN unique_senders >= 5 THEN 'FAN_IN_COLLECTION' END, CASE WHEN ptr BETWEEN 0.7 AND 1.5 AND in_volume > 1000 THEN 'PASS_THROUGH_RELAY' END,
    CASE WHEN funnel >= 0.7 AND unique_senders >= 5 THEN 'FUNNEL_AGGREGATION' END, CASE WHEN kept < 0.15 AND in_volume > 5000 THEN 'ZERO_RETENTION' END], lambda x: x IS NOT NULL), ',') AS patterns FROM rated""",
    NODE_STATS,
)
def mule_patterns(k):
    return A.mule_patterns(node_stats(k)).withColumn("patterns", F.array_join("patterns", ","))


_SHOWN = [
    ("HIGH_FRAUD_RATIO", "fraud_ratio * 100", "fraud_ratio >= 0.30", 22), ("FRAUD_PATTERN_MATCH", "pattern_count", "pattern_count >= 2", 18), ("FAN_IN_COLLECTION", "unique_senders", "unique_senders >= 5", 18),
    ("PASS_THROUGH_RELAY", "ptr", "ptr BETWEEN 0.7 AND 1.5 AND in_volume > 1000", 16), ("FUNNEL_AGGREGATION", "funnel * 100", "funnel >= 0.7 AND unique_senders >= 5", 12),
    ("ZERO_RETENTION", "CASE WHEN in_volume > 0 THEN (in_volume - out_volume) / in_volume ELSE 1 END * 100", "in_volume > 5000 AND (in_volume - out_volume) / in_volume < 0.15", 8), ("HIGH_VOLUME", "out_volume", "out_volume > 100000", 4),
    ("HIGH_RISK_JURISDICTION", "country_risk * 100", "country_risk >= 0.3", 1), ("PEP_SANCTIONS", "CASE WHEN pep_flag OR sanctions_flag THEN 1 ELSE 0 END", "pep_flag OR sanctions_flag", 1),
]
_COUNTRY = "CASE country " + " ".join(f"WHEN '{c}' THEN {v}::DOUBLE" for c, v in A.EXPLAINED_COUNTRY_RISK.items()) + " ELSE 0.0::DOUBLE END"


@query(
    " UNION ALL ".join(f"SELECT account_id, {n} AS place, '{name}' AS feature, {even(value, 6)} AS value, {hit} AS triggered, {w} AS weight_pct, reason FROM explained" for n, (name, value, hit, w) in enumerate(_SHOWN)),
    f"""{NODE_STATS}, explained AS (SELECT *, {_COUNTRY} AS country_risk, CASE WHEN fraud_ratio >= 0.30 THEN 'HIGH_FRAUD_RATIO' WHEN pattern_count >= 2 THEN 'FRAUD_PATTERN_MATCH'
    WHEN unique_senders >= 5 AND ptr BETWEEN 0.7 AND 1.5 AND in_volume > 10000 THEN 'STRUCTURAL_RELAY' ELSE 'NEIGHBOURS' END AS reason FROM rated)""",
)
def mule_explanation(k):
    return A.mule_explanation(node_stats(k)).withColumn("value", half_even(F.col("value"), 6))


@query(
    """SELECT account_id, id, direction, ts FROM (SELECT *, row_number() OVER (PARTITION BY account_id, direction ORDER BY ts DESC, id) AS n FROM (SELECT sender_account_id AS account_id, id, 'OUT' AS direction, ts FROM k_txn WHERE is_fraud
    UNION ALL SELECT receiver_account_id, id, 'IN', ts FROM k_txn WHERE is_fraud AND receiver_account_id IS NOT NULL)) WHERE n <= CASE direction WHEN 'OUT' THEN 50 ELSE 20 END"""
)
def account_flagged_txns(k):
    from pyspark.sql import Window

    t = k.txn.where("is_fraud")
    rows = t.select(F.col("sender_account_id").alias("account_id"), "id", F.lit("OUT").alias("direction"), "ts").unionByName(t.where("receiver_account_id is not null").select(F.col("receiver_account_id").alias("account_id"), "id", F.lit("IN").alias("direction"), "ts"))
    n = F.row_number().over(Window.partitionBy("account_id", "direction").orderBy(F.desc("ts"), "id"))
    return rows.withColumn("n", n).where(F.col("n") <= F.when(F.col("direction") == "OUT", 50).otherwise(20)).drop("n")
