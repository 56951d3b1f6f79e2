"""The risk catalog over the star-schema test tables: one set of column expressions, read by Spark as DataFrames and by DuckDB as CTEs.

The test tables hold orders, customers, nations, suppliers and events. Categorical columns that they lack are derived from integer keys, so
both engines compute the same catalog. AS_OF stands for the present: analytics take it as a parameter and never read the clock.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-01-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

# Country codes of the 25 nations, in the order of n_nationkey.
COUNTRIES = ["US", "GB", "DE", "FR", "JP", "IR", "KP", "SY", "MM", "RU", "VE", "AF", "PK", "KY", "VG", "PA", "CH", "AE", "NG", "IN", "BR", "CN", "TR", "ZA", "MX"]
# Fraud pattern names.
FRAUD_TYPES = ["STRUCTURING", "SMURFING", "LAYERING", "ROUND_TRIP", "DORMANT_BURST", "HIGH_RISK_CORRIDOR", "RAPID_VELOCITY"]


def pick(key: str, values: list[str]) -> str:
    """SQL for the value at an integer key, modulo their number."""
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values)) + " END"


COUNTRY_OF = "CASE {} " + " ".join(f"WHEN {n} THEN '{c}'" for n, c in enumerate(COUNTRIES)) + " END"
HOUR_OF_DAY = "((o_orderkey * 7919) % 86400)"
IS_FRAUD = "(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"
SCORE = "least(999, CAST(floor(value * 10) AS INT))"

#: table -> (source, columns). {secs:x} adds x seconds to a timestamp, {days:x} x days, {ts:x} is a timestamp literal, {div} divides whole numbers.
TABLES: dict[str, tuple[str, list[str]]] = {
    "k_country": (
        "nation",
        [
            f"{COUNTRY_OF.format('n_nationkey')} AS code", "n_name AS name", f"{pick('n_regionkey', ['LOW', 'MEDIUM', 'HIGH', 'LOW', 'BLACKLIST'])} AS fatf_risk",
            "n_regionkey = 4 AND n_nationkey % 2 = 0 AS is_sanctioned", "n_nationkey BETWEEN 13 AND 16 AS is_tax_haven",
        ],
    ),
    "k_customer": (
        "customer",
        [
            "c_custkey AS id", "c_name AS name", f"{COUNTRY_OF.format('c_nationkey')} AS country_of_residence", f"{pick('c_custkey', ['BASIC', 'ENHANCED', 'SIMPLIFIED'])} AS kyc_level",
            "c_custkey % 37 = 0 AS pep_flag", "c_custkey % 101 = 0 AS sanctions_flag", f"{pick('c_custkey {div} 2', ['LOW', 'LOW', 'MEDIUM', 'LOW', 'HIGH', 'MEDIUM', 'CRITICAL'])} AS risk_tier",
            "CASE WHEN c_custkey % 5 = 0 THEN 'CORPORATE' ELSE 'INDIVIDUAL' END AS customer_type",
        ],
    ),
    "k_account": (
        "customer",
        [
            "c_custkey AS id", "c_custkey - c_custkey % 2 AS customer_id", f"{pick('c_custkey', ['CURRENT', 'SAVINGS', 'BUSINESS', 'CRYPTO', 'PREPAID'])} AS account_type", "c_acctbal AS balance",
            f"{COUNTRY_OF.format('c_nationkey')} AS country", "CASE WHEN c_custkey % 11 = 0 THEN 'FROZEN' WHEN c_custkey % 13 = 0 THEN 'CLOSED' ELSE 'ACTIVE' END AS status",
            "{ts:1995-01-01 00:00:00} + {days:c_custkey * 7 % 2180} AS created_at", "{ts:2000-06-01 00:00:00} + {days:c_custkey * 11 % 214} AS last_active",
            "abs(c_acctbal) * 4 AS average_monthly_volume", "abs(c_acctbal) AS typical_transaction_size",
        ],
    ),
    "k_txn": (
        "orders",
        [
            "o_orderkey AS id", "o_custkey AS sender_account_id",
            "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE ((((o_orderkey * 7919) % 10007) * ((o_orderkey * 7919) % 10007)) {div} 10007 * n_accounts) {div} 10007 END AS receiver_account_id",
            "CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey % 97 END AS beneficiary_id", "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 200 END AS merchant_id",
            "o_totalprice / 8 AS amount", "o_totalprice / 8 AS amount_usd", f"{pick('o_orderkey', ['WIRE', 'ACH', 'CARD', 'CRYPTO', 'CASH', 'INTERNAL'])} AS transaction_type",
            f"{pick('o_orderkey', ['ONLINE', 'MOBILE', 'BRANCH', 'ATM', 'API'])} AS channel", f"{pick('o_orderkey', ['COMPLETED', 'COMPLETED', 'PENDING', 'FLAGGED', 'FAILED'])} AS status",
            f"o_orderdate + {{secs:{HOUR_OF_DAY}}} AS ts", "CASE WHEN o_orderkey % 10 <> 9 THEN (o_custkey * 7919 + o_orderkey % 3) % 997 END AS device_id",
            "CASE WHEN o_orderkey % 9 <> 8 THEN (o_orderkey * 31) % 503 END AS ip_id", f"{IS_FRAUD} AS is_fraud", f"CASE WHEN {IS_FRAUD} THEN {pick('o_orderkey', FRAUD_TYPES)} END AS fraud_type",
        ],
    ),
    "k_ip": ("range503", [f"id AS ip, {COUNTRY_OF.format('id % 25')} AS country", "id % 5 = 0 AS is_vpn", "id % 23 = 0 AS is_tor"]),
    "k_merchant": ("range200", ["id", "CASE WHEN id % 10 = 0 THEN '7995' WHEN id % 10 = 1 THEN '6051' ELSE '5411' END AS mcc_code", "CASE WHEN id % 6 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level"]),
    "k_beneficiary": ("supplier", ["s_suppkey AS id", "s_name AS account_name", f"{COUNTRY_OF.format('s_nationkey')} AS country"]),
    "k_log": (
        "events",
        [
            "event_id AS id", "user_id AS transaction_id", "ts", f"{SCORE} AS final_score", f"CASE WHEN {SCORE} <= 399 THEN 'ALLOW' WHEN {SCORE} <= 699 THEN 'CHALLENGE' ELSE 'DECLINE' END AS outcome",
            "CASE event_type WHEN 'purchase' THEN true WHEN 'view' THEN false END AS is_fraud_ground_truth", "value AS processing_time_ms", "event_type", "props",
        ],
    ),
}


def _render(text: str, spark: bool) -> str:
    out, rest = "", text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        inside, _, rest = rest.partition("}")
        kind, _, x = inside.partition(":")
        out += before + {
            "div": "div" if spark else "//",
            "ts": f"timestamp_ntz'{x}'" if spark else f"timestamp'{x}'",
            "secs": f"make_dt_interval(0, 0, 0, {x})" if spark else f"to_seconds({x})",
            "days": f"make_dt_interval(CAST({x} AS INT))" if spark else f"to_days(CAST({x} AS INT))",
        }[kind]
    return out + rest


class Catalog:
    """The catalog's tables as lazy DataFrames over a folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _table(self, name: str) -> DataFrame:
        source, columns = TABLES[name]
        df = self.spark.range(int(source[5:])) if source.startswith("range") else self.raw(source)
        if name == "k_txn":
            df = df.join(F.broadcast(self.raw("customer").agg(F.count("*").alias("n_accounts"))))  # one row
        return df.selectExpr(*(_render(c, True) for column in columns for c in _split(column)))

    @cached_property
    def country(self) -> DataFrame:
        return self._table("k_country")

    @cached_property
    def customer(self) -> DataFrame:
        return self._table("k_customer").where("id % 2 = 0")

    @cached_property
    def account(self) -> DataFrame:
        return self._table("k_account")

    @cached_property
    def txn(self) -> DataFrame:
        return self._table("k_txn")

    @cached_property
    def ip(self) -> DataFrame:
        return self._table("k_ip")

    @cached_property
    def merchant(self) -> DataFrame:
        return self._table("k_merchant")

    @cached_property
    def beneficiary(self) -> DataFrame:
        return self._table("k_beneficiary")

    @cached_property
    def log(self) -> DataFrame:
        return self._table("k_log")


def _split(column: str) -> list[str]:
    return column.split(", ", 1) if column.startswith("id AS ip, ") else [column]


def oracle_tables() -> str:
    """CTEs that give DuckDB the same catalog."""
    out = []
    for name, (source, columns) in TABLES.items():
        if source.startswith("range"):
            source = f"(SELECT range AS id FROM range({source[5:]}))"
        elif name == "k_txn":
            source = "orders CROSS JOIN (SELECT count(*) AS n_accounts FROM customer)"
        where = " WHERE c_custkey % 2 = 0" if name == "k_customer" else ""
        out.append(f"{name} AS (SELECT {', '.join(_render(c, False) for c in columns)} FROM {source}{where})")
    return ", ".join(out)
