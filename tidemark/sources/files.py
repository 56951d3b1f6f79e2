"""Files of transactions in and out, and changes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.risk import filled, parsed_number, truthy

CSV_COLUMNS = ["reference", "sender_account_id", "receiver_account_id", "amount", "currency", "transaction_type", "channel", "timestamp", "description", "is_fraud", "fraud_type"]
CSV_SCHEMA = ", ".join(f"{c} string" for c in CSV_COLUMNS)


def read_csv(spark: SparkSession, path: str, loaded_at: str) -> DataFrame:
    """Transactions of uploaded CSV files with a header; see parse_rows()."""
    return parse_rows(spark.read.schema(CSV_SCHEMA).option("header", True).csv(path), loaded_at)


def parse_rows(rows: DataFrame, loaded_at: str) -> DataFrame:
    """Texts of CSV_COLUMNS as transactions: amounts that are no number become 0, blanks their defaults, a blank or odd time the load time.

    Rows without a sender are dropped. A blank reference becomes one made from the row's content, so a repeated load gives it again.
    """
    c = F.col
    stamp = F.regexp_replace(F.trim("timestamp"), r"(Z|\+00:00)$", "")
    made = F.concat(F.lit("BLK"), F.upper(F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in CSV_COLUMNS)), 256), 1, 12)))
    return rows.where(filled(c("sender_account_id"), None).isNotNull()).select(
        F.coalesce(filled(c("reference"), None), made).alias("reference"), F.trim("sender_account_id").alias("sender_account_id"), filled(c("receiver_account_id"), None).alias("receiver_account_id"),
        parsed_number(c("amount")).alias("amount"), parsed_number(c("amount")).alias("amount_usd"), filled(c("currency"), "USD").alias("currency"), filled(c("transaction_type"), "WIRE").alias("transaction_type"), filled(c("channel"), "ONLINE").alias("channel"),
        F.coalesce(stamp.try_cast("timestamp_ntz"), F.lit(loaded_at).cast("timestamp_ntz")).alias("ts"), filled(c("description"), None).alias("description"), truthy(c("is_fraud")).alias("is_fraud"), filled(c("fraud_type"), None).alias("fraud_type"),
    )


def write_csv(txn: DataFrame, path: str) -> None:
    """Transactions as CSV files with a header, in the order of CSV_COLUMNS; columns that txn lacks are blank."""
    have = set(txn.columns)
    stamp = {"timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")} if "ts" in have else {}
    txn.select(*(stamp.get(c, F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in CSV_COLUMNS)).write.option("header", True).csv(path)


def stub_accounts(txn: DataFrame, account: DataFrame) -> DataFrame:
    """(id): senders and receivers that account does not hold."""
    ends = txn.select(F.col("sender_account_id").alias("id")).unionByName(txn.select(F.col("receiver_account_id").alias("id"))).where("id is not null").distinct()
    return ends.join(account.select("id"), "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in the place of those with the same key; the last of repeated new rows, by all their columns, wins."""
    order = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in new.columns if c != key))
    last = new.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return old.join(last.select(key), key, "left_anti").select(old.columns).unionByName(last, allowMissingColumns=True)


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, and those rows of new whose key it does not hold; of repeated new rows, the first by all their columns."""
    order = Window.partitionBy(key).orderBy(*(F.col(c).asc_nulls_last() for c in new.columns if c != key))
    first = new.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(new.columns), allowMissingColumns=True)


def set_column(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """df with column taken from changes (key, column), one row for each key, where these give a value."""
    new = changes.groupBy(key).agg(F.max(column).alias("__new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).select(df.columns)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n): keys held by several rows, and the null key; a table with a unique key gives none."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
