"""Transaction context and trailing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.risk import fits_band


def txn_context(txn: DataFrame, account: DataFrame, customer: DataFrame, ip: DataFrame, merchant: DataFrame, beneficiary: DataFrame) -> DataFrame:
    """Each transaction with a known sender, and what is known of its sender, receiver, their owners, address, merchant and beneficiary.

    Joins are on keys; Spark broadcasts sides that its statistics show to be small.
    """

    def side(name: str) -> DataFrame:
        a = account.select(
            F.col("id").alias(f"{name}_account_id"), F.col("customer_id").alias(f"{name}_customer_id"), F.col("country").alias(f"{name}_country"),
            F.col("created_at").alias(f"{name}_created_at"), F.col("last_active").alias(f"{name}_last_active"), F.col("typical_transaction_size").alias(f"{name}_typical"), F.col("balance").alias(f"{name}_balance"),
        )
        c = customer.select(
            F.col("id").alias(f"{name}_customer_id"), F.col("name").alias(f"{name}_name"), F.col("pep_flag").alias(f"{name}_pep"), F.col("sanctions_flag").alias(f"{name}_sanctions"),
            F.col("risk_tier").alias(f"{name}_tier"),
        )
        return a.join(c, f"{name}_customer_id", "left")

    out = txn.join(side("sender"), "sender_account_id").join(side("receiver"), "receiver_account_id", "left")
    out = out.join(ip.select(F.col("ip").alias("ip_id"), F.col("country").alias("ip_country"), "is_vpn", "is_tor"), "ip_id", "left")
    out = out.join(merchant.select(F.col("id").alias("merchant_id"), "mcc_code", "risk_level"), "merchant_id", "left")
    return out.join(beneficiary.select(F.col("id").alias("beneficiary_id"), F.col("country").alias("beneficiary_country")), "beneficiary_id", "left")


WEEK = 7 * 86_400_000_000
#: Length of the slices of time by which a sender's rows are dealt to tasks, in microseconds; the longest window reaches into one slice before at most.
SLICE = 4 * WEEK


def trailing(seconds: int):
    """Rows of the sender in the time before a row: from `seconds` before, up to but not including its own time."""
    return Window.partitionBy("sender_account_id", "__slice").orderBy("__at").rangeBetween(-seconds * 1_000_000, -1)


def velocity(txn: DataFrame) -> DataFrame:
    """(id, sender_account_id, n_1h, n_24h, n_7d, sum_24h, sum_7d, structuring_24h): one sort by sender, slice and time serves all windows.

    A busy sender's rows go to one task a slice. Those of a slice's last seven days are also laid before the next slice, where they are counted
    but not returned, so each window is whole. Rows without a time see each other alone.
    """
    hour, day, week = trailing(3600), trailing(86_400), trailing(7 * 86_400)
    band = F.when(fits_band(F.col("amount")), 1)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    into = F.pmod(at, F.lit(SLICE))
    own = ((at - into) / SLICE).cast("long")
    dealt = txn.select("id", "sender_account_id", "amount", at.alias("__at"), F.explode(F.when(into >= SLICE - WEEK, F.array(own, own + 1)).otherwise(F.array(own))).alias("__slice"), own.alias("__own"))
    counted = dealt.select(
        "id", "sender_account_id", F.count("*").over(hour).alias("n_1h"), F.count("*").over(day).alias("n_24h"), F.count("*").over(week).alias("n_7d"),
        F.coalesce(F.sum("amount").over(day), F.lit(0.0)).alias("sum_24h"), F.coalesce(F.sum("amount").over(week), F.lit(0.0)).alias("sum_7d"), F.count(band).over(day).alias("structuring_24h"),
        F.col("__slice").eqNullSafe(F.col("__own")).alias("__kept"),
    )
    return counted.where("__kept").drop("__kept")


def velocity_since(txn: DataFrame, since: str) -> DataFrame:
    """(sender_account_id, n, total, structuring) of transactions from a time on."""
    recent = txn.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return recent.groupBy("sender_account_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.count(F.when(fits_band(F.col("amount")), 1)).alias("structuring"))
