"""Seeded tables of any size for tests: accounts and transactions as hashes of row numbers, so that partitions come out alike wherever they run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.adapter import AS_OF, COUNTRIES, FRAUD_TYPES

#: Transactions of one case of each pattern (fixed values), in the order of FRAUD_TYPES.
LEGS = [5, 8, 4, 2, 3, 1, 10]


def _share(seed: int, *what) -> Column:
    """A number from 0 to 1 by a seeded hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(1 << 40)) / (1 << 40)


def _between(low: float, high: float, seed: int, *what) -> Column:
    return F.round(low + (high - low) * _share(seed, *what), 2)


def customers(spark: SparkSession, n: int, seed: int = 1, weights: list[float] | None = None) -> DataFrame:
    """(id long, country, risk_tier, pep_flag): n customers over the countries, by weights where given."""
    shares = weights or [1.0] * len(COUNTRIES)
    draw, upto, country = _share(seed, F.col("id")) * sum(shares), 0.0, F.lit(COUNTRIES[-1])
    bounds = []
    for c, w in zip(COUNTRIES, shares, strict=True):
        upto += w
        bounds.append((c, upto))
    for c, bound in reversed(bounds):
        country = F.when(draw < bound, c).otherwise(country)
    tier = _share(seed + 1, F.col("id"))
    return spark.range(n).select("id", country.alias("country"), F.when(tier < 0.7, "LOW").when(tier < 0.9, "MEDIUM").when(tier < 0.98, "HIGH").otherwise("CRITICAL").alias("risk_tier"), (_share(seed + 2, F.col("id")) < 0.03).alias("pep_flag"))


def accounts(owners: DataFrame, seed: int = 1) -> DataFrame:
    """(id long, customer_id, country, typical_transaction_size): one to three accounts for each customer; ids are unique."""
    number = F.explode(F.sequence(F.lit(0), F.floor(_share(seed + 3, F.col("id")) * 3).cast("int"))).alias("number")
    a = owners.select(F.col("id").alias("customer_id"), "country", number)
    return a.select((F.col("customer_id") * 3 + F.col("number")).alias("id"), "customer_id", "country", _between(50, 5000, seed + 4, F.col("customer_id"), F.col("number")).alias("typical_transaction_size"))


def transactions(spark: SparkSession, n: int, n_accounts: int, cases: int, seed: int = 1, as_of: str = AS_OF) -> DataFrame:
    """(id long, sender_account_id, receiver_account_id, amount, ts timestamp_ntz, is_fraud, fraud_type): cases of each pattern, filled up to n rows.

    Accounts are numbers below n_accounts; a caller maps them to its ids. STRUCTURING: one sender, five receivers, 9,000 to 9,999 within hours. SMURFING: eight
    senders, one receiver. LAYERING: a chain of four, amounts falling. ROUND_TRIP: out and back, 95 % of it. DORMANT_BURST: three
    large ones two hours apart. HIGH_RISK_CORRIDOR: to no account of ours. RAPID_VELOCITY: ten, four minutes apart. The others: random pairs in 30 days.
    """
    at, case, leg = F.lit(as_of).cast("timestamp_ntz"), F.col("case"), F.col("leg")
    who = lambda k, *what: F.floor(_share(seed + k, F.col("fraud_type"), *what) * n_accounts).cast("long")
    kinds = spark.range(cases * len(FRAUD_TYPES)).select((F.col("id") % len(FRAUD_TYPES)).cast("int").alias("kind"), F.floor(F.col("id") / len(FRAUD_TYPES)).alias("case"))
    named = kinds.withColumns({"fraud_type": F.element_at(F.array(*map(F.lit, FRAUD_TYPES)), F.col("kind") + 1), "legs": F.element_at(F.array(*map(F.lit, LEGS)), F.col("kind") + 1)})
    rows = named.withColumn("leg", F.explode(F.sequence(F.lit(0), F.col("legs") - 1)))
    one, each, chain = who(10, case), who(11, case, leg), who(12, case, leg + 1)
    is_ = lambda *names: F.col("fraud_type").isin(*names)
    before = F.when(leg == 0, one).otherwise(who(12, case, leg))
    sender = F.when(is_("SMURFING"), each).when(is_("LAYERING"), before).when(is_("ROUND_TRIP") & (leg == 1), who(13, case)).otherwise(one)
    receiver = F.when(is_("SMURFING"), one).when(is_("LAYERING"), chain).when(is_("ROUND_TRIP"), F.when(leg == 0, who(13, case)).otherwise(one)).when(~is_("HIGH_RISK_CORRIDOR"), each)
    start = F.col("fraud_type"), case
    amount = F.when(is_("STRUCTURING"), _between(9000, 9999, seed + 20, case, leg)).when(is_("SMURFING"), _between(1000, 4999, seed + 21, case, leg)).when(is_("LAYERING"), F.round(_between(20_000, 200_000, seed + 22, *start) * F.pow(F.lit(0.95), leg), 2))
    amount = amount.when(is_("ROUND_TRIP"), F.round(_between(10_000, 80_000, seed + 23, *start) * F.when(leg == 0, 1.0).otherwise(0.95), 2)).when(is_("DORMANT_BURST"), _between(15_000, 50_000, seed + 24, case, leg)).when(is_("HIGH_RISK_CORRIDOR"), _between(5_000, 100_000, seed + 25, case)).otherwise(_between(500, 2000, seed + 26, case, leg))
    minutes = F.when(is_("STRUCTURING"), 30).when(is_("SMURFING"), 300).when(is_("LAYERING"), 360).when(is_("ROUND_TRIP"), 1440).when(is_("DORMANT_BURST"), 120).otherwise(4)
    ago = F.floor(_share(seed + 30, *start) * 20 * 1440).cast("long") + 4 * 1440
    planted = rows.select(sender.alias("sender_account_id"), receiver.alias("receiver_account_id"), amount.alias("amount"), (at + F.make_dt_interval(mins=(minutes * leg - ago).cast("int"))).alias("ts"), F.lit(True).alias("is_fraud"), "fraud_type")
    own = F.col("id")
    fill = spark.range(max(0, n - cases * sum(LEGS))).select(
        F.floor(_share(seed + 40, own) * n_accounts).cast("long").alias("sender_account_id"), F.floor(_share(seed + 41, own) * n_accounts).cast("long").alias("receiver_account_id"), _between(25, 10_000, seed + 42, own).alias("amount"),
        (at - F.make_dt_interval(mins=F.floor(_share(seed + 43, own) * 30 * 1440).cast("int"))).alias("ts"), F.lit(False).alias("is_fraud"), F.lit(None).cast("string").alias("fraud_type"),
    )
    both = planted.unionByName(fill)
    return both.select(F.xxhash64(*both.columns, F.lit(seed)).alias("id"), *both.columns)
