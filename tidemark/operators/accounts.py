"""Account and customer aggregates, each side aggregated by its own key before it is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.risk import capped, fits_band, flag, half_even, named, ratio, whole_days
from tidemark.operators.graph import internal

# Risk of an account's country for the graph features; 0.2 for all others.
GRAPH_COUNTRY_RISK = {
    "US": 0.0, "GB": 0.0, "DE": 0.0, "FR": 0.0, "CA": 0.0, "AU": 0.0, "SG": 0.0, "JP": 0.0, "KR": 0.0, "NZ": 0.0, "CH": 0.1, "IE": 0.0, "SE": 0.0, "NO": 0.0, "DK": 0.0, "FI": 0.0, "NL": 0.0, "BE": 0.0,
    "AT": 0.0, "PT": 0.0, "ES": 0.1, "IT": 0.1, "PL": 0.1, "HK": 0.2, "TW": 0.1, "CN": 0.3, "IN": 0.3, "BR": 0.4, "MX": 0.4, "AE": 0.4, "SA": 0.4, "TR": 0.4, "ZA": 0.4, "NG": 0.7, "KE": 0.4, "EG": 0.4,
    "RU": 0.8, "MM": 0.8, "VE": 0.8, "PK": 0.7, "AF": 0.9, "IR": 1.0, "KP": 1.0, "SY": 1.0, "KY": 0.6, "VG": 0.6, "PA": 0.5, "LU": 0.3, "MT": 0.3,
}


def _filled(df: DataFrame, *columns: str) -> DataFrame:
    return df.fillna(0, list(columns))


def account_stats(account: DataFrame, txn: DataFrame, since_30d: str) -> DataFrame:
    """(account_id, out_volume, avg_out, structuring, out_30d, in_volume, avg_in, unique_senders, avg_monthly_vol): 0 where there is nothing."""
    since = F.lit(since_30d).cast("timestamp_ntz")
    out = txn.groupBy(F.col("sender_account_id").alias("account_id")).agg(
        F.sum("amount_usd").alias("out_volume"), F.avg("amount_usd").alias("avg_out"), F.count(F.when(fits_band(F.col("amount")), 1)).alias("structuring"), F.count(F.when(F.col("ts") >= since, 1)).alias("out_30d")
    )
    into = txn.where("receiver_account_id is not null").groupBy(F.col("receiver_account_id").alias("account_id")).agg(F.sum("amount_usd").alias("in_volume"), F.avg("amount_usd").alias("avg_in"), F.countDistinct("sender_account_id").alias("unique_senders"))
    base = account.select(F.col("id").alias("account_id"), F.coalesce("average_monthly_volume", F.lit(0.0)).alias("avg_monthly_vol"))
    both = base.join(out, "account_id", "left").join(into, "account_id", "left")
    return _filled(both, "out_volume", "avg_out", "structuring", "out_30d", "in_volume", "avg_in", "unique_senders")


def rule_score(stats: DataFrame) -> DataFrame:
    """(account_id, pass_through_ratio, rule_score int, indicators) from account_stats()."""
    ptr = ratio(F.col("out_volume"), F.col("in_volume"))
    rules = [
        ("PASS_THROUGH", ptr.between(0.8, 1.2) & (F.col("in_volume") > 5000), 35), ("HIGH_SENDER_COUNT", F.col("unique_senders") >= 5, 25),
        ("STRUCTURING", F.col("structuring") >= 2, 25), ("RAPID_DISBURSEMENT", (F.col("out_30d") >= 10) & (ptr > 0.7), 15),
    ]
    score = sum((F.when(c, n).otherwise(0) for _, c, n in rules), F.lit(0))
    return stats.select("account_id", half_even(ptr, 3).alias("pass_through_ratio"), score.alias("rule_score"), named(*((n, c) for n, c, _ in rules)).alias("indicators"))


def account_vectors(stats: DataFrame) -> DataFrame:
    """account_id and eight capped numbers v0 to v7 from account_stats(); in_volume 0 counts as 1."""
    c = F.col
    into = F.when(c("in_volume") == 0, 1.0).otherwise(c("in_volume"))
    cap = lambda x, most: F.least(x.cast("double"), F.lit(float(most)))
    spread = cap(F.greatest(c("out_volume"), into) / F.greatest(F.least(c("out_volume"), into), F.lit(1.0)), 50)
    columns = [cap(ratio(c("out_volume"), into), 5), cap(c("unique_senders"), 100), cap(c("structuring"), 50), cap(c("out_30d"), 500), cap(c("avg_out"), 100_000), cap(c("avg_in"), 100_000), cap(c("avg_monthly_vol"), 1_000_000), spread]
    return stats.select("account_id", *(x.alias(f"v{n}") for n, x in enumerate(columns)))


def graph_node_stats(account: DataFrame, customer: DataFrame, txn: DataFrame) -> DataFrame:
    """Counts and sums of credited transactions by account, out and in, with coded categories."""
    t = internal(txn)
    out = t.groupBy(F.col("sender_account_id").alias("account_id")).agg(
        F.count("*").alias("out_count"), F.avg("amount_usd").alias("avg_amount"), F.sum("amount_usd").alias("out_volume"), F.count(F.when(F.col("is_fraud"), 1)).alias("fraud_count"),
        F.count("fraud_type").alias("pattern_count"), F.max(F.when(F.col("is_fraud"), F.col("amount_usd")).otherwise(0.0)).alias("max_fraud_amount"), F.countDistinct("receiver_account_id").alias("unique_receivers"),
    )
    into = t.groupBy(F.col("receiver_account_id").alias("account_id")).agg(F.count("*").alias("in_count"), F.sum("amount_usd").alias("in_volume"), F.countDistinct("sender_account_id").alias("unique_senders"))
    code = lambda x, names, other: sum((F.when(x == n, k).otherwise(0) for k, n in enumerate(names)), F.when(x.isin(*names), 0).otherwise(other))
    base = account.select(F.col("id").alias("account_id"), "customer_id", "country", code(F.col("account_type"), ["CURRENT", "SAVINGS", "BUSINESS", "PREPAID"], 4).alias("acct_type_enc"))
    owner = customer.select(F.col("id").alias("customer_id"), "kyc_level", "risk_tier", "pep_flag", "sanctions_flag")
    both = base.join(owner, "customer_id", "left").join(out, "account_id", "left").join(into, "account_id", "left")
    both = both.withColumns({
        "kyc_enc": code(F.coalesce("kyc_level", F.lit("BASIC")), ["BASIC", "SIMPLIFIED", "ENHANCED"], 0), "risk_tier_enc": code(F.coalesce("risk_tier", F.lit("LOW")), ["LOW", "MEDIUM", "HIGH", "CRITICAL"], 0),
        "pep_flag": F.coalesce("pep_flag", F.lit(False)), "sanctions_flag": F.coalesce("sanctions_flag", F.lit(False)),
    })
    both = _filled(both, "out_count", "avg_amount", "out_volume", "fraud_count", "pattern_count", "max_fraud_amount", "unique_receivers", "in_count", "in_volume", "unique_senders")
    return both.select(
        "account_id", "country", "out_count", "in_count", "avg_amount", "out_volume", "in_volume", "fraud_count", "pattern_count", "max_fraud_amount", "unique_senders", "unique_receivers",
        "acct_type_enc", "kyc_enc", "risk_tier_enc", "pep_flag", "sanctions_flag",
    )


def _pass_through(into: float = 100):
    return F.when(F.col("in_volume") > into, ratio(F.col("out_volume"), F.col("in_volume"))).otherwise(0.0)


def mule_labels(stats: DataFrame) -> DataFrame:
    """(account_id, fraud_ratio, pass_through, is_structural, is_mule) from graph_node_stats()."""
    fraud = ratio(F.col("fraud_count"), F.col("out_count"))
    structural = (F.col("unique_senders") >= 5) & _pass_through().between(0.7, 1.5) & (F.col("in_volume") > 10_000)
    return stats.select("account_id", fraud.alias("fraud_ratio"), _pass_through().alias("pass_through"), structural.alias("is_structural"), ((fraud >= 0.30) | (F.col("pattern_count") >= 2) | structural).alias("is_mule"))


def graph_node_features(stats: DataFrame) -> DataFrame:
    """account_id and the 20 node features f0 to f19 from graph_node_stats()."""
    c = F.col
    codes = F.create_map(*(F.lit(x) for kv in GRAPH_COUNTRY_RISK.items() for x in kv))
    funnel = F.when(c("out_count") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ratio(c("unique_receivers"), c("out_count"))))).otherwise(0.0)
    kept = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("in_volume") - c("out_volume")) / F.greatest(c("in_volume"), F.lit(1.0)))
    columns = [
        capped(c("out_count"), 1000), capped(c("in_count"), 1000), capped(c("avg_amount"), 100_000), capped(c("out_volume"), 1e7), capped(c("in_volume"), 1e7), ratio(c("fraud_count"), c("out_count")), capped(c("fraud_count"), 50),
        capped(c("pattern_count"), 20), capped(c("max_fraud_amount"), 500_000), c("acct_type_enc") / 4.0, c("kyc_enc") / 2.0, c("risk_tier_enc") / 3.0, flag(c("pep_flag")), flag(c("sanctions_flag")),
        F.coalesce(codes[c("country")], F.lit(0.2)), capped(_pass_through(), 5), F.least(ratio(c("unique_senders"), c("in_count")), F.lit(1.0)), capped(c("unique_receivers"), 100), funnel, kept,
    ]
    return stats.select("account_id", *(x.cast("double").alias(f"f{n}") for n, x in enumerate(columns)))


def mule_patterns(stats: DataFrame) -> DataFrame:
    """(account_id, patterns): badges of graph_node_stats() rows, in a fixed order."""
    c, ptr = F.col, _pass_through()
    funnel = F.when(c("out_count") > 0, 1 - ratio(c("unique_receivers"), c("out_count"))).otherwise(0.0)
    kept = F.greatest(F.lit(0.0), c("in_volume") - c("out_volume")) / F.greatest(c("in_volume"), F.lit(1.0))
    many = c("unique_senders") >= 5
    return stats.select("account_id", named(
        ("HIGH_FRAUD_RATIO", ratio(c("fraud_count"), c("out_count")) >= 0.30), ("FRAUD_PATTERN_MATCH", c("pattern_count") >= 2), ("STRUCTURAL_RELAY", many & ptr.between(0.7, 1.5) & (c("in_volume") > 10_000)),
        ("FAN_IN_COLLECTION", many), ("PASS_THROUGH_RELAY", ptr.between(0.7, 1.5) & (c("in_volume") > 1000)), ("FUNNEL_AGGREGATION", (funnel >= 0.7) & many), ("ZERO_RETENTION", (kept < 0.15) & (c("in_volume") > 5000)),
    ).alias("patterns"))


# Risk of an account's country as explanations show it; 0 for all others.
EXPLAINED_COUNTRY_RISK = {
    "IR": 1.0, "KP": 1.0, "SY": 1.0, "RU": 0.8, "MM": 0.8, "VE": 0.8, "NG": 0.7, "PK": 0.7, "CN": 0.3, "IN": 0.3, "AE": 0.4, "SA": 0.4, "TR": 0.4, "ZA": 0.4, "BR": 0.4, "MX": 0.4, "KY": 0.6, "PA": 0.5,
}


def mule_explanation(stats: DataFrame) -> DataFrame:
    """(account_id, place, feature, value, triggered, weight_pct, reason): nine rows an account, from graph_node_stats().

    Shares are in percent; a flag's value is 1 or 0. reason is the first rule that makes the account a mule, or NEIGHBOURS where none does.
    """
    c, ptr = F.col, _pass_through()
    codes = F.create_map(*(F.lit(x) for kv in EXPLAINED_COUNTRY_RISK.items() for x in kv))
    fraud, many = ratio(c("fraud_count"), c("out_count")), c("unique_senders") >= 5
    funnel = F.when(c("out_count") > 0, 1 - ratio(c("unique_receivers"), c("out_count"))).otherwise(0.0)
    kept = F.when(c("in_volume") > 0, (c("in_volume") - c("out_volume")) / F.greatest(c("in_volume"), F.lit(1e-9))).otherwise(1.0)
    country = F.coalesce(codes[c("country")], F.lit(0.0))
    listed = c("pep_flag") | c("sanctions_flag")
    shown = [
        ("HIGH_FRAUD_RATIO", fraud * 100, fraud >= 0.30, 22), ("FRAUD_PATTERN_MATCH", c("pattern_count"), c("pattern_count") >= 2, 18), ("FAN_IN_COLLECTION", c("unique_senders"), many, 18),
        ("PASS_THROUGH_RELAY", ptr, ptr.between(0.7, 1.5) & (c("in_volume") > 1000), 16), ("FUNNEL_AGGREGATION", funnel * 100, (funnel >= 0.7) & many, 12), ("ZERO_RETENTION", kept * 100, (kept < 0.15) & (c("in_volume") > 5000), 8),
        ("HIGH_VOLUME", c("out_volume"), c("out_volume") > 100_000, 4), ("HIGH_RISK_JURISDICTION", country * 100, country >= 0.3, 1), ("PEP_SANCTIONS", flag(listed), listed, 1),
    ]
    structural = many & ptr.between(0.7, 1.5) & (c("in_volume") > 10_000)
    reason = F.when(fraud >= 0.30, "HIGH_FRAUD_RATIO").when(c("pattern_count") >= 2, "FRAUD_PATTERN_MATCH").when(structural, "STRUCTURAL_RELAY").otherwise("NEIGHBOURS")
    rows = F.array(*(F.struct(F.lit(n).alias("place"), F.lit(name).alias("feature"), value.cast("double").alias("value"), hit.alias("triggered"), F.lit(w).alias("weight_pct")) for n, (name, value, hit, w) in enumerate(shown)))
    return stats.select("account_id", reason.alias("reason"), F.inline(rows)).select("account_id", "place", "feature", "value", "triggered", "weight_pct", "reason")


def graph_summary(account: DataFrame, graph_scores: DataFrame, neighbour_scores: DataFrame) -> DataFrame:
    """One row (total, scored, suspects, high_confidence, flagged_by_both, coverage_pct).

    graph_scores: (account_id, probability, score), a suspect from probability 0.5; neighbour_scores: (account_id, is_mule_suspect).
    """
    ids = account.select(F.col("id").alias("account_id"))
    all_ = ids.join(graph_scores.select("account_id", "probability", "score"), "account_id", "left").join(neighbour_scores.select("account_id", "is_mule_suspect"), "account_id", "left")
    suspect = F.col("probability") >= 0.5
    scored = F.count("score")
    return all_.agg(
        F.count("*").alias("total"), scored.alias("scored"), F.count(F.when(suspect, 1)).alias("suspects"), F.count(F.when(F.col("score") >= 80, 1)).alias("high_confidence"),
        F.count(F.when(suspect & F.col("is_mule_suspect"), 1)).alias("flagged_by_both"), half_even(scored / F.greatest(F.count("*"), F.lit(1)) * 100, 1).alias("coverage_pct"),
    )


def feature_snapshot(account: DataFrame, customer: DataFrame, txn: DataFrame, ip: DataFrame, log: DataFrame, as_of: str, since: str) -> DataFrame:
    """30-day snapshot by account with its composite mule score; log (transaction_id, final_score, outcome) gives past evaluations."""
    now, start = (F.lit(x).cast("timestamp_ntz") for x in (as_of, since))
    recent = txn.where(F.col("ts") >= start)
    net = ip.select(F.col("ip").alias("ip_id"), "is_vpn", "is_tor")
    out = recent.join(net, "ip_id", "left").groupBy(F.col("sender_account_id").alias("account_id")).agg(
        F.count("*").alias("out_count"), F.sum("amount").alias("out_volume"), F.count(F.when(fits_band(F.col("amount")), 1)).alias("structuring_count"), F.count(F.when(F.col("is_vpn"), 1)).alias("vpn_count"),
        F.count(F.when(F.col("is_tor"), 1)).alias("tor_count"), F.countDistinct("receiver_account_id").alias("unique_receivers"),
    )
    into = recent.where("receiver_account_id is not null").groupBy(F.col("receiver_account_id").alias("account_id")).agg(F.count("*").alias("in_count"), F.sum("amount").alias("in_volume"), F.countDistinct("sender_account_id").alias("unique_senders"))
    seen = txn.select(F.col("id").alias("transaction_id"), F.col("sender_account_id").alias("account_id")).join(log.select("transaction_id", "final_score", "outcome"), "transaction_id")
    past = seen.groupBy("account_id").agg(F.count("*").alias("evaluation_count"), F.avg("final_score").alias("avg_score"), F.max("final_score").alias("max_score"), F.count(F.when(F.col("outcome") == "DECLINE", 1)).alias("decline_count"))
    base = account.select(F.col("id").alias("account_id"), "customer_id", "created_at", "last_active").join(customer.select(F.col("id").alias("customer_id"), "risk_tier", "pep_flag"), "customer_id", "left")
    all_ = base.join(out, "account_id", "left").join(into, "account_id", "left").join(past, "account_id", "left")
    all_ = _filled(all_, "out_count", "out_volume", "structuring_count", "vpn_count", "tor_count", "unique_receivers", "in_count", "in_volume", "unique_senders", "evaluation_count", "avg_score", "max_score", "decline_count")
    turnover = ratio(F.col("out_volume"), F.col("in_volume"))
    all_ = all_.withColumns({
        "turnover_ratio": turnover, "account_age_days": F.coalesce(whole_days(F.col("created_at"), now), F.lit(0)), "is_dormant": F.coalesce(whole_days(F.col("last_active"), now) > 90, F.lit(False)),
        "is_pass_through": turnover.between(0.7, 1.3) & (F.col("in_volume") > 1000), "has_tor_activity": F.col("tor_count") > 0,
    })
    score = (
        F.when(F.col("is_pass_through"), 30).otherwise(0) + F.when(F.col("unique_senders") > 5, 20).otherwise(0) + F.when(F.col("structuring_count") >= 2, 15).otherwise(0) + F.when(F.col("is_dormant"), 10).otherwise(0)
        + F.when(F.col("has_tor_activity"), 20).otherwise(0) + F.when(ratio(F.col("decline_count"), F.col("evaluation_count")) > 0.3, 5).otherwise(0)
    )
    return all_.withColumn("mule_score", F.least(score, F.lit(100))).withColumn("is_likely_mule", F.col("mule_score") >= 50)


def customer_mule_indicators(account: DataFrame, txn: DataFrame, as_of: str, since: str) -> DataFrame:
    """30-day indicators and score by customer, over all its accounts."""
    now, start = (F.lit(x).cast("timestamp_ntz") for x in (as_of, since))
    owner = account.select(F.col("id").alias("account_id"), "customer_id")
    recent = txn.where(F.col("ts") >= start)
    out = recent.join(owner.withColumnRenamed("account_id", "sender_account_id"), "sender_account_id").groupBy("customer_id").agg(F.sum("amount").alias("outbound"), F.count(F.when(fits_band(F.col("amount")), 1)).alias("structuring"))
    into = recent.join(owner.withColumnRenamed("account_id", "receiver_account_id"), "receiver_account_id").groupBy("customer_id").agg(F.sum("amount").alias("inbound"), F.countDistinct("sender_account_id").alias("unique_senders"))
    base = account.groupBy("customer_id").agg(F.count(F.when(whole_days(F.col("last_active"), now) > 90, 1)).alias("dormant_accounts"))
    all_ = _filled(base.join(out, "customer_id", "left").join(into, "customer_id", "left"), "outbound", "structuring", "inbound", "unique_senders")
    turnover = ratio(F.col("outbound"), F.col("inbound"))
    passes, rapid = turnover.between(0.7, 1.3) & (F.col("inbound") > 1000), (turnover > 0.8) & (F.col("outbound") > 5000)
    score = (
        F.when(passes, 30).otherwise(0) + F.when(F.col("unique_senders") > 5, 20).otherwise(0) + F.when(rapid, 25).otherwise(0) + F.when(F.col("structuring") >= 2, 15).otherwise(0) + F.when(F.col("dormant_accounts") > 0, 10).otherwise(0)
    )
    return all_.select("customer_id", "inbound", "outbound", turnover.alias("turnover_ratio"), passes.alias("is_pass_through"), "unique_senders", rapid.alias("rapid_disbursement"), "dormant_accounts", "structuring", score.alias("mule_score"), (score >= 50).alias("is_likely_mule"))


__all__ = ["account_stats", "account_vectors", "customer_mule_indicators", "feature_snapshot", "graph_node_features", "graph_node_stats", "graph_summary", "mule_explanation", "mule_labels", "mule_patterns", "rule_score"]
