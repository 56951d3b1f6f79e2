"""Model monitoring over a prediction log (id, transaction_id, ts, final_score, outcome, processing_time_ms, is_fraud_ground_truth)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.risk import alert_level, count_if, half_even
from tidemark.operators.quantiles import nearest_ranks

EPSILON = 1e-6


def outcome_distribution(log: DataFrame) -> DataFrame:
    return log.groupBy("outcome").agg(F.count("*").alias("n"))


def outcome_trend(log: DataFrame) -> DataFrame:
    """(day, allow, challenge, decline, total); a missing outcome counts as ALLOW."""
    o = F.coalesce("outcome", F.lit("ALLOW"))
    return log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(*(count_if(o == x).alias(x.lower()) for x in ("ALLOW", "CHALLENGE", "DECLINE")), F.count("*").alias("total"))


def bucket_stats(log: DataFrame, unit: str = "day", digits: int = 2) -> DataFrame:
    """By hour or day: counts, mean and nearest-rank percentiles of score and latency, which are null in a bucket without values."""
    pattern = "yyyy-MM-dd" if unit == "day" else "yyyy-MM-dd'T'HH:00"
    rows = log.select(F.date_format("ts", pattern).alias("bucket"), "final_score", "outcome", "processing_time_ms")
    stats = rows.groupBy("bucket").agg(
        F.count("*").alias("n"), half_even(F.avg("final_score"), digits).alias("avg_score"), *(count_if(F.col("outcome") == x).alias(x.lower()) for x in ("ALLOW", "CHALLENGE", "DECLINE")),
        half_even(F.avg("processing_time_ms"), digits).alias("avg_ms"),
    )
    for value, shares in (("final_score", {"p50": 0.5, "p95": 0.95}), ("processing_time_ms", {"p95_ms": 0.95})):
        ranks = nearest_ranks(rows, ["bucket"], value, shares).drop("n").withColumnRenamed("bucket", "__bucket")
        stats = stats.join(ranks, F.col("bucket").eqNullSafe(F.col("__bucket")), "left").drop("__bucket")
    return stats.select("bucket", "n", "avg_score", "p50", "p95", "allow", "challenge", "decline", "avg_ms", "p95_ms")


def performance(log: DataFrame) -> DataFrame:
    """Confusion matrix and rates of labelled rows; CHALLENGE and DECLINE are positive."""
    y, p = F.col("is_fraud_ground_truth"), F.col("outcome").isin("CHALLENGE", "DECLINE")
    n = log.where(y.isNotNull()).agg(count_if(y & p).alias("tp"), count_if(~y & p).alias("fp"), count_if(~y & ~p).alias("tn"), count_if(y & ~p).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    c = F.col
    precision, recall = share(c("tp"), c("tp") + c("fp")), share(c("tp"), c("tp") + c("fn"))
    return n.select(
        "tp", "fp", "tn", "fn", half_even(precision, 4).alias("precision"), half_even(recall, 4).alias("recall"), half_even(share(2 * precision * recall, precision + recall), 4).alias("f1"),
        half_even(share(c("fp"), c("fp") + c("tn")), 4).alias("fpr"), half_even(share(c("fn"), c("fn") + c("tp")), 4).alias("fnr"),
    )


def summary(log: DataFrame, as_of: str) -> DataFrame:
    """One row: totals, the last day's count, the last week's outcomes and decline rate, mean score and latency."""
    now = F.lit(as_of).cast("timestamp_ntz")
    day, week = F.col("ts") >= now - F.expr("interval '1' day"), F.col("ts") >= now - F.expr("interval '7' day")
    n7 = count_if(week)
    return log.agg(
        F.count("*").alias("total"), count_if(day).alias("last_24h"), *(count_if(week & (F.col("outcome") == x)).alias(f"{x.lower()}_7d") for x in ("ALLOW", "CHALLENGE", "DECLINE")),
        half_even(count_if(week & (F.col("outcome") == "DECLINE")) / F.greatest(n7, F.lit(1)) * 100, 2).alias("decline_rate_7d"), half_even(F.avg("final_score"), 1).alias("avg_score"), half_even(F.avg("processing_time_ms"), 1).alias("avg_ms"),
    )


def score_histogram(log: DataFrame) -> DataFrame:
    """(bucket 0 to 9, n): scores up to 100 are bucket 0, up to 200 bucket 1, all above 900 bucket 9."""
    b = F.greatest(F.lit(0), F.least(F.lit(9), F.ceil(F.col("final_score") / 100) - 1)).cast("int")
    return log.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def top_risk_factors(log: DataFrame, factors: Column, score: Column, most: int = 15) -> DataFrame:
    """(factor, n, avg_score) of the most frequent factors; ties by name."""
    rows = log.select(F.explode(factors).alias("factor"), score.alias("score"))
    out = rows.groupBy("factor").agg(F.count("*").alias("n"), half_even(F.avg("score"), 1).alias("avg_score"))
    return out.orderBy(F.desc("n"), "factor").limit(most)


def update_ground_truth(log: DataFrame, labels: DataFrame) -> DataFrame:
    """log with labels (transaction_id, is_fraud) set on all rows of a labelled transaction; the largest label wins where several differ."""
    new = labels.groupBy("transaction_id").agg(F.max("is_fraud").alias("__label"))
    return log.join(new, "transaction_id", "left").withColumn("is_fraud_ground_truth", F.coalesce("__label", "is_fraud_ground_truth")).drop("__label").select(log.columns)


# population stability


def _psi(bins: DataFrame, keys: list[str]) -> DataFrame:
    """PSI from (keys..., bucket, n_ref, n_cur), all buckets given; shares are clipped away from 0 and scaled to sum 1 again; no rows: even shares."""
    total = bins.groupBy(*keys).agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"), F.count("*").alias("k")) if keys else bins.agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"), F.count("*").alias("k"))
    rows = bins.join(total, keys) if keys else bins.crossJoin(F.broadcast(total))  # one row
    share = lambda n, t: F.greatest(F.when(t > 0, n / F.when(t > 0, t)).otherwise(1 / F.col("k")), F.lit(EPSILON))
    rows = rows.select(*keys, share(F.col("n_ref"), F.col("t_ref")).alias("p"), share(F.col("n_cur"), F.col("t_cur")).alias("q"))
    sums = rows.groupBy(*keys).agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.sum((F.col("q")) * F.log(F.col("q") / F.col("p"))).alias("a"), F.sum(F.col("p") * F.log(F.col("q") / F.col("p"))).alias("b"))
    # scaled: sum (q/sq - p/sp) * ln(q sp / (p sq)), with the constant ln(sp/sq) cancelling, as both scaled shares sum to 1
    return sums.select(*keys, (F.col("a") / F.col("sq") - F.col("b") / F.col("sp")).alias("psi"))


def score_psi(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(psi, level) of two tables' final_score over ten bins [0,100) ... [900,999]; other scores are left out."""
    bin_ = F.least(F.floor(F.col("final_score") / 100), F.lit(9)).cast("int")
    count = lambda df, name: df.where("final_score between 0 and 999").groupBy(bin_.alias("bucket")).agg(F.count("*").alias(name))
    spark = reference.sparkSession
    bins = spark.range(10).select(F.col("id").cast("int").alias("bucket")).join(count(reference, "n_ref"), "bucket", "left").join(count(current, "n_cur"), "bucket", "left").fillna(0)
    return _psi(bins, []).select(half_even(F.col("psi"), 6).alias("psi"), alert_level(F.col("psi")).alias("level"))


def drift_history(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(day, n, avg_score, psi, level, direction): for each day of current scores its distance to the reference's, as score_psi(), the level, and whether the mean
    went up, down or stayed."""
    bin_ = F.least(F.floor(F.col("final_score") / 100), F.lit(9)).cast("int")
    good = lambda df: df.where("final_score between 0 and 999")
    ref = good(reference).groupBy(bin_.alias("bucket")).agg(F.count("*").alias("n_ref"))
    rows = good(current).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "final_score", bin_.alias("bucket"))
    cur = rows.groupBy("day", "bucket").agg(F.count("*").alias("n_cur"))
    days = rows.groupBy("day").agg(F.count("*").alias("n"), F.avg("final_score").alias("mean"))
    every = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bucket"))
    psi = _psi(every.join(F.broadcast(ref), "bucket", "left").join(cur, ["day", "bucket"], "left").fillna(0), ["day"])  # ten rows
    before = good(reference).agg(F.avg("final_score").alias("ref_mean"))
    change = half_even(F.col("mean") - F.col("ref_mean"), 6)
    return days.join(psi, "day").crossJoin(before).select(
        "day", "n", half_even(F.col("mean"), 6).alias("avg_score"), half_even(F.col("psi"), 6).alias("psi"), alert_level(F.col("psi")).alias("level"), F.when(change > 0, "up").when(change < 0, "down").otherwise("same").alias("direction"),
    )


def latest_drift(history: DataFrame) -> DataFrame:
    """The newest row of drift_history()."""
    return history.orderBy(F.desc("day")).limit(1)


def feature_psi(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature, psi, level, ref_mean, cur_mean, drift) by feature column.

    Bins are ten equal ones over the reference's range, or the two values of a feature that is 0 or 1 throughout; current values outside are
    left out. A constant reference gives 0.
    """
    long = lambda df, side: df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("s"), F.lit(side).alias("side")).select("s.feature", "s.x", "side").where("x is not null")
    rows = long(reference, "ref").unionByName(long(current, "cur"))
    ref = F.col("side") == "ref"
    stats = rows.groupBy("feature").agg(F.min(F.when(ref, F.col("x"))).alias("lo"), F.max(F.when(ref, F.col("x"))).alias("hi"), F.bool_and(F.when(ref, F.col("x").isin(0.0, 1.0))).alias("binary"), F.avg(F.when(ref, F.col("x"))).alias("ref_mean"), F.avg(F.when(~ref, F.col("x"))).alias("cur_mean"))
    stats = stats.withColumn("k", F.when(F.col("binary"), 2).otherwise(10))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("k"))
    placed = rows.join(F.broadcast(stats.select("feature", "lo", "hi", "k")), "feature").where("x between lo and hi")  # a row for each feature
    placed = placed.select("feature", "side", F.least(F.floor((F.col("x") - F.col("lo")) / width), F.col("k") - 1).cast("int").alias("bucket")).where("bucket is not null")
    n = placed.groupBy("feature", "bucket").agg(count_if(ref).alias("n_ref"), count_if(~ref).alias("n_cur"))
    every = stats.where("hi > lo").select("feature", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bucket"))
    psi = _psi(every.join(n, ["feature", "bucket"], "left").fillna(0), ["feature"])
    out = stats.join(psi, "feature", "left").withColumn("psi", F.coalesce("psi", F.lit(0.0)))
    return out.select("feature", half_even(F.col("psi"), 6).alias("psi"), alert_level(F.col("psi")).alias("level"), half_even(F.col("ref_mean"), 6).alias("ref_mean"), half_even(F.col("cur_mean"), 6).alias("cur_mean"), half_even(F.col("cur_mean") - F.col("ref_mean"), 6).alias("drift"))


def drift_causes(score: DataFrame, by_feature: DataFrame, current: DataFrame) -> DataFrame:
    """(cause, severity): what of score_psi(), feature_psi() and the current log's declines is not OK."""
    n = current.agg(F.count("*").alias("n"), count_if(F.col("outcome") == "DECLINE").alias("d"))
    rate = F.col("d") / F.greatest("n", F.lit(1))
    cause = F.when(F.col("n") == 0, "NO_RECENT_PREDICTIONS").when(F.col("d") == 0, "NO_DECLINES").otherwise("DECLINE_RATE")
    severity = F.when((F.col("n") == 0) | (F.col("d") == 0), "WARNING").when(rate >= 0.35, "CRITICAL").when(rate > 0.20, "WARNING").otherwise("OK")
    rows = score.select(F.lit("SCORE_DISTRIBUTION").alias("cause"), F.col("level").alias("severity"))
    rows = rows.unionByName(by_feature.select(F.concat(F.lit("FEATURE:"), "feature").alias("cause"), F.col("level").alias("severity")))
    return rows.unionByName(n.select(cause.alias("cause"), severity.alias("severity"))).where("severity <> 'OK'")


def drift_report(score: DataFrame, by_feature: DataFrame, most: int = 10) -> DataFrame:
    """One row of score_psi() and feature_psi(): overall level, counts, the features that drift most."""
    top = F.slice(F.sort_array(F.collect_list(F.struct(F.col("psi"), F.col("feature"))), asc=False), 1, most)  # as many as there are features
    rows = by_feature.agg(F.max("psi").alias("max_psi"), count_if(F.col("level") == "CRITICAL").alias("n_critical"), count_if(F.col("level") == "WARNING").alias("n_warning"), F.transform(top, lambda s: s["feature"]).alias("top_features"))
    both = rows.crossJoin(score.select(F.col("psi").alias("score_psi")))  # one row each
    overall = F.greatest("score_psi", F.coalesce("max_psi", F.lit(0.0)))
    return both.select("score_psi", F.coalesce("max_psi", F.lit(0.0)).alias("max_psi"), alert_level(overall).alias("overall"), "n_critical", "n_warning", F.array_join("top_features", ",").alias("top_features"))
