"""Monitoring and model-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.risk import fits_band, half_even
from tidemark.operators import evaluation as E
from tidemark.operators import monitoring as M
from tidemark.plans.base import ORACLE_SQL, even, query
from tidemark.plans.scores import CONTEXT, FEATURES, full_context
from tidemark.sources.adapter import AS_OF, EVENTS_AS_OF

SPLIT = "2024-01-15 00:00:00"  # before: the reference of drift reports


@query("SELECT outcome, count(*) AS n FROM k_log GROUP BY 1")
def outcome_distribution(k):
    return M.outcome_distribution(k.log)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (outcome = 'ALLOW') AS allow, count(*) FILTER (outcome = 'CHALLENGE') AS challenge, count(*) FILTER (outcome = 'DECLINE') AS decline, count(*) AS total FROM k_log GROUP BY 1")
def outcome_trend(k):
    return M.outcome_trend(k.log)


def _buckets(pattern: str) -> str:
    rank = lambda x, share: f"list_sort(list({x}))[CAST(floor(count({x}) * CAST({share} AS DOUBLE)) AS INT) + 1]"
    return f"""SELECT strftime(ts, '{pattern}') AS bucket, count(*) AS n, {even("avg(final_score)", 8)} AS avg_score, {rank("final_score", 0.5)} AS p50, {rank("final_score", 0.95)} AS p95, count(*) FILTER (outcome = 'ALLOW') AS allow,
    count(*) FILTER (outcome = 'CHALLENGE') AS challenge, count(*) FILTER (outcome = 'DECLINE') AS decline, {even("avg(processing_time_ms)", 8)} AS avg_ms, {rank("processing_time_ms", 0.95)} AS p95_ms FROM k_log GROUP BY 1"""


@query(_buckets("%Y-%m-%d"))
def score_distribution_day(k):
    return M.bucket_stats(k.log, "day", digits=8)


@query(_buckets("%Y-%m-%dT%H:00"))
def score_distribution_hour(k):
    return M.bucket_stats(k.log, "hour", digits=8)


MATRIX = """m AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (y AND NOT p) AS fn
    FROM (SELECT is_fraud_ground_truth AS y, outcome IN ('CHALLENGE', 'DECLINE') AS p FROM k_log WHERE is_fraud_ground_truth IS NOT NULL)),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS re FROM m)"""


@query(
    f"""SELECT tp, fp, tn, fn, {even("pr", 4)} AS precision, {even("re", 4)} AS recall, {even("CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0::DOUBLE END", 4)} AS f1,
    {even("CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0::DOUBLE END", 4)} AS fpr, {even("CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0.0::DOUBLE END", 4)} AS fnr FROM r""",
    MATRIX,
)
def performance_metrics(k):
    return M.performance(k.log)


_WEEK = f"ts >= timestamp'{EVENTS_AS_OF}' - INTERVAL 7 DAY"


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (ts >= timestamp'{EVENTS_AS_OF}' - INTERVAL 1 DAY) AS last_24h, count(*) FILTER ({_WEEK} AND outcome = 'ALLOW') AS allow_7d, count(*) FILTER ({_WEEK} AND outcome = 'CHALLENGE') AS challenge_7d,
    count(*) FILTER ({_WEEK} AND outcome = 'DECLINE') AS decline_7d, {even(f"count(*) FILTER ({_WEEK} AND outcome = 'DECLINE') / greatest(count(*) FILTER ({_WEEK}), 1) * 100", 2)} AS decline_rate_7d,
    {even("avg(final_score)", 1)} AS avg_score, {even("avg(processing_time_ms)", 1)} AS avg_ms FROM k_log"""
)
def monitoring_summary(k):
    return M.summary(k.log, EVENTS_AS_OF)


@query("SELECT CAST(greatest(0, least(9, ceil(final_score / 100) - 1)) AS INT) AS bucket, count(*) AS n FROM k_log GROUP BY 1")
def score_histogram(k):
    return M.score_histogram(k.log)


def _factors(log):
    """A few named factors by key, as a log's risk_factors."""
    names = ["velocity", "round_amount", "night", "new_sender", "tor"]
    return F.filter(F.array(*(F.when(F.col("id") % (n + 2) == 0, F.lit(x)) for n, x in enumerate(names))), lambda x: x.isNotNull())


@query(
    """SELECT factor, count(*) AS n, CAST(round_even(avg(final_score), 1) AS DOUBLE) AS avg_score FROM (SELECT final_score, unnest(list_filter([CASE WHEN id % 2 = 0 THEN 'velocity' END, CASE WHEN id % 3 = 0 THEN 'round_amount' END, CASE WHEN id % 4 = 0 THEN 'night' END,
    CASE WHEN id % 5 = 0 THEN 'new_sender' END, CASE WHEN id % 6 = 0 THEN 'tor' END], lambda x: x IS NOT NULL)) AS factor FROM k_log) GROUP BY 1 ORDER BY n DESC, factor LIMIT 15"""
)
def top_risk_factors(k):
    return M.top_risk_factors(k.log, _factors(k.log), F.col("final_score"))


@query("SELECT l.id, coalesce(g.y, l.is_fraud_ground_truth) AS is_fraud_ground_truth FROM k_log l LEFT JOIN (SELECT id, bool_or(is_fraud) AS y FROM k_txn WHERE id % 2 = 0 GROUP BY 1) g ON g.id = l.transaction_id")
def update_ground_truth(k):
    labels = k.txn.where("id % 2 = 0").select(F.col("id").alias("transaction_id"), "is_fraud")
    return M.update_ground_truth(k.log, labels).select("id", "is_fraud_ground_truth")


@query("SELECT l.id, l.transaction_id, t.id IS NOT NULL AS linked FROM k_log l LEFT JOIN k_txn t ON t.id = l.transaction_id")
def prediction_links(k):
    t = k.txn.select(F.col("id").alias("transaction_id"), F.lit(True).alias("there"))
    return k.log.join(t, "transaction_id", "left").select("id", "transaction_id", F.coalesce("there", F.lit(False)).alias("linked"))


def _psi_of(bins: str, key: str = "") -> str:
    """DuckDB: the index from (key, bucket, r, c) with all buckets given."""
    by = f"PARTITION BY {key}" if key else ""
    group = f"GROUP BY {key}" if key else ""
    keys = f"{key}, " if key else ""
    share = lambda x: f"greatest(CASE WHEN sum({x}) OVER ({by}) > 0 THEN {x} / sum({x}) OVER ({by}) ELSE 1 / count(*) OVER ({by}) END, 1e-6)"
    return f"""(SELECT {keys}sum((q - p) * ln(q / p)) AS psi FROM (SELECT {keys}p / sum(p) OVER ({by}) AS p, q / sum(q) OVER ({by}) AS q FROM (SELECT {keys}{share("r")} AS p, {share("c")} AS q FROM {bins})) {group})"""


_LEVEL = "CASE WHEN {0} < 0.10 THEN 'OK' WHEN {0} < 0.20 THEN 'WARNING' ELSE 'CRITICAL' END"
SCORE_BINS = f"""score_bins AS (SELECT b AS bucket, coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM (SELECT range AS b FROM range(10)) LEFT JOIN
    (SELECT least(final_score // 100, 9) AS k, count(*) FILTER (ts < timestamp'{SPLIT}') AS r, count(*) FILTER (ts >= timestamp'{SPLIT}') AS c FROM k_log WHERE final_score BETWEEN 0 AND 999 GROUP BY 1) ON k = b),
    score AS (SELECT psi FROM {_psi_of("score_bins")})"""


def _sides(k):
    at = F.lit(SPLIT).cast("timestamp_ntz")
    return k.log.where(F.col("ts") < at), k.log.where(F.col("ts") >= at)


@query(f"SELECT {even('psi', 6)} AS psi, {_LEVEL.format('psi')} AS level FROM score", SCORE_BINS)
def score_psi(k):
    return M.score_psi(*_sides(k))


_DRIFTING = {"final_score": "CAST(final_score AS DOUBLE)", "is_view": "CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "constant": "3.0::DOUBLE", "id_mod": "CAST(id % 7 AS DOUBLE)"}
FEATURE_BINS = f"""long AS (SELECT feature, x, ts < timestamp'{SPLIT}' AS ref FROM ({" UNION ALL ".join(f"SELECT ts, '{n}' AS feature, {x} AS x FROM k_log" for n, x in _DRIFTING.items())})),
    fstats AS (SELECT feature, min(x) FILTER (ref) AS lo, max(x) FILTER (ref) AS hi, CASE WHEN bool_and(x IN (0, 1)) FILTER (ref) THEN 2 ELSE 10 END AS k, avg(x) FILTER (ref) AS ref_mean, avg(x) FILTER (NOT ref) AS cur_mean FROM long GROUP BY 1),
    placed AS (SELECT l.feature, ref, CAST(least(floor((x - lo) / ((hi - lo) / k)), k - 1) AS INT) AS bucket FROM long l JOIN fstats f ON f.feature = l.feature WHERE x BETWEEN lo AND hi AND hi > lo),
    every AS (SELECT feature, CAST(unnest(range(k)) AS INT) AS bucket FROM fstats WHERE hi > lo),
    fbins AS (SELECT e.feature, e.bucket, count(ref) FILTER (ref) AS r, count(ref) FILTER (NOT ref) AS c FROM every e LEFT JOIN placed p ON p.feature = e.feature AND p.bucket = e.bucket GROUP BY 1, 2),
    fpsi AS (SELECT f.*, coalesce(p.psi, 0) AS psi FROM fstats f LEFT JOIN {_psi_of("fbins", "feature")} p ON p.feature = f.feature)"""


def _features(k):
    view = F.when(F.col("event_type") == "view", 1.0).otherwise(0.0)
    return [side.select(F.col("final_score").cast("double").alias("final_score"), view.alias("is_view"), F.lit(3.0).alias("constant"), (F.col("id") % 7).cast("double").alias("id_mod")) for side in _sides(k)]


@query(f"SELECT feature, {even('psi', 6)} AS psi, {_LEVEL.format('psi')} AS level, {even('ref_mean', 6)} AS ref_mean, {even('cur_mean', 6)} AS cur_mean, {even('cur_mean - ref_mean', 6)} AS drift FROM fpsi", FEATURE_BINS)
def feature_psi(k):
    return M.feature_psi(*_features(k), list(_DRIFTING))


@query(
    f"""SELECT {even("s.psi", 6)} AS score_psi, {even("max(f.psi)", 6)} AS max_psi, {_LEVEL.format("greatest(max(f.psi), s.psi)")} AS overall, count(*) FILTER (f.psi >= 0.20) AS n_critical, count(*) FILTER (f.psi >= 0.10 AND f.psi < 0.20) AS n_warning,
    array_to_string(list(f.feature ORDER BY CAST(round_even(f.psi, 6) AS DOUBLE) DESC, f.feature DESC)[:10], ',') AS top_features FROM fpsi f, score s GROUP BY s.psi""",
    f"{SCORE_BINS}, {FEATURE_BINS}",
)
def drift_report(k):
    return M.drift_report(M.score_psi(*_sides(k)), M.feature_psi(*_features(k), list(_DRIFTING)))


@query(
    f"""SELECT cause, severity FROM (SELECT 'SCORE_DISTRIBUTION' AS cause, {_LEVEL.format("psi")} AS severity FROM score UNION ALL SELECT 'FEATURE:' || feature, {_LEVEL.format("psi")} FROM fpsi UNION ALL
    SELECT CASE WHEN n = 0 THEN 'NO_RECENT_PREDICTIONS' WHEN d = 0 THEN 'NO_DECLINES' ELSE 'DECLINE_RATE' END, CASE WHEN n = 0 OR d = 0 THEN 'WARNING' WHEN d / n >= 0.35 THEN 'CRITICAL' WHEN d / n > 0.20 THEN 'WARNING' ELSE 'OK' END
    FROM (SELECT count(*) AS n, count(*) FILTER (outcome = 'DECLINE') AS d FROM k_log WHERE ts >= timestamp'{SPLIT}')) WHERE severity <> 'OK'""",
    f"{SCORE_BINS}, {FEATURE_BINS}",
)
def drift_causes(k):
    return M.drift_causes(M.score_psi(*_sides(k)), M.feature_psi(*_features(k), list(_DRIFTING)), _sides(k)[1])


# scores against labels: the log's score, the label that its transaction carries

LABELLED = "labelled AS (SELECT final_score AS s, coalesce(is_fraud_ground_truth, false) AS y FROM k_log), by_s AS (SELECT s, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM labelled GROUP BY 1), ranked AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM by_s WINDOW w AS (ORDER BY s DESC))"


def _labelled(k):
    return k.log.select(F.col("final_score").alias("s"), F.coalesce("is_fraud_ground_truth", F.lit(False)).alias("y"))


@query(f"SELECT {even('sum(neg * (tp - pos) + neg * pos / 2) / (sum(pos) * sum(neg))', 6)} AS roc_auc FROM ranked", LABELLED)
def roc_auc(k):
    return E.roc_auc(_labelled(k), "s", "y").select(half_even(F.col("roc_auc"), 6).alias("roc_auc"))


@query(f"SELECT {even('sum(pos * tp / (tp + fp)) / sum(pos)', 6)} AS avg_precision FROM ranked", LABELLED)
def avg_precision(k):
    return E.average_precision(_labelled(k), "s", "y").select(half_even(F.col("avg_precision"), 6).alias("avg_precision"))


@query(f"SELECT s AS threshold, {even('2 * tp / (tp + fp + (SELECT sum(pos) FROM by_s))', 6)} AS f1 FROM ranked ORDER BY 2 * tp / (tp + fp + (SELECT sum(pos) FROM by_s)) DESC, s DESC LIMIT 1", LABELLED)
def pr_threshold(k):
    return E.best_threshold(_labelled(k), "s", "y").select("threshold", half_even(F.col("f1"), 6).alias("f1"))


_OF = "SELECT '{0}' AS class, hit / greatest(hit + wrong, 1) AS precision, hit / greatest(hit + missed, 1) AS recall, 2 * hit / greatest(2 * hit + wrong + missed, 1) AS f1, hit + missed AS support FROM (SELECT count(*) FILTER (c = {1} AND y = {1}) AS hit, count(*) FILTER (c = {1} AND y <> {1}) AS wrong, count(*) FILTER (c <> {1} AND y = {1}) AS missed FROM called)"
REPORT = f"called AS (SELECT s >= 400 AS c, y FROM labelled), classes AS ({_OF.format('legitimate', 'false')} UNION ALL {_OF.format('fraud', 'true')})"
_MEASURES = ("precision", "recall", "f1")


@query(
    f"""SELECT class, {", ".join(f"{even(m, 6)} AS {m}" for m in _MEASURES)}, support FROM (SELECT * FROM classes UNION ALL SELECT 'macro', {", ".join(f"avg({m})" for m in _MEASURES)}, CAST(sum(support) AS BIGINT) FROM classes
    UNION ALL SELECT 'weighted', {", ".join(f"sum({m} * support) / sum(support)" for m in _MEASURES)}, CAST(sum(support) AS BIGINT) FROM classes)""",
    f"{LABELLED}, {REPORT}",
)
def classification_report(k):
    out = E.classification_report(_labelled(k), "s", "y", 400)
    return out.withColumns({m: half_even(F.col(m), 6) for m in _MEASURES})


@query(f"SELECT id, {even(FEATURES['log_amount'], 6)} AS log_amount, CASE WHEN is_fraud THEN 6 ELSE 1 END AS proxy_n_1h, CASE WHEN is_fraud THEN 16 ELSE 2 END AS proxy_n_24h, amount >= 9000 AND amount < 10000 AS proxy_structuring FROM facts", CONTEXT)
def training_features_proxy(k):
    """Velocity stand-ins taken from the label, as a leak to compare with; the real windows are in txn_features."""
    c = full_context(k)
    return c.select(
        "id", half_even(F.log1p(F.when(F.col("amount_usd") != 0, F.col("amount_usd")).otherwise(F.col("amount"))), 6).alias("log_amount"), F.when(F.col("is_fraud"), 6).otherwise(1).alias("proxy_n_1h"),
        F.when(F.col("is_fraud"), 16).otherwise(2).alias("proxy_n_24h"), fits_band(F.col("amount")).alias("proxy_structuring"),
    )


@query("SELECT is_fraud, is_test, CASE WHEN is_test THEN t ELSE n - t END AS n FROM (SELECT is_fraud, count(*) AS n, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS t FROM k_txn GROUP BY 1) CROSS JOIN (VALUES (true), (false)) v(is_test)")
def stratified_split(k):
    out = E.split(k.txn.select("id", "is_fraud"), "id", "is_fraud")
    return out.groupBy("is_fraud", "is_test").agg(F.count("*").alias("n"))


@query()
def boosted_trees(k):
    from tidemark.operators.learning import gbt_scores
    from tidemark.operators.scoring import features

    return gbt_scores(features(full_context(k), AS_OF).join(k.txn.select("id", "is_fraud"), "id"), "id", list(FEATURES), "is_fraud", rounds=40)


@query()
def linear_svm(k):
    from tidemark.operators.learning import linear_scores
    from tidemark.operators.scoring import features

    return linear_scores(features(full_context(k), AS_OF).join(k.txn.select("id", "is_fraud"), "id"), "id", list(FEATURES), "is_fraud")


@query()
def trained_ensemble(k):
    """The Bayesian score and those of the two trained models, the outcome of all three, and how far they agree."""
    from tidemark.operators import scoring as S
    from tidemark.operators.learning import gbt_scores, linear_scores
    from tidemark.operators.tables import settled

    context = settled(full_context(k))
    rows = S.features(context, AS_OF).join(k.txn.select("id", "is_fraud"), "id")
    trees = gbt_scores(rows, "id", list(FEATURES), "is_fraud", rounds=20).select("id", F.col("score").alias("ml_score"))
    line = linear_scores(rows, "id", list(FEATURES), "is_fraud").select("id", F.col("score").alias("svm_score"))
    scored = S.bayesian(context, AS_OF).join(trees, "id").join(line, "id")
    value, words = S.agreement(F.array(*(F.col(c).cast("double") for c in ("bayesian_score", "ml_score", "svm_score"))))
    models = scored.select("id", "ml_score", "svm_score", value.alias("agreement"), words.alias("words"))
    return S.risk_outcome(scored, F.col("ml_score"), F.col("svm_score")).join(models, "id")


#: Epochs of the registered network; the operator's default is 60.
SAGE_EPOCHS = 12


@query()
def graph_mule_scores(k):
    from tidemark.operators import accounts as A
    from tidemark.operators import graph as G
    from tidemark.operators.learning import sage_scores
    from tidemark.operators.tables import settled
    from tidemark.plans.graphs import node_stats

    stats = node_stats(k)
    nodes = settled(A.graph_node_features(stats).join(A.mule_labels(stats).select("account_id", "is_mule"), "account_id"))
    return sage_scores(nodes, settled(G.induced_subgraph(nodes, k.txn)), [f"f{n}" for n in range(20)], "is_mule", epochs=SAGE_EPOCHS)


@query()
def graph_summary(k):
    from tidemark.operators import accounts as A
    from tidemark.plans.accounts import knn_anomaly

    return A.graph_summary(k.account, graph_mule_scores(k), knn_anomaly(k))


@query("SELECT CAST(round_even(avg(CASE WHEN (final_score >= 400) = coalesce(is_fraud_ground_truth, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 2) AS DOUBLE) AS agreement_pct, count(*) AS n FROM (SELECT * FROM k_log ORDER BY final_score DESC, id LIMIT 200)")
def log_against_truth(k):
    top = k.log.orderBy(F.desc("final_score"), "id").limit(200)
    same = F.coalesce(F.col("final_score") >= 400, F.lit(False)) == F.coalesce("is_fraud_ground_truth", F.lit(False))
    return top.agg(half_even(F.avg(F.when(same, 1.0).otherwise(0.0)) * 100, 2).alias("agreement_pct"), F.count("*").alias("n"))


@query("SELECT * FROM (" + ORACLE_SQL["feature_psi"] + ") WHERE psi > 0.05")
def drifting_features(k):
    return feature_psi(k).where("psi > 0.05")
