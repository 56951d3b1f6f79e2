"""The life of a fitted model: fitting, saving and loading with its metadata, growing on new rows, scoring beside another model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import boosting, huber, versions
from tidemark.operators.boosting import Boosted
from tidemark.operators.evaluation import average_precision, best_threshold, roc_auc, split
from tidemark.operators.huber import Huber
from tidemark.operators.tables import settled
from tidemark.operators.versions import PROMOTE_FROM

#: Rows of a window below which nothing is trained (a fixed value).
LEAST_ROWS = 500
METADATA = "kind string, feature_names array<string>, n_samples long, fraud_rate double, roc_auc double, avg_precision double, threshold double, training_scores array<int>"
#: Held-out scores kept with a model, by the order of a hash, to compare later scores with.
KEPT_SCORES = 500
KINDS = {"trees": boosting, "linear": huber}
Model = Boosted | Huber


def _kind(model: Model) -> str:
    return "trees" if isinstance(model, Boosted) else "linear"


def _keyed(df: DataFrame, features: list[str], key: str | None) -> tuple[DataFrame, str]:
    return (df, key) if key else (df.withColumn("__key", F.xxhash64(*features)), "__key")


def fit(df: DataFrame, features: list[str], label: str, kind: str = "linear", key: str | None = None, **how) -> Model:
    """A model of the probability of label (boolean); kind is linear or trees. Rows are dealt to samples by their key, by their features without one."""
    rows, own = _keyed(df, features, key)
    return KINDS[kind].fit(rows, own, features, label, **how)


def more(model: Model, df: DataFrame, label: str, key: str | None = None, **how) -> Model:
    """The model fitted further on df: trees by more rounds, a linear model by more epochs."""
    rows, own = _keyed(df, model.features, key)
    return KINDS[_kind(model)].more(model, rows, own, label, **how)


def scored(model: Model, df: DataFrame, key: str) -> DataFrame:
    """(key, probability, score 0 to 999)."""
    return KINDS[_kind(model)].scored(model, df, key)


def evaluated(model: Model, df: DataFrame, key: str, label: str) -> dict:
    """roc_auc and avg_precision over df, and the threshold with the largest F1; null where a class is missing."""
    rows = settled(scored(model, df, key).join(df.select(key, F.col(label).alias("y")), key).select(F.col("probability").alias("s"), "y"))
    return {
        "roc_auc": roc_auc(rows, "s", "y").first()["roc_auc"], "avg_precision": average_precision(rows, "s", "y").first()["avg_precision"], "threshold": best_threshold(rows, "s", "y").first()["threshold"],
    }


def save(model: Model, metadata: dict, folder: str, spark: SparkSession) -> None:
    """The model and its metadata under folder; metadata is a JSON table of one row, which is written last and tells that the model is whole."""
    KINDS[_kind(model)].save(model, f"{folder}/model", spark)
    own = metadata | {"kind": _kind(model)}
    spark.createDataFrame([tuple(own.get(f.name) for f in spark.createDataFrame([], METADATA).schema)], METADATA).coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")


def load(folder: str, spark: SparkSession) -> tuple[Model, dict]:
    meta = spark.read.schema(METADATA).json(f"{folder}/metadata").first()
    if meta is None:
        raise ValueError(f"no whole model in {folder}")
    return KINDS[meta["kind"]].load(f"{folder}/model", spark), meta.asDict()


def _finished(model: Model, parted: DataFrame, key: str, label: str, folder: str) -> dict:
    """Evaluate on the rows held out, save under folder; returns the metadata."""
    test = parted.where("is_test")
    n = parted.agg(F.count("*").alias("n"), F.avg(F.when(F.col(label), 1.0).otherwise(0.0)).alias("rate")).first()
    kept = [r["score"] for r in scored(model, test, key).orderBy(F.xxhash64(F.lit(5), key), key).limit(KEPT_SCORES).collect()]
    metadata = {"kind": _kind(model), "feature_names": model.features, "n_samples": n["n"], "fraud_rate": n["rate"], "training_scores": kept} | evaluated(model, test, key, label)
    save(model, metadata, folder, parted.sparkSession)
    return metadata


def train(df: DataFrame, key: str, features: list[str], label: str, folder: str, kind: str = "linear", **how) -> dict:
    """Fit on the rows of df that are not held out, evaluate on the others, save under folder; returns the metadata."""
    parted = settled(split(df, key, label))
    return _finished(fit(parted.where("not is_test"), features, label, kind, key, **how), parted, key, label, folder)


def train_all(df: DataFrame, key: str, features: list[str], label: str, folder: str, **how: dict) -> dict[str, dict]:
    """Every kind of model trained on df and saved under folder/<kind>; how: arguments by kind. Returns the metadata by kind."""
    return {kind: train(df, key, features, label, f"{folder}/{kind}", kind, **how.get(kind, {})) for kind in KINDS}


def retrain(df: DataFrame, key: str, features: list[str], label: str, folder: str, base_auc: float | None, force: bool = False, base: str | None = None, **how) -> dict:
    """Train on a window of rows; with base, the model saved there is fitted further instead. status: skipped (fewer than LEAST_ROWS rows, unless
    forced), promoted (roc_auc is PROMOTE_FROM of the baseline's at least, or there is none) or experimental."""
    n = df.count()
    if n < LEAST_ROWS and not force:
        return {"status": "skipped", "n_samples": n, "roc_auc": None}
    if base is None:
        metadata = train(df, key, features, label, folder, **how)
    else:
        parted = settled(split(df, key, label))
        model, _ = load(base, df.sparkSession)
        metadata = _finished(more(model, parted.where("not is_test"), label, key, **how), parted, key, label, folder)
    good = base_auc is None or (metadata["roc_auc"] or 0.0) >= base_auc * PROMOTE_FROM
    return {"status": "promoted" if good else "experimental", "n_samples": n, "roc_auc": metadata["roc_auc"]}


def incremental(df: DataFrame, key: str, label: str, at: str, folder: str, promote: bool = True, force: bool = False, **how) -> dict:
    """Fit the baseline version further on the rows of df that are newer than its last transaction, and register the result.

    folder holds the table of versions (folder/versions) and a model for each (folder/<version>); at is the time of a row. The new version is measured
    on the fifth of the new rows that is held out, beside the baseline on the same rows, and becomes the baseline if it is as good (PROMOTE_FROM),
    else experimental. Its last transaction is the newest row, from which the next run goes on. status: error without a baseline or its last
    transaction, skipped below LEAST_ROWS new rows unless forced, promoted or experimental.
    """
    spark = df.sparkSession
    table = versions.load(spark, f"{folder}/versions")
    base = table.where("status = 'baseline'").first()
    if base is None or base["last_txn_ts"] is None:
        return {"status": "error", "reason": "no baseline with a last transaction"}
    new = settled(df.where(F.col(at) > F.lit(base["last_txn_ts"])))
    n = new.agg(F.count("*").alias("n"), F.max(at).alias("last"), F.avg(F.when(F.col(label), 1.0).otherwise(0.0)).alias("rate")).first()
    if not n["n"] or n["n"] < LEAST_ROWS and not force:
        return {"status": "skipped", "n_new": n["n"], "since": base["last_txn_ts"]}
    model, meta = load(f"{folder}/{base['version_id']}", spark)
    parted = settled(split(new, key, label))
    before = evaluated(model, parted.where("is_test"), key, label)
    name = versions.next_version_id(table)
    after = _finished(more(model, parted.where("not is_test"), label, key, **how), parted, key, label, f"{folder}/{name}")
    row = (name, "candidate", None, n["n"], n["rate"], n["last"], "incremental", after["roc_auc"], after["avg_precision"], None)
    row = spark.createDataFrame([row], versions.SCHEMA).withColumn("trained_at", F.current_timestamp().cast("timestamp_ntz"))
    better = promote and (after["roc_auc"] or 0.0) >= (before["roc_auc"] or 0.0) * PROMOTE_FROM
    grown = versions.register(table, row)
    versions.save(versions.set_baseline(grown, name, "as good on new rows") if better else versions.set_experimental(grown, name), f"{folder}/versions")
    return {"status": "promoted" if better else "experimental", "version_id": name, "n_new": n["n"], "roc_auc": after["roc_auc"], "baseline_roc_auc": before["roc_auc"], "since": base["last_txn_ts"]}


def register_first(df: DataFrame, key: str, features: list[str], label: str, at: str, folder: str, kind: str = "trees", **how) -> dict:
    """Train on all rows of df, and register the model as a new version and baseline; returns the metadata."""
    spark = df.sparkSession
    table = versions.load(spark, f"{folder}/versions")
    name = versions.next_version_id(table)
    meta = train(df, key, features, label, f"{folder}/{name}", kind, **how)
    row = df.agg(F.max(F.col(at).cast("timestamp_ntz")).alias("last_txn_ts")).select(
        F.lit(name).alias("version_id"), F.lit("candidate").alias("status"), F.current_timestamp().cast("timestamp_ntz").alias("trained_at"), F.lit(meta["n_samples"]).cast("long").alias("n_samples"), F.lit(meta["fraud_rate"]).cast("double").alias("fraud_rate"),
        "last_txn_ts", F.lit("full").alias("training_type"), F.lit(meta["roc_auc"]).cast("double").alias("roc_auc"), F.lit(meta["avg_precision"]).cast("double").alias("avg_precision"), F.lit(None).cast("string").alias("promotion_reason"),
    )
    versions.save(versions.set_baseline(versions.register(table, row), name, "first of its kind"), f"{folder}/versions")
    return meta | {"version_id": name}


def shadow(df: DataFrame, key: str, baseline: Model, experimental: Model | None) -> DataFrame:
    """(key, score, shadow_score, difference): the baseline's score, which counts, and the experimental model's beside it, null where there is none."""
    own = scored(baseline, df, key).select(key, "score")
    if experimental is None:
        return own.withColumns({"shadow_score": F.lit(None).cast("int"), "difference": F.lit(None).cast("int")})
    other = scored(experimental, df, key).select(key, F.col("score").alias("shadow_score"))
    return own.join(other, key).withColumn("difference", F.col("shadow_score") - F.col("score"))
