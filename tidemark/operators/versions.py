"""A table of model versions: at most one baseline and one experimental version, all others retired or candidates.

Every change gives a new table; save() writes it as the next numbered state of a folder, so a failed write leaves the last state as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.risk import half_even

SCHEMA = "version_id string, status string, trained_at timestamp_ntz, n_samples long, fraud_rate double, last_txn_ts timestamp_ntz, training_type string, roc_auc double, avg_precision double, promotion_reason string"
PROMOTE_FROM = 0.99


def _states(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [(x.getPath().getName(), fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))) for x in fs.listStatus(path)]
    return sorted(int(name[6:]) for name, whole in names if whole and name.startswith("state="))


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The newest whole state; no versions where there is none."""
    states = _states(spark, folder)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/state={states[-1]}") if states else spark.createDataFrame([], SCHEMA)


def save(versions: DataFrame, folder: str) -> None:
    """Write the next state; the states before it stay and can be read again."""
    states = _states(versions.sparkSession, folder)
    versions.coalesce(1).write.mode("overwrite").parquet(f"{folder}/state={(states[-1] if states else 0) + 1}")


def next_version_id(versions: DataFrame) -> str:
    """v1, v2 and so on; ids of another form don't count."""
    top = versions.agg(F.max(F.regexp_extract("version_id", r"^v(\d+)$", 1).try_cast("int"))).first()[0]
    return f"v{(top or 0) + 1}"


def register(versions: DataFrame, version: DataFrame) -> DataFrame:
    """versions with the rows of version, which take the place of those with the same id."""
    return versions.join(version.select("version_id"), "version_id", "left_anti").select(versions.columns).unionByName(version.select(versions.columns))


def _moved(versions: DataFrame, version_id: str, status: str) -> DataFrame:
    """version_id gets a status, and what held that status retires. An unknown id changes nothing else."""
    mine, held = F.col("version_id") == version_id, F.col("status") == status
    return versions.withColumn("status", F.when(mine, status).when(held, "retired").otherwise(F.col("status")))


def set_baseline(versions: DataFrame, version_id: str, reason: str = "manually promoted") -> DataFrame:
    return _moved(versions, version_id, "baseline").withColumn("promotion_reason", F.when(F.col("version_id") == version_id, reason).otherwise(F.col("promotion_reason")))


def set_experimental(versions: DataFrame, version_id: str) -> DataFrame:
    return _moved(versions, version_id, "experimental")


def retire(versions: DataFrame, version_id: str) -> DataFrame:
    return versions.withColumn("status", F.when(F.col("version_id") == version_id, "retired").otherwise(F.col("status")))


def compare(versions: DataFrame) -> DataFrame:
    """(version_id, status, auc_delta, n_samples_delta, would_promote) of each version against the baseline; no rows without a baseline.

    A version may be promoted if its AUC is PROMOTE_FROM of the baseline's at least; a missing AUC counts as 0.
    """
    auc = F.coalesce("roc_auc", F.lit(0.0))
    base = versions.where("status = 'baseline'").select(auc.alias("base_auc"), F.col("n_samples").alias("base_n")).limit(1)  # one row
    return versions.join(F.broadcast(base)).select(
        "version_id", "status", half_even(F.col("roc_auc") - F.col("base_auc"), 4).alias("auc_delta"), (F.col("n_samples") - F.col("base_n")).alias("n_samples_delta"), (auc >= F.col("base_auc") * PROMOTE_FROM).alias("would_promote")
    )
