"""What the operators share: the shared scratch folder, batches of texts, digests of keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a table that is broadcast, at most.
BROADCAST_BYTES = 8 << 20
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one machine's own serves only a session that runs on it alone."""
    conf = spark.sparkContext.getConf()
    if shared := conf.get("spark.checkpoint.dir"):
        return shared
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop(*dfs: DataFrame) -> None:
    """Delete tables made by cut() that no later plan reads."""
    for df in dfs:
        if path := getattr(df, "_tidemark_path", None):
            delete(df.sparkSession, path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def is_small(df: DataFrame) -> bool:
    """Whether the files of a table made by cut() are small enough to broadcast."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() <= BROADCAST_BYTES


def hint_small(df: DataFrame) -> DataFrame:
    """Broadcast a table made by cut() if its files are small; a larger one is left to a shuffled join."""
    return F.broadcast(df) if is_small(df) else df


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _delete_rest() -> None:
    for spark, path in list(_written):
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the JVM has gone already; the cluster cleans its checkpoint folder
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small; a batch is held in memory twice."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
