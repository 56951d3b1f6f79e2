"""Tables with a key of one or more columns that are changed in place by buckets.

Rows are stored by a hash of their key. A merge rewrites the buckets that hold a key of the new rows and leaves the files of all others. What a table
consists of is told by its newest whole state, which is written last: readers see the table before or after a merge, and a merge that fails changes
nothing. States remember the last batch of each writer, so a batch that is repeated after a failure is merged once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

#: Buckets of a new table.
BUCKETS = 64


@dataclass(frozen=True)
class State:
    """versions: the version in which each bucket with rows was written last; batches: the last batch of each writer."""

    number: int
    keys: list[str]
    buckets: int
    schema: str
    versions: dict[int, int]
    batches: dict[str, int]


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the whole subfolders <prefix><number>, in order."""
    path, fs = _fs(spark, folder)
    if not fs.exists(path):
        return []
    names = [x.getPath() for x in fs.listStatus(path)]
    whole = [p.getName() for p in names if p.getName().startswith(prefix) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[len(prefix) :]) for n in whole)


def state(spark: SparkSession, folder: str) -> State | None:
    """The newest whole state; None where there is no table."""
    numbers = _numbers(spark, f"{folder}/states", "state=")
    if not numbers:
        return None
    own = json.loads(spark.read.schema("state string").parquet(f"{folder}/states/state={numbers[-1]}").first()[0])
    return State(**(own | {"versions": {int(k): v for k, v in own["versions"].items()}}))


def _put(spark: SparkSession, folder: str, new: State) -> None:
    spark.createDataFrame([(json.dumps(new.__dict__),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/states/state={new.number}")


def _read(spark: SparkSession, folder: str, own: State, buckets: list[int]) -> DataFrame:
    paths = [f"{folder}/data/version={own.versions[b]}/bucket={b}" for b in buckets if b in own.versions]
    schema = StructType.fromJson(json.loads(own.schema))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The table's rows. ValueError where there is none."""
    own = state(spark, folder)
    if own is None:
        raise ValueError(f"no table in {folder}")
    return _read(spark, folder, own, list(own.versions))


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """The table's rows with a key of keys (key columns), read from their buckets alone."""
    spark = keys.sparkSession
    own = state(spark, folder)
    if own is None:
        raise ValueError(f"no table in {folder}")
    wanted = keys.select(own.keys).distinct()
    touched = [r[0] for r in wanted.select(_bucket(own.keys, own.buckets)).distinct().collect()]  # a row for each bucket at most
    rows = _read(spark, folder, own, touched)
    return rows.alias("t").join(wanted.alias("w"), reduce(and_, (F.col(f"t.{c}").eqNullSafe(F.col(f"w.{c}")) for c in own.keys)), "left_semi")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def _last(new: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row for each key: the last by order, ties and without one by all columns."""
    by = ([F.col(order).desc_nulls_last()] if order else []) + [F.col(c).desc_nulls_last() for c in new.columns if c not in keys]
    window = Window.partitionBy(*keys).orderBy(*(by or [F.lit(1)]))
    return new.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def create(df: DataFrame, folder: str, keys: list[str], buckets: int = BUCKETS, order: str | None = None) -> State:
    """A table of the rows of df, one for each key: of repeated ones the last by order. Rows with null keys are kept; nulls are equal. ValueError where there is a table."""
    spark = df.sparkSession
    if state(spark, folder) is not None:
        raise ValueError(f"there is a table in {folder}")
    empty = State(0, keys, buckets, df.schema.json(), {}, {})
    return _written(_last(df, keys, order), folder, empty, [])


def _written(rows: DataFrame, folder: str, own: State, touched: list[int]) -> State:
    """Write rows as the next version of their buckets, then the state that names them."""
    spark = rows.sparkSession
    number = max([own.number, *_numbers(spark, f"{folder}/data", "version=")]) + 1
    path = f"{folder}/data/version={number}"
    placed = rows.withColumn("bucket", _bucket(own.keys, own.buckets))
    # a bucket is written by one task, many buckets by many
    placed.repartition(own.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    _, fs = _fs(spark, path)
    found = {int(x.getPath().getName()[7:]) for x in fs.listStatus(_fs(spark, path)[0]) if x.getPath().getName().startswith("bucket=")}
    kept = {b: v for b, v in own.versions.items() if b not in touched}
    new = replace(own, number=number, versions=kept | {b: number for b in found})
    _put(spark, folder, new)
    return new


def merge(new: DataFrame, folder: str, matched: dict[str, Column] | None = None, insert: bool = True, order: str | None = None, batch: tuple[str, int] | None = None) -> State:
    """Merge new rows into a table: those with a key that it holds change that row, others are inserted unless insert is False.

    matched gives columns of a changed row in terms of `old.<column>` and `new.<column>`; without it, new's columns are taken and the table's others
    stay. An empty dict changes no row: only absent keys are inserted. Of repeated new rows the last by order counts. Columns that new lacks are null in
    inserted rows. batch is a writer and the number of its batch: one that is not above the writer's last changes nothing.
    """
    spark = new.sparkSession
    own = state(spark, folder)
    if own is None:
        raise ValueError(f"no table in {folder}")
    if batch and own.batches.get(batch[0], -1) >= batch[1]:
        return own
    own = replace(own, batches=own.batches | ({batch[0]: batch[1]} if batch else {}))
    last = _last(new, own.keys, order)
    touched = [r[0] for r in last.select(_bucket(own.keys, own.buckets)).distinct().collect()]  # a row for each bucket at most
    if not touched:
        written = replace(own, number=own.number + 1)
        _put(spark, folder, written)
        return written
    schema = StructType.fromJson(json.loads(own.schema))
    old = _read(spark, folder, own, touched).withColumn("__old", F.lit(True)).alias("old")
    fresh = last.withColumn("__new", F.lit(True)).alias("new")
    both = old.join(fresh, reduce(and_, (F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in own.keys)), "full_outer")
    is_old, is_new = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    changes = {c: F.col(f"new.{c}") for c in last.columns if c not in own.keys} if matched is None else matched

    def value(c: str) -> Column:
        inserted = F.col(f"new.{c}") if c in last.columns else F.lit(None)
        kept = F.col(f"old.{c}")
        if c in own.keys:
            return F.when(is_old, kept).otherwise(inserted)
        return F.when(is_old & is_new, changes.get(c, kept)).when(is_old, kept).otherwise(inserted)

    rows = (both if insert else both.where(is_old)).select(*(value(f.name).cast(f.dataType).alias(f.name) for f in schema))
    return _written(rows, folder, own, touched)


def merge_stream(stream: DataFrame, folder: str, writer: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, **how) -> StreamingQuery:
    """Merge each micro-batch of a stream, after change(), under the writer's name: one repeated after a failure is merged once."""

    def write(batch: DataFrame, number: int) -> None:
        merge(change(batch), folder, batch=(writer, number), **how)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete the files of buckets that the newest state does not name, and the states before it; returns the number of folders deleted. No merge may run meanwhile."""
    own = state(spark, folder)
    if own is None:
        return 0
    gone = 0
    for prefix, place in (("version=", "data"), ("state=", "states")):
        root, fs = _fs(spark, f"{folder}/{place}")
        for at in [x.getPath() for x in fs.listStatus(root)]:
            number = int(at.getName()[len(prefix) :])
            inside = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("bucket=")] if place == "data" else []
            stale = [b for b in inside if own.versions.get(int(b.getName()[7:])) != number]
            drop = [at] if (place == "states" and number < own.number) or (place == "data" and number <= own.number and len(stale) == len(inside)) else stale if number <= own.number else []
            for p in drop:
                fs.delete(p, True)
                gone += 1
    return gone
