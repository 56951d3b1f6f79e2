"""Components of graphs with hubs and chains are those of a plain search; a hub is spread over tasks."""

from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm.components import _with_least, connected_components


def _graph(kind: str) -> list[tuple]:
    rng = random.Random(kind)
    hub = [(5, n) if n % 2 else (n, 5) for n in range(100, 700)]
    chain = [(n, n + 1) for n in range(2000, 2060)]
    loose = [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)]
    high_hub = [(9999, n) for n in range(4000, 4300)]
    return {"hub": hub + high_hub, "chain": chain[::-1] + [(2010, 2010)], "mixed": hub + chain + loose + high_hub + hub[:50] + [(699, 2000), (-3, 4000)]}[kind]


@pytest.mark.parametrize("kind", ["hub", "chain", "mixed"])
def test_same_as_plain_search(spark, kind):
    edges = _graph(kind)
    got = connected_components(spark.createDataFrame([*edges, (None, 1), (2, None)], "u long, v long")).collect()
    linked = [(a, b) for a, b in edges if a != b]
    want = brute.components({n for e in linked for n in e}, linked)
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_no_edges_no_rows(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0


def test_a_hub_is_spread_over_tasks(spark):
    pairs = spark.range(1, 6401).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in _with_least(pairs).where("m = 1").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 6400 and max(sizes) < 6400 / 4
