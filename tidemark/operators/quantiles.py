"""Exact order statistics by group without putting a whole group in order.

A sketch bounds the value that is asked for; rows below the bound are counted, and only those between the bounds, about 6 in ACCURACY of a
group, are put in order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inverse of the sketch's error in ranks. Groups of no more rows are put in order as they are.
ACCURACY = 10_000


def values_at(rows: DataFrame, by: list[str], value: str, places: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """(by..., n, a column for each of places) for each group with values: the value at a place of the group's values in order, from 0.

    places: for each column a share, and the place as a function of the number of values n, which lies within one of share * n. Null values are
    left out, NaN is above all numbers, null keys make a group.
    """
    names, margin = list(places), 3 / ACCURACY
    shares = [min(1.0, max(0.0, share + side)) for share, _ in places.values() for side in (-margin, margin)]
    there = rows.select(*(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), F.col(value).alias("__x")).where("__x IS NOT NULL")
    keys = [f"__by{k}" for k in range(len(by))]
    sketch = F.percentile_approx("__x", shares, ACCURACY).alias("__near")
    groups = there.groupBy(*keys).agg(F.count("*").alias("n"), sketch, F.min("__x").alias("__low"), F.max("__x").alias("__high")).where("n > 0")
    small = F.col("n") <= ACCURACY
    bounds = [F.struct(F.when(small, F.col("__low")).otherwise(F.col("__near")[2 * k]).alias("from"), F.when(small, F.col("__high")).otherwise(F.col("__near")[2 * k + 1]).alias("to")) for k in range(len(names))]
    bounded = groups.select(*(F.col(c).alias(f"g{c}") for c in keys), "n", *(b.alias(f"__b{k}") for k, b in enumerate(bounds)))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"g{c}")) for c in keys), F.lit(True))
    counted = there.groupBy(*keys, "__x").agg(F.count("*").alias("__k")).join(bounded if keys else F.broadcast(bounded), same)  # one row without keys
    sides = [F.struct(F.lit(k).alias("which"), (F.col("__x") < F.col(f"__b{k}.from")).alias("below"), (F.col("__x") <= F.col(f"__b{k}.to")).alias("to")) for k in range(len(names))]
    sided = counted.select(*keys, "n", "__x", "__k", F.explode(F.array(*sides)).alias("s")).where("s.to").select(*keys, "n", "__x", "__k", F.col("s.which").alias("which"), F.col("s.below").alias("below"))
    folded = sided.groupBy(*keys, "which", F.when(~F.col("below"), F.col("__x")).alias("__x")).agg(F.first("n").alias("n"), F.sum("__k").alias("__k"))  # what is below is one row
    of = Window.partitionBy(*keys, "which").orderBy(F.asc_nulls_first("__x"))
    upto = folded.withColumn("__upto", F.sum("__k").over(of)).where("__x IS NOT NULL")
    found = [F.min(F.when((F.col("which") == k) & (F.col("__upto") > at(F.col("n"))), F.col("__x"))).alias(name) for k, (name, (_, at)) in enumerate(places.items())]
    return upto.groupBy(*keys).agg(F.first("n").alias("n"), *found).select(*(F.col(f"__by{k}").alias(c) for k, c in enumerate(by)), "n", *names)


def nearest_ranks(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., n, a column for each share): the value at place floor(n * share)."""
    return values_at(rows, by, value, {name: (share, lambda n, share=share: F.floor(n * F.lit(share))) for name, share in shares.items()})


def quantile(rows: DataFrame, value: str, share: float) -> float | None:
    """The quantile between the two nearest values, weighed by distance; None without values."""
    place = lambda n: (n - 1) * F.lit(share)
    ends = values_at(rows, [], value, {"low": (share, lambda n: F.floor(place(n))), "high": (share, lambda n: F.ceil(place(n)))})
    r = ends.select((F.col("low") + (F.col("high") - F.col("low")) * (place(F.col("n")) - F.floor(place(F.col("n"))))).alias("q")).first()
    return None if r is None else r["q"]
