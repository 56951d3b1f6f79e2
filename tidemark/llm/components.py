"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop

#: Tasks that a node's neighbours are dealt to.
SALTS = 64


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node long, component long) for every node of the edges (u long, v long); component is the smallest node reachable.

    Null ends and self loops are ignored, repeated edges count once; no edges give no rows. Neighbours are only ever reduced to
    their minimum and joined back, never gathered, so a hub costs a skewed join at most. Each round is written to the shared folder.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e, tag)
    before = _state(e)
    while before[0]:
        large = cut(_large_star(e), tag)
        small = cut(_small_star(large), tag)
        drop(e, large)
        e, after = small, _state(small)
        if after == before:
            break
        before = after
    label = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return label.unionByName(roots)


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): the pairs with the least v of their u. A node's pairs are dealt to SALTS tasks; what meets by node alone is one row of each."""
    salted = pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.select("u", "salt", F.min("m").over(Window.partitionBy("u")).alias("m"))
    return salted.join(least, ["u", "salt"]).select("u", "v", "m")


def _large_star(e: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least of the node and its neighbours."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of these."""
    ends = F.explode(F.array(*(F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v"))))
    return _with_least(e).select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct()
