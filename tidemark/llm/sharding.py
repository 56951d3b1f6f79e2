"""Minimax contiguous partition of ordered atomic groups into shards, in DataFrame operations alone.

Groups are rows of equal text, in the order of their hash. The smallest capacity that a greedy filling of the shards needs is found by
binary search, checked by filling greedily. No shard may exceed it; below it, each cut is the one nearest to an even share of what is left from which
the rest still fits, so that a large group does not leave shards empty. The search runs on sums over segments of the hash order. Only segments
in which a cut may fall are split further, so what comes to the driver is a bounded summary at each step, and the result is exact.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop

#: Bits of the hash by which a segment is split at each step.
STEP = 10
#: Rows for which one task numbers slots, about.
SLOT_ROWS = 20_000


class Segments:
    """Ordered stretches of the group order: first key, log2 of the stretch's width in keys, sum of sizes, number of groups."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows)
        self.after = list(accumulate((r[2] for r in self.rows), initial=0))
        self.total = self.after[-1]

    def holding(self, place: int) -> int:
        """The last segment that starts at or before a place in the running sum."""
        return min(bisect_right(self.after, place) - 1, len(self.rows) - 1)

    def fill(self, capacity: int, shards: int, atomic: bool) -> list[int] | None:
        """Ends of greedily filled shards in the running sum, or None if they do not suffice. Not atomic: a segment of several groups may be cut anywhere."""
        ends, at = [], 0
        for _ in range(shards):
            if at >= self.total:
                break
            aim = at + capacity
            if aim >= self.total:
                end = self.total
            else:
                n = self.holding(aim)
                end = aim if not atomic and self.rows[n][3] > 1 else self.after[n]
            if end <= at:
                return None
            ends.append(end)
            at = end
        return ends if at >= self.total else None

    def least(self, shards: int, atomic: bool) -> int:
        low, high = max(0, self.total // max(shards, 1) - 1), self.total
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fill(mid, shards, atomic) is not None else (mid, high)
        return high


def _refined(segments: Segments, touched: set[int], summary) -> Segments:
    """The touched segments of several groups are split."""
    split = {n for n in touched if segments.rows[n][3] > 1}
    rows = [r for n, r in enumerate(segments.rows) if n not in split]
    for width in sorted({segments.rows[n][1] for n in split}):
        below = max(0, width - STEP)
        own = [segments.rows[n][0] >> width for n in split if segments.rows[n][1] == width]
        rows += [(p << below, below, s, n) for p, s, n in summary(below, own, width)]
    return Segments(rows)


def _cuts(segments: Segments, capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """Ends of the shards but the last in the running sum, and the segments of several groups in which a boundary was looked for."""
    touched: set[int] = set()

    def boundaries(place: int) -> tuple[int, int]:
        """The last boundary at or before a place and the first at or after it."""
        n = segments.holding(place)
        if place == segments.after[n] or place >= segments.total:
            return place, place
        if segments.rows[n][3] > 1:
            touched.add(n)
        return segments.after[n], segments.after[n + 1]

    first = [segments.total]  # by shards left: where they may begin at the earliest
    for _ in range(shards - 1):
        first.append(boundaries(max(0, first[-1] - capacity))[1])
    at, ends = 0, []
    for left in range(shards, 1, -1):
        aim = at + (segments.total - at) // left
        below, above = boundaries(aim)
        end = below if aim - below <= above - aim else above
        last = boundaries(min(at + capacity, segments.total))[0]
        at = max(min(max(end, first[left - 1]), last), at)
        ends.append(at)
    return ends, touched


def least_capacity(summary, shards: int) -> tuple[int, list[int | None]]:
    """The smallest feasible capacity and the keys at which shards after the first begin, None where one and all after it are empty.

    summary(width, prefixes, of) gives rows (key >> width, sum, number) for the groups whose key >> of is in prefixes, all if None.
    """
    width = 64 - STEP
    segments = Segments([(p << width, width, s, n) for p, s, n in summary(width, None)])
    if not segments.total:
        return 0, [None] * (shards - 1)
    while True:
        low, high = segments.least(shards, False), segments.least(shards, True)
        if low == high:
            break
        # in which segments may the cuts of a capacity in between fall?
        touched, first, last = set(), 0, 0
        for _ in range(shards - 1):
            first = segments.after[segments.holding(first + low)]
            last = min(last + high, segments.total)
            touched.update(range(segments.holding(first), segments.holding(last) + 1))
            if first >= segments.total:
                break
        segments = _refined(segments, touched, summary)
    while True:
        ends, touched = _cuts(segments, high, shards)
        if not touched:
            return high, [segments.rows[segments.holding(e)][0] if e < segments.total else None for e in ends]
        segments = _refined(segments, touched, summary)


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size long, text_crc32 long, law string, shard int, slot long, grown_shard int) for each row of docs (doc_id, text, ...).

    Law `bytes`: shards are runs of the groups in hash order, the largest sum of sizes is as small as such runs allow, the others near equal. size is the text's UTF-8 bytes plus 1 (null: 1),
    text_crc32 its checksum (null: that of no bytes). Rows of equal text share a shard, null texts form a group. slot runs from 0 in each
    shard; repeated rows get a slot each, ties in any order. grown_shard is null under this law. An empty table gives no rows.
    """
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = cut(rows, "shard-rows")
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    def summary(width: int, prefixes: list[int] | None, of: int = 0) -> list[tuple[int, int, int]]:
        some = groups if prefixes is None else groups.where(F.shiftright("key", of).isin(prefixes))
        found = some.groupBy(F.shiftright("key", width).alias("p")).agg(F.sum("size"), F.count("*")).collect()  # 2**STEP rows a prefix at most
        return [(r[0], r[1], r[2]) for r in found]

    _, starts = least_capacity(summary, shards)
    number: Column = F.lit(0)
    for key in starts:
        if key is not None:
            number = number + (F.col("key") >= key).cast("int")
    parts = max(32, rows.count() // SLOT_ROWS)
    placed = rows.withColumn("shard", number.cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", "key", F.lit(7)), F.lit(parts)).cast("int"))
    sizes = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    first = cut(sizes.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")), "shard-first")
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key"))
    out = placed.withColumn("own", own).join(first, ["shard", "part"])
    drop(groups)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("own") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
