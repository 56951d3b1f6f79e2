"""SimHash near-duplicates, found with a hierarchical index over fingerprints in Gray order.

Fingerprints within `max_bits` bits agree on one of max_bits+1 blocks of bits, and on one of as many blocks of the other bits: these masked patterns
are the index's upper nodes. Below, fingerprints are sorted by Gray rank and packed into ranges, nodes and leaves; each carries the bits on
which all below agree. Two groups are compared on what both agree on. Only bits that their parents did not yet compare are looked at and added
to the parents' differences; groups that come to more than max_bits are pruned whole. A dense node gives a spanning forest of its links,
never its pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop, shuffle_partitions, small_batches
from tidemark.llm.components import connected_components

SEED = 42
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Nodes of a range, fingerprints of a node and of a leaf.
RANGE, NODE, LEAF = 64, 512, 32
_UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIECE = 200_000  # shingles whose bits are unpacked at a time


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits; one is set if over half of the shingles' hashes have it. No words: 0. Fewer words than a shingle: the whole sequence."""
    words = WORD.findall(text.encode("utf-8", "replace").translate(_UPPER_TO_LOWER))
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join, n = xxhash.xxh64_intdigest, b" ".join, len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        some = min(_PIECE, n - at)
        rows = zip(*(words[at + k : at + k + some] for k in range(shingle)), strict=True)
        h = np.fromiter((digest(x, SEED) for x in map(join, rows)), np.uint64, some)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long: the fingerprint's 64 bits as a signed number, text_hash long); a null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [fingerprint(t or "", shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), b.column(2)], ["doc_id", "fp", "text_hash"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def near(a: np.ndarray, b: np.ndarray, bits: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with a[i], b[j] within bits; both sorted by Gray rank.

    What the nodes a and b agree on is compared once; leaves add the bits that they agree on besides, and those that come to too many are skipped.
    """
    all_a, all_b = np.bitwise_and.reduce(a), np.bitwise_and.reduce(b)
    shared = ~(all_a ^ np.bitwise_or.reduce(a)) & ~(all_b ^ np.bitwise_or.reduce(b))
    differences = int(np.bitwise_count((all_a ^ all_b) & shared))
    i_out, j_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if differences <= bits:
        cuts_a, cuts_b = np.arange(0, len(a), leaf), np.arange(0, len(b), leaf)
        and_a, or_a = np.bitwise_and.reduceat(a, cuts_a), np.bitwise_or.reduceat(a, cuts_a)
        and_b, or_b = np.bitwise_and.reduceat(b, cuts_b), np.bitwise_or.reduceat(b, cuts_b)
        besides = ~(and_a ^ or_a)[:, None] & ~(and_b ^ or_b)[None, :] & ~shared
        keep_a, keep_b = np.nonzero(differences + np.bitwise_count((and_a[:, None] ^ and_b[None, :]) & besides) <= bits)
        for x, y in zip(keep_a * leaf, keep_b * leaf, strict=True):
            i, j = np.nonzero(np.bitwise_count(a[x : x + leaf, None] ^ b[None, y : y + leaf]) <= bits)
            i_out.append(i + x)
            j_out.append(j + y)
    return np.concatenate(i_out), np.concatenate(j_out)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least position that links i-j reach, for each of n positions."""
    label = np.arange(n)
    while True:
        was = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == was).all():
            return label


def patterns(max_bits: int) -> list[np.uint64]:
    """Masks of which one at least holds only bits on which two fingerprints within max_bits agree: a block of all bits and one of the rest."""
    blocks = max_bits + 1

    def parts(bits: list[int]) -> list[list[int]]:
        return [bits[len(bits) * k // blocks : len(bits) * (k + 1) // blocks] for k in range(blocks)]

    out = []
    for block in parts(list(range(64))):
        rest = [b for b in range(64) if b not in block]
        out += [np.uint64(sum(1 << b for b in (*block, *more))) for more in parts(rest)]
    return out


def links(classes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (u long, v long) between `rep`s whose `fp`s differ in max_bits bits at most; they connect what all such links connect.

    classes: (fp long, rep long), fp distinct, rep not null. One range sort by (pattern's place, its bits, Gray rank) deals hot patterns over many
    tasks; it is the index's build. Of a pattern with several nodes, ranges of nodes are compared first, nodes only in pairs of ranges that remain.
    """
    spark = classes.sparkSession
    masks = patterns(max_bits)

    def keyed(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rank = (gray_rank(fp) ^ np.uint64(1 << 63)).view(np.int64)  # a signed order that is the unsigned one
            for k, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array((fp & mask).view(np.int64)), pa.array(rank), b.column(0), b.column(1)], ["block", "key", "rank", "fp", "rep"])

    def packed(batches):
        rows = pa.Table.from_batches(list(batches))  # one range partition; its size is set by the number of partitions
        if not rows.num_rows:
            return
        block, key, fp, rep = (rows.column(c).combine_chunks().to_numpy() for c in ("block", "key", "fp", "rep"))
        fp = fp.view(np.uint64)
        new = np.ones(len(fp), bool)
        new[1:] = (block[1:] != block[:-1]) | (key[1:] != key[:-1])
        first = np.nonzero(new)[0]
        size = np.diff(np.append(first, len(fp)))
        at = np.arange(len(fp)) - np.repeat(first, size)
        starts = np.nonzero(new | (at % NODE == 0))[0]
        ends = np.append(starts[1:], len(fp))
        # a fingerprint alone with its pattern meets none, unless the pattern goes on in the next partition
        alone = (np.repeat(size, size) == 1)[starts] & (starts > 0) & (ends < len(fp))
        starts, ends = starts[~alone], ends[~alone]
        if not len(starts):
            return
        all_of, any_of = (np.array([f.reduce(fp[s:e]) for s, e in zip(starts, ends, strict=True)], np.uint64) for f in (np.bitwise_and, np.bitwise_or))
        # links inside a node: one edge from each fingerprint to the least position that it reaches
        u, v = np.arange(len(fp)), np.arange(len(fp))
        for s, e in zip(starts, ends, strict=True):
            if e - s > 1:
                i, j = near(fp[s:e], fp[s:e], max_bits)
                v[s:e] = s + forest(i, j, e - s)
        for lo in range(0, len(starts), 2000):
            s, e = starts[lo : lo + 2000], ends[lo : lo + 2000]
            out = [block[s], key[s], at[s] // (NODE * RANGE), s.astype(np.int64), all_of[lo : lo + 2000].view(np.int64), any_of[lo : lo + 2000].view(np.int64)]
            blobs = [[x[a:b].tobytes() for a, b in zip(s, e, strict=True)] for x in (fp, rep, rep[v])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), *(pa.array(x, pa.binary()) for x in blobs)], ["block", "key", "range", "seq", "all_of", "any_of", "fps", "reps", "roots"])

    small = spark.sparkContext.defaultParallelism
    parts = max(shuffle_partitions(spark), small)
    index = classes.select("fp", "rep").mapInArrow(keyed, "block int, key long, rank long, fp long, rep long")
    index = index.repartitionByRange(parts, "block", "key", "rank").sortWithinPartitions("block", "key", "rank")
    nodes = index.mapInArrow(packed, "block int, key long, range long, seq long, all_of long, any_of long, fps binary, reps binary, roots binary")
    part = F.spark_partition_id()
    nodes = cut(nodes.withColumns({"range": F.struct(part.alias("p"), "range"), "node": F.struct(part.alias("p"), "seq")}), "gray-nodes")

    def inside(batches):
        for b in batches:
            u, v = (np.concatenate([np.frombuffer(x, np.int64) for x in b.column(c).to_pylist()] or [np.zeros(0, np.int64)]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    def across(batches):
        for b in batches:
            for fa, ra, fb, rb in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a, c = np.frombuffer(fa, np.uint64), np.frombuffer(fb, np.uint64)
                i, j = near(a, c, max_bits)
                if len(i):
                    rep = np.concatenate([np.frombuffer(ra, np.int64), np.frombuffer(rb, np.int64)])
                    root = rep[forest(i, j + len(a), len(rep))]
                    yield pa.RecordBatch.from_arrays([pa.array(rep[root != rep]), pa.array(root[root != rep])], ["u", "v"])

    one = nodes.where(F.length("reps") > 8).select("reps", "roots").mapInArrow(inside, "u long, v long")
    at = ["block", "key"]
    several = nodes.groupBy(*at).count().where("count > 1").select(*at)
    some = cut(nodes.join(several, at, "left_semi"), "gray-several")
    ranges = some.groupBy(*at, "range").agg(F.bit_and("all_of").alias("all_of"), F.bit_or("any_of").alias("any_of"))
    a, b = (ranges.select(*at, *(F.col(c).alias(f"{c}_{x}") for c in ("range", "all_of", "any_of"))) for x in "ab")
    agree = lambda x: F.bitwise_not(F.col(f"all_of_{x}").bitwiseXOR(F.col(f"any_of_{x}")))
    apart = F.col("all_of_a").bitwiseXOR(F.col("all_of_b"))
    both = a.join(b, at).where(F.col("range_a") <= F.col("range_b")).withColumn("shared", agree("a").bitwiseAND(agree("b")))
    both = both.withColumn("differences", F.bit_count(apart.bitwiseAND(F.col("shared")))).where(F.col("differences") <= max_bits).select(*at, "range_a", "range_b", "shared", "differences")
    a, b = (some.select(*at, *(F.col(c).alias(f"{c}_{x}") for c in ("range", "node", "all_of", "any_of", "fps", "reps"))) for x in "ab")
    besides = agree("a").bitwiseAND(agree("b")).bitwiseAND(F.bitwise_not("shared"))
    pairs = both.join(a, [*at, "range_a"]).join(b, [*at, "range_b"]).where(F.col("node_a") < F.col("node_b")).where(F.col("differences") + F.bit_count(apart.bitwiseAND(besides)) <= max_bits)
    two = pairs.select("fps_a", "reps_a", "fps_b", "reps_b").repartition(parts).mapInArrow(across, "u long, v long")
    return one.unionByName(two)


def simhash_dedup(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id long, fingerprint string, component_id long, kept boolean, text_hash long) for each row of docs (doc_id, text, ...).

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows come back as often as they were given. Rows link
    whatever their doc_id: component_id is the smallest id reached, also through rows without one, and null if none has an id; kept is
    doc_id = component_id, and true where no component is known. text_hash tells rows of one id apart. Other columns of docs are ignored. An
    empty table gives no rows.
    """
    fps = cut(fingerprints(docs, shingle), "simhash-fp")
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    labels = connected_components(links(classes.select("fp", F.col("fp").alias("rep")), max_bits), "simhash-cc")
    named = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    named = cut(named, "simhash-named")
    known = named.join(named.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "component_id")
    drop(classes)
    out = fps.join(known, "fp", "left")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", kept.alias("kept"), "text_hash")
