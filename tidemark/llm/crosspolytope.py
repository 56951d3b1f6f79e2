"""Embedding near-duplicates by cross-polytope hashing (Andoni et al., 2015).

A pseudo-random rotation is three rounds of random signs and a fast Hadamard transform; its hash of a vector is the signed axis nearest to
the rotated vector. A bucket of a table is named by the hashes of several rotations. A vector lies in one bucket of each table and probes the
next likely ones, where its second-best axis replaces the best in one rotation. Vectors that meet in a bucket are compared by cosine in double
precision. A pair counts in the first bucket in which it meets, so links are counted without being listed: comparisons give counts and a
spanning forest. What is dealt out first is numbers of vectors; vectors follow to the buckets that hold several. A bucket of more than BLOCK
vectors is compared block by block, in tasks of their own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop, hint_small, shuffle_partitions
from tidemark.llm.components import connected_components

PROBES = 6
#: The share of pairs at the least cosine that should meet; the number of tables follows from it.
RECALL = 0.96
BLOCK = 2048
#: Vectors of a bucket up to which its pairs are taken together with those of other buckets.
SMALL = 24
_STEP = 50_000  # pairs looked at together


@lru_cache
def _factor(n: int) -> np.ndarray:
    return np.ones((1, 1)) if n == 1 else np.kron(np.array([[1.0, 1.0], [1.0, -1.0]]), _factor(n // 2)) / np.sqrt(2)


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, lengths kept: the matrix of a power of two is the Kronecker product of two small ones."""
    n = x.shape[1]
    a = 1 << (n.bit_length() - 1) // 2
    return (_factor(a) @ (x.reshape(len(x), a, n // a) @ _factor(n // a))).reshape(len(x), n)


@lru_cache
def _signs(d: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, hashes, 3, d))


def codes(x: np.ndarray, tables: int, hashes: int, probes: int = PROBES, seed: int = 5) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket numbers of unit vectors: first the own bucket, then the probed ones."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    signs, probes = _signs(d, tables, hashes, seed), min(probes, hashes * (d - 1))
    step = max(1, (1 << 17) // d)  # what stays in the cache
    out = np.empty((len(x), tables, 1 + probes), np.int64)
    for at in range(0, len(x), step):
        some = x[at : at + step]
        some = np.pad(some, ((0, 0), (0, d - x.shape[1])))
        for t in range(tables):
            out[at : at + step, t] = _table(some, signs[t], probes)
    return out


def _table(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """(rows, 1 + probes) bucket numbers in one table, by the rotations with signs (hashes, 3, d)."""
    hashes, d, rows = len(signs), x.shape[1], np.arange(len(x))[:, None]
    some = min(probes + 1, d)
    best, loss, moved = np.zeros(len(x), np.int64), [], []
    for k in range(hashes):
        y = x
        for s in signs[k]:
            y = _hadamard(y * s)
        size = np.abs(y)
        order = np.argpartition(-size, some - 1, axis=1)[:, :some]
        order = np.take_along_axis(order, np.argsort(-size[rows, order], axis=1, kind="stable"), 1)
        axis = (order + d * (y[rows, order] < 0)) * (2 * d) ** k
        best += axis[:, 0]
        loss.append(size[rows, order[:, :1]] - size[rows, order[:, 1:]])
        moved.append(axis[:, 1:] - axis[:, :1])
    loss, moved = np.concatenate(loss, 1), np.concatenate(moved, 1)
    first = np.argsort(loss, axis=1, kind="stable")[:, :probes]
    return np.concatenate([best[:, None], best[:, None] + moved[rows, first]], 1)


def meet(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(pairs, tables): whether the one's own bucket is among the other's, for codes p and q of pairs of vectors."""
    return (p[:, :, :1] == q).any(2) | (q[:, :, :1] == p).any(2)


@lru_cache
def plan(dim: int, rows: int, least: float = 0.9) -> tuple[int, int]:
    """(tables, hashes): so many hashes that unrelated vectors seldom share a bucket, so many tables that RECALL of the pairs at cosine `least` meet.

    Measured on random pairs, with rotations that the index does not use.
    """
    d = 1 << max(1, (dim - 1).bit_length())
    hashes = max(1, min(int(np.ceil(np.log(max(rows, 2)) / np.log(2 * d))), int(62 // np.log2(2 * d))))
    if dim == 1:
        return 1, 1
    rng, n = np.random.default_rng(dim), 500
    x, y = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= x * (x * y).sum(1, keepdims=True)
    y = least * x + np.sqrt(1 - least * least) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    each = meet(codes(x, 4, hashes, seed=77), codes(y, 4, hashes, seed=77)).mean()
    return max(1, int(np.ceil(np.log(1 - RECALL) / np.log(1 - min(each, 1 - RECALL if each >= 1 else each))))) if each < 1 else 1, hashes


def _unit(raw: bytes, rows: int, kind: str) -> np.ndarray:
    """rows vectors of length 1 from their numbers' bytes."""
    x = np.frombuffer(raw, kind).reshape(rows, -1).astype(np.float64)
    largest = np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    x /= largest
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    label = np.arange(n)
    while True:
        was = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == was).all():
            return label


def _candidates(starts: np.ndarray, ends: np.ndarray, block: np.ndarray, x: np.ndarray, least: float):
    """Pairs (i, j) of rows with cosine >= least in each run starts[k]:ends[k]; of a run of two blocks, those with one row in each."""
    sizes, two = ends - starts, block[starts] != block[ends - 1]
    small = ~two & (sizes <= SMALL)
    for size in np.unique(sizes[small]):
        a, b = np.triu_indices(size, 1)
        first = starts[small & (sizes == size)][:, None]
        i, j = (first + a).ravel(), (first + b).ravel()
        for at in range(0, len(i), _STEP):
            p, q = i[at : at + _STEP], j[at : at + _STEP]
            near = np.einsum("rk,rk->r", x[p], x[q]) >= least
            yield p[near], q[near]
    for lo, hi in zip(starts[~small], ends[~small], strict=True):
        mid = lo + np.searchsorted(block[lo:hi], block[lo], "right")
        for at in range(lo, mid, 256):
            rows = np.arange(at, min(at + 256, mid))
            to = mid if mid < hi else at
            p, q = np.nonzero(x[rows] @ x[to:hi].T >= least)
            p, q = rows[p], q + to
            yield (p, q) if mid < hi else (p[p < q], q[p < q])


def _links(key: np.ndarray, number: np.ndarray, own: np.ndarray, n: np.ndarray, x: np.ndarray, code: np.ndarray, least: float):
    """(number, more, root) of the rows with links. key: (rows, 5) table, bucket, the cell's two blocks and the row's; equal cells lie together."""
    change = np.nonzero((key[1:, :4] != key[:-1, :4]).any(1))[0] + 1
    starts, ends = np.append(0, change), np.append(change, len(key))
    tab, bucket = key[:, 0], key[:, 1]
    heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in _candidates(starts, ends, key[:, 4], x, least):
        keep = own[i] | own[j]
        i, j = i[keep], j[keep]
        for at in range(0, len(i), _STEP):  # where do they meet first?
            p, q = i[at : at + _STEP], j[at : at + _STEP]
            first = meet(code[p], code[q]).argmax(1)
            a, b = code[p, first], code[q, first]
            place = np.where((a[:, :1] == b).any(1), a[:, 0], b[:, 0])
            both = (a[:, :1] == b).any(1) & (b[:, :1] == a).any(1)
            place = np.where(both, np.minimum(a[:, 0], b[:, 0]), place)
            here = (first == tab[p]) & (place == bucket[p])
            heads.append(p[here])
            tails.append(q[here])
    i, j = np.concatenate(heads), np.concatenate(tails)
    more = np.zeros(len(number), np.int64)
    np.add.at(more, i, n[j])
    np.add.at(more, j, n[i])
    some = more > 0
    return number[some], more[some], number[_roots(i, j, len(number))][some]


def links(classes: DataFrame, least: float = 0.9, number: str = "<f8") -> DataFrame:
    """(num, more, root): linked vectors to be added to num's count, and a vector that it reaches; rows of one num add up.

    classes: made by cut(), (num long, n long: equal vectors, x binary: its numbers, of NumPy type `number`), num distinct.
    """
    parts, rows = shuffle_partitions(classes.sparkSession), classes.count()
    width = np.dtype(number).itemsize

    def coded(batches):
        for b in batches:
            num, n, raw = b.column(0), b.column(1), b.column(2).to_pylist()
            sizes = np.array([len(x) // width for x in raw], np.int32)
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                own = [raw[k] for k in at]
                c = codes(_unit(b"".join(own), len(own), number), *plan(int(dim), rows, least))
                blobs = [x.tobytes() for x in c]
                yield pa.RecordBatch.from_arrays([num.take(pa.array(at)), n.take(pa.array(at)), pa.array(own, pa.binary()), pa.array(blobs, pa.binary()), pa.array(np.full(len(own), dim, np.int32))], ["num", "n", "x", "codes", "dim"])

    def dealt(batches):
        for b in batches:
            blobs = b.column(1).to_pylist()
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                tables = plan(int(dim), rows, least)[0]
                c = np.frombuffer(b"".join([blobs[k] for k in at]), np.int64).reshape(len(at), tables, -1)
                num = b.column(0).take(pa.array(at))
                for t in range(tables):
                    for p in range(c.shape[2]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)) for v in (dim, t)] + [pa.array(c[:, t, p]), pa.array(np.full(len(at), p == 0)), num], ["dim", "tab", "bucket", "own", "num"])

    with_codes = cut(classes.select("num", "n", "x").mapInArrow(coded, "num long, n long, x binary, codes binary, dim int"), "polytope-codes")
    place = ["dim", "tab", "bucket"]
    index = with_codes.select("num", "codes", "dim").mapInArrow(dealt, "dim int, tab int, bucket long, own boolean, num long")
    index = cut(index, "polytope-index")
    # buckets in which a vector meets another; the number of their blocks comes with them, so no bucket is gathered to be cut
    live = index.groupBy(*place).agg(F.count("*").alias("rows"), F.bool_or("own").alias("owned")).where("rows > 1 and owned")
    live = cut(live.select(*place, F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "polytope-live")
    members = index.join(hint_small(live), place)
    members = members.withColumn("block", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int")).join(with_codes.drop("dim"), "num")
    # a row goes to each cell of its block with another block or itself
    cells = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(*place, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "own", "num", "n", "x", "codes")
    keys = [*place, "low", "high"]
    cells = cells.repartition(parts, *keys).sortWithinPartitions(*keys, "block")

    def compared(batches):
        held: list = []

        def result(table):
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                t = table.filter(pa.array(dims == dim))
                num, n, own = (t.column(c).to_numpy() for c in ("num", "n", "own"))
                key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("tab", "bucket", "low", "high", "block")], 1)
                x = _unit(b"".join(t.column("x").to_pylist()), len(num), number)
                code = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int64).reshape(len(num), plan(int(dim), rows, least)[0], -1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _links(key, num, own, n, x, code, least)], ["num", "more", "root"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            k = np.stack([b.column(c).to_numpy().astype(np.int64) for c in keys], 1)
            change = np.nonzero((k[1:] != k[:-1]).any(1))[0]
            if len(change):  # the last cell may go on in the next batch
                table = pa.Table.from_batches(held)
                done = table.num_rows - b.num_rows + int(change[-1]) + 1
                yield from result(table.slice(0, done))
                held = table.slice(done).combine_chunks().to_batches()
        if held:
            yield from result(pa.Table.from_batches(held))

    found = cut(cells.mapInArrow(compared, "num long, more long, root long"), "polytope-links")
    drop(with_codes, index, live)
    return found


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id long, n_links long, component_id long, kept boolean) for each row of vectors (vec_id, embedding, ...).

    Links are pairs found with cosine >= least; equal vectors are linked and compared once. Null, empty and zero vectors, and those with
    null or non-finite components, link with nothing, nor do vectors of different length. Rows count and link whatever their vec_id: rows
    of one id stay rows of their own, and rows without an id are counted and join what they link; a component of such rows alone has a null
    component_id. kept is vec_id = component_id; where component_id is null it is true. Other columns are ignored; an empty table gives no rows.
    """
    x = F.col("x")
    sound = F.coalesce((F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast("float" if single else "double")).alias("x"))
    rows = rows.withColumn("sound", sound).withColumn("x", F.when(F.col("sound"), F.transform("x", lambda v: F.when(v == 0, 0.0).otherwise(v).cast("float" if single else "double"))))  # no negative zeros
    equal = [F.xxhash64("x").alias("x_a"), F.xxhash64(F.lit(1), "x").alias("x_b")]
    number = "<f4" if single else "<f8"

    def raw(batches):
        for b in batches:
            data = [np.asarray(v.values, number).tobytes() for v in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(data, pa.binary())], ["rep", "n", "x_a", "x_b", "x"])

    classes = rows.where("sound").groupBy("x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("x", "rep", "n", *equal)
    classes = classes.mapInArrow(raw, "rep long, n long, x_a long, x_b long, x binary").withColumn("num", F.monotonically_increasing_id())
    classes = cut(classes, "polytope-classes")  # a vector's number is the one written
    found = links(classes, least, number)
    more = found.groupBy("num").agg(F.sum("more").alias("more"))
    labels = connected_components(found.select(F.col("num").alias("u"), F.col("root").alias("v")), "polytope-cc")
    named = classes.select("num", "rep", "n", "x_a", "x_b").join(more, "num", "left").join(labels, F.col("num") == F.col("node"), "left").withColumn("group", F.coalesce("component", "num"))
    named = cut(named.select("group", "rep", "x_a", "x_b", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")), "polytope-named")
    least_id = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    known = cut(named.join(least_id, "group").select("x_a", "x_b", "n_links", "component_id"), "polytope-known")
    drop(found, classes, named)
    out = rows.select("vec_id", "sound", *(F.when(F.col("sound"), c).alias(name) for c, name in zip(equal, ("x_a", "x_b"), strict=True))).join(known, ["x_a", "x_b"], "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
