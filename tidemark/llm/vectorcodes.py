"""Product codes of integer vectors, whose nearest entries are searched behind segment-mean lower bounds.

A vector is cut into equal parts, and each part is coded by the nearest entry of its own codebook. The search goes from coarse to fine: a part is
split into 1, 2, 4 ... blocks. What its block means differ from an entry's, and what is left of both once the means are taken out, bound their distance
from below: |x - c|^2 >= sum over blocks of (sum x - sum c)^2 / length + (residual norm of x - that of c)^2. Entries whose bound is above the
distance of one already measured are out; bounds are lowered by more than floating point can err, so no nearest entry is lost. Exact integer
distances of the entries that survive decide.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop, hint_small

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a table whose scaled components stay below this are kept in 64-bit integers; others in integers of any size.
WIDE = 1 << 24
#: Share of a bound's operands by which it is lowered.
SLACK = 1e-6
#: Vectors compared at a time; share of pairs left below which pairs are looked at one by one.
BLOCK, SPARSE = 2048, 0.125
LONG_MAX = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds neither null nor non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(values: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as integers of any size."""
    if not wide:
        return np.floor(values.astype(np.float64) * scale).astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale)) for x in values.astype(np.float64).ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


@dataclass
class Level:
    """One split of a part: where blocks start, and of each codebook entry the block sums over root lengths, their squares' sum and the residual norm."""

    starts: np.ndarray
    roots: np.ndarray
    means: np.ndarray
    squares: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, starts: np.ndarray, values: np.ndarray) -> Level:
        roots = np.sqrt(np.diff(np.append(starts, values.shape[1])))
        means = np.add.reduceat(values, starts, axis=1) / roots
        squares = (means**2).sum(1)
        return cls(starts, roots, means, squares, np.sqrt(np.maximum((values**2).sum(1) - squares, 0)))

    def apply(self, values: np.ndarray) -> Level:
        return Level.of(self.starts, values)


def _first_least(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each row's least value stands first; rows are 0, 1, 2 ... in order, each at least once."""
    least = np.minimum.reduceat(values, np.flatnonzero(np.append(True, row[1:] != row[:-1])))
    at = np.flatnonzero(values == least[row])
    return at[np.append(True, row[at][1:] != row[at][:-1])]


class Book:
    """A codebook of one part with the levels of its entries' block means."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        width = entries.shape[1]
        self.wide = entries.dtype == object
        self.levels: list[Level] = []
        if not self.wide and width > 1:
            plain = entries.astype(np.float64)
            self.norms = (plain**2).sum(1)
            blocks = 1
            while blocks < width:
                self.levels.append(Level.of(np.array([x[0] for x in np.array_split(np.arange(width), blocks)]), plain))
                blocks *= 2

    def exact(self, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Integer squared distances of pairs of vectors and entries."""
        return ((rows - self.entries[entries]) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row of x, the lower index of equals."""
        n, entries = len(x), len(self.entries)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, x.dtype)
        if x.shape[1] == 0:
            return np.zeros(n, np.int64), np.zeros(n, x.dtype)
        row, entry = self._survivors(x) if self.levels else (np.repeat(np.arange(n), entries), np.tile(np.arange(entries), n))
        far = self.exact(x[row], entry)
        first = _first_least(row, far)
        return entry[first], far[first]

    def _survivors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (row, entry), in order, whose entry may be the nearest."""
        n, plain = len(x), x.astype(np.float64)
        slack = SLACK * ((plain**2).sum(1)[:, None] + self.norms[None, :]) + SLACK
        bound = np.full(n, np.inf)  # the distance of the nearest entry measured so far
        alive, row, entry = None, None, None
        for book in self.levels:
            own = book.apply(plain)
            if row is None:
                low = own.squares[:, None] + book.squares[None, :] - 2 * own.means @ book.means.T + (own.rest[:, None] - book.rest[None, :]) ** 2 - slack
                if alive is not None:
                    low[~alive] = np.inf
                chosen = low.argmin(1)
                bound = np.minimum(bound, self.exact(x, chosen))
                alive = low <= bound[:, None]
                if alive.mean() < SPARSE:
                    row, entry = np.nonzero(alive)
            else:
                low = ((own.means[row] - book.means[entry]) ** 2).sum(1) + (own.rest[row] - book.rest[entry]) ** 2 - slack[row, entry]
                first = _first_least(row, low)
                bound = np.minimum(bound, self.exact(x, entry[first]))
                stay = low <= bound[row]
                row, entry = row[stay], entry[stay]
        return np.nonzero(alive) if row is None else (row, entry)


@dataclass
class Codebooks:
    """entries: (part, index, position) integers; dimension is that of the vectors coded."""

    entries: np.ndarray
    dimension: int
    scale: int

    @property
    def wide(self) -> bool:
        return self.entries.dtype == object

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _parts(batch: pa.ListArray, books: Codebooks):
    """Blocks of vectors as integers by part: (vectors, parts, width)."""
    values = np.asarray(batch.flatten()).reshape(len(batch), books.dimension)
    for at in range(0, len(values), BLOCK):
        block = scaled(values[at : at + BLOCK], books.scale, books.wide)
        yield block.reshape(len(block), len(books.entries), books.entries.shape[2])


def _whole(df: DataFrame, books: Codebooks) -> DataFrame:
    return df.where(F.size("embedding") == books.dimension)


def _sums(kept: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> number of parts assigned to it, and their sums: at most one row for each entry comes to the driver.

    A task adds up its own rows first. Integers of any size travel as text.
    """
    parts, entries, width = books.entries.shape
    kind = "string" if books.wide else "bigint"

    def run(batches):
        own = [Book(e) for e in books.entries]
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), books.entries.dtype)
        for b in batches:
            for block in _parts(b.column(0), books):
                for p in range(parts):
                    code, _ = own[p].nearest(block[:, p])
                    count[p] += np.bincount(code, minlength=entries)
                    np.add.at(total[p], code, block[:, p])
        part, entry = np.nonzero(count)
        values = [[str(v) for v in x] if books.wide else x for x in total[part, entry].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(values, pa.list_(pa.string() if books.wide else pa.int64()))], ["part", "entry", "n", "sums"])

    found = _whole(kept, books).select("embedding").mapInArrow(run, f"part int, entry int, n long, sums array<{kind}>")
    if books.wide:
        def added(key, pdf):
            return pdf.iloc[:1].assign(n=pdf["n"].sum(), sums=[[str(sum(map(int, v))) for v in zip(*pdf["sums"], strict=True)]])

        rows = found.groupBy("part", "entry").applyInPandas(added, found.schema).collect()
        return {(r["part"], r["entry"]): (r["n"], [int(x) for x in r["sums"]]) for r in rows}
    rows = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(width))).alias("sums")).collect()
    return {(r["part"], r["entry"]): (r["n"], list(r["sums"])) for r in rows}


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks for kept (vec_id, embedding), whose vectors are usable; None without any.

    Each codebook starts as the parts of the vectors with the smallest ids, as many as there are entries or vectors; null ids come last, equal ids by
    their vectors. In each round every part of every vector goes to its nearest entry, and the entry moves to the floor of their mean.
    """
    lengths = kept.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("most"))
    most = lengths.orderBy(F.desc("n"), "d").first()
    if most is None:
        return None
    dimension = most["d"]
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components have no {parts} equal parts")
    first = kept.where(F.size("embedding") == dimension).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    start = scaled(np.array([r["embedding"] for r in first], np.float64).reshape(len(first), dimension), scale, (most["most"] or 0) * scale >= WIDE)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, dimension // parts).transpose(1, 0, 2)), dimension, scale)
    for _ in range(rounds):
        for (part, entry), (n, sums) in _sums(kept, books).items():
            books.entries[part, entry] = [s // n for s in sums]
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code string, error long): two hex digits for each part's entry (four above 256 entries), squared distances summed over parts.

    Vectors of another length than the codebooks' have neither code nor error; errors beyond a long are its largest value.
    """
    digits = 2 if books.entries.shape[1] <= 256 else 4

    def run(batches):
        own = [Book(e) for e in books.entries]
        for b in batches:
            codes, errors = [], []
            for block in _parts(b.column(2), books):
                found = [own[p].nearest(block[:, p]) for p in range(len(own))]
                codes += ["".join(f"{c:0{digits}x}" for c in row) for row in zip(*(c.tolist() for c, _ in found), strict=True)]
                errors += [min(e, LONG_MAX) for e in sum(d for _, d in found).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    schema = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    own = _whole(kept, books).select("vec_id", "label", "embedding").mapInArrow(run, schema)
    other = kept.where(F.size("embedding") != books.dimension).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return own.unionByName(other)


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """coded (code, ...) with decoded array<float>: the entries that the code names, scaled back; null without a code."""
    digits = 2 if books.entries.shape[1] <= 256 else 4
    plain = (books.entries.astype(np.float64) / books.scale).astype(np.float32)

    @F.pandas_udf("array<float>")
    def decoded(codes):
        return codes.map(lambda c: None if c is None else np.concatenate([plain[p, int(c[p * digits : (p + 1) * digits], 16)] for p in range(len(plain))]))

    return coded.withColumn("decoded", decoded("code"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) for the usable vectors of vectors (vec_id, embedding, label, ...), and the codebooks, fitted on all of them.

    Null vectors and those with null or non-finite components are left out. The dimension is the most frequent length; vectors of another one
    keep their row without a code. Repeated rows have a row each, whatever their ids. Other columns are not read. An empty table has no codebooks.
    """
    kept = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(usable(F.col("embedding"))), "vector-kept")
    books = fit(kept, parts, entries, rounds, scale)
    if books is None:
        empty = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, None
    coded = cut(encode(kept, books), "vector-codes")
    drop(kept)
    return coded, books


def label_errors(coded: DataFrame) -> DataFrame:
    """coded (label, error, ...) with label_error long: the errors of the rows with an equal label, nulls together; null where no row has one."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when(total > LONG_MAX, LONG_MAX).otherwise(total.cast("long"))
    by_label = cut(coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error")), "label-errors")
    return coded.join(hint_small(by_label), coded["label"].eqNullSafe(by_label["of_label"])).drop("of_label")
