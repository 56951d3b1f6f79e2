"""A two-layer graph network trained on sampled neighbourhoods: Spark samples and joins, tasks add up gradients, the driver holds weights alone.

A node's first layer reads its own features and the mean of all its neighbours', which no weight changes: they are joined once. For the second layer each
labelled node gets a sample of its neighbours with the same. In each step tasks compute the gradients of their nodes of a mini-batch, and
their sum, as wide as the weights, makes a step of Adam. Scoring reads all neighbours of all nodes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.huber import _sums
from tidemark.operators.pivots import _vectors
from tidemark.operators.tables import settled

#: Widths of the layers, epochs, epochs of further training, step, penalty, share of each label that validates, epochs without a better one (fixed values).
HIDDEN, EPOCHS, MORE_EPOCHS, RATE, PENALTY, VALIDATE, PATIENCE = (64, 32), 60, 20, 3e-3, 1e-4, 0.15, 8
#: Neighbours sampled for a node, mini-batches of an epoch, ranges of scores in the area under the curve.
FAN, BATCHES, RANGES = 15, 3, 4096
#: Parts in which a hub's neighbours are sampled before they meet.
SALT = 64
MODEL = "features array<string>, shapes array<array<int>>, weights array<double>, first array<double>, second array<double>, steps long"


@dataclass
class Sage:
    """Weights of two layers over (own, mean of neighbours) and an output; rows are scaled to length 1 after each layer. first, second: Adam's means."""

    features: list[str]
    params: list[np.ndarray]
    first: list[np.ndarray] = field(default_factory=list)
    second: list[np.ndarray] = field(default_factory=list)
    steps: int = 0

    @classmethod
    def new(cls, features: list[str], seed: int = 42) -> Sage:
        rng, width = np.random.default_rng(seed), len(features)
        sizes = [(2 * width, HIDDEN[0]), (2 * HIDDEN[0], HIDDEN[1]), (HIDDEN[1], 1)]
        params = [p for a, b in sizes for p in (rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
        return cls(features, params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params])

    def layer(self, k: int, both: np.ndarray) -> np.ndarray:
        return self._layer(k, both)[0]

    def _layer(self, k: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        active = np.maximum(both @ self.params[2 * k] + self.params[2 * k + 1], 0)
        length = np.maximum(np.linalg.norm(active, axis=1, keepdims=True), 1e-8)
        return active / length, active, length

    def out(self, h: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(h @ self.params[4] + self.params[5], -20, 20)))[:, 0]

    def probabilities(self, z: np.ndarray, near: np.ndarray, of: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of nodes z with sampled neighbours near, of whom `of` tells the node and weight the edge's."""
        return self.out(self.layer(1, np.concatenate([self.layer(0, z), _mean(self.layer(0, near), of, weight, len(z))], 1)))

    def gradients(self, z: np.ndarray, near: np.ndarray, of: np.ndarray, weight: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Gradients by params and value of the weighted cross entropy, both summed over nodes."""
        own, own_active, own_length = self._layer(0, z)
        other, other_active, other_length = self._layer(0, near)
        both = np.concatenate([own, _mean(other, of, weight, len(z))], 1)
        unit, active, length = self._layer(1, both)
        p = np.clip(self.out(unit), 1e-12, 1 - 1e-12)
        loss = -(share * np.where(y == 1, np.log(p), np.log(1 - p))).sum()
        g = ((p - y) * share)[:, None]
        grads: list[np.ndarray] = [None] * 6
        grads[4], grads[5] = unit.T @ g, g.sum(0)
        g = _back(g @ self.params[4].T, unit, active, length)
        grads[2], grads[3] = both.T @ g, g.sum(0)
        g = g @ self.params[2].T
        half = own.shape[1]
        total = np.bincount(of, weight, len(z))
        g_other = g[:, half:][of] * (weight / np.maximum(total[of], 1e-300))[:, None] if len(of) else np.zeros((0, half))
        g_own, g_other = _back(g[:, :half], own, own_active, own_length), _back(g_other, other, other_active, other_length)
        grads[0], grads[1] = z.T @ g_own + near.T @ g_other, g_own.sum(0) + g_other.sum(0)
        return grads, float(loss)


def _mean(h: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weighted means of the rows of h by node; 0 without rows."""
    out = np.zeros((n, h.shape[1]))
    np.add.at(out, of, h * weight[:, None])
    return out / np.maximum(np.bincount(of, weight, n), 1e-300)[:, None]


def _back(g: np.ndarray, unit: np.ndarray, active: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The gradient before scaling to length 1 and the ramp."""
    return (g - unit * (g * unit).sum(1, keepdims=True)) / length * (active > 0)


def _neighbour_means(h: DataFrame, graph: DataFrame, width: int) -> DataFrame:
    """(account_id, h, m): h with the weighted mean of all neighbours' h, zeros without neighbours."""
    each = h.select(F.col("account_id").alias("dst"), "h")
    sums = [F.sum(F.col("h")[n] * F.col("weight")) / F.sum("weight") for n in range(width)]
    mean = graph.join(each, "dst").groupBy(F.col("src").alias("account_id")).agg(F.array(*sums).alias("m"))
    return h.join(mean, "account_id", "left").select("account_id", "h", F.coalesce("m", F.array_repeat(F.lit(0.0), width)).alias("m"))


def _read(nodes: DataFrame, graph: DataFrame, features: list[str]) -> DataFrame:
    """(account_id, z): each node's features and the mean of its neighbours'."""
    h = nodes.where("account_id IS NOT NULL").select("account_id", F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features)).alias("h"))
    return _neighbour_means(h, graph, len(features)).select("account_id", F.concat("h", "m").alias("z"))


def _sampled(graph: DataFrame, seed: int) -> DataFrame:
    """FAN edges of each node at most, those with the least hash. A hub's edges are first sampled in SALT parts."""
    placed = graph.withColumns({"__h": F.xxhash64(F.lit(seed), "src", "dst"), "__salt": F.pmod(F.xxhash64("dst"), F.lit(SALT))})
    for by in (["src", "__salt"], ["src"]):
        placed = placed.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__h", "dst"))).where(F.col("__n") <= FAN)
    return placed.select("src", "dst", "weight")


def training_rows(nodes: DataFrame, graph: DataFrame, features: list[str], label: str, seed: int = 42) -> DataFrame:
    """(part, y, z, near): all labelled nodes with their sampled neighbours; part -1 validates, a share of each label by a hash, others are the mini-batches."""
    z = settled(_read(nodes, graph, features))
    asked = nodes.where(F.col("account_id").isNotNull() & F.col(label).isNotNull()).select("account_id", F.col(label).cast("int").alias("y"))
    near = _sampled(graph.join(asked.select(F.col("account_id").alias("src")), "src", "left_semi"), seed).join(z.select(F.col("account_id").alias("dst"), "z"), "dst")
    near = near.groupBy(F.col("src").alias("account_id")).agg(F.collect_list(F.struct("weight", "z")).alias("near"))  # FAN at most
    place = F.pmod(F.xxhash64(F.lit(seed), "account_id"), F.lit(1 << 20))
    part = F.when(place < int(VALIDATE * (1 << 20)), -1).otherwise(place % BATCHES).cast("int")
    none = F.array().cast("array<struct<weight:double,z:array<double>>>")
    near = near.withColumn("near", F.col("near").cast("array<struct<weight:double,z:array<double>>>"))
    return settled(asked.join(z, "account_id").join(near, "account_id", "left").select(part.alias("part"), "y", "z", F.coalesce("near", none).alias("near")))


def _batch(b):
    """(z, near, of, weight, y) of a record batch (y, z, near)."""
    y, z, near = np.asarray(b.column(0), np.float64), _vectors(b.column(1)), b.column(2)
    of = np.repeat(np.arange(len(y)), np.diff(np.asarray(near.offsets)))
    rows = near.flatten()
    return z, (_vectors(rows.field("z")) if len(rows) else np.zeros((0, z.shape[1]))), of, np.asarray(rows.field("weight"), np.float64), y


def _step_sums(rows: DataFrame, net: Sage, share: tuple[float, float]) -> tuple[np.ndarray, float, float]:
    """Gradients in one row, loss and number of the rows."""
    width = sum(p.size for p in net.params)

    def run(batches):
        out = np.zeros(width + 2)
        for b in batches:
            if not b.num_rows:
                continue
            z, near, of, weight, y = _batch(b)
            grads, loss = net.gradients(z, near, of, weight, y, np.where(y == 1, share[1], share[0]))
            out += np.concatenate([*(g.ravel() for g in grads), [loss, len(y)]])
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["a"])

    s = _sums(rows.select("y", "z", "near").mapInArrow(run, "a array<double>"), width + 2)
    return s[:width], s[width], s[width + 1]


def _auc(rows: DataFrame, net: Sage) -> float | None:
    """Area under the curve of rows, scores of one of RANGES ranges tied; None without both labels."""

    def run(batches):
        out = np.zeros(2 * RANGES)
        for b in batches:
            if b.num_rows:
                *parts, y = _batch(b)
                at = np.minimum((net.probabilities(*parts) * RANGES).astype(int), RANGES - 1)
                out += np.bincount(at + RANGES * y.astype(int), minlength=2 * RANGES)
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["a"])

    neg, pos = _sums(rows.select("y", "z", "near").mapInArrow(run, "a array<double>"), 2 * RANGES).reshape(2, RANGES)
    if not neg.sum() or not pos.sum():
        return None
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))


def train(net: Sage, rows: DataFrame, epochs: int = EPOCHS, patience: int = PATIENCE) -> Sage:
    """The network after epochs over training_rows(), with the weights of the best area under the curve of the rows that validate; training ends `patience`
    epochs after these. Adam goes on from the network's own state. Both labels weigh the same."""
    counts = {(r["part"], r["y"]): r["count"] for r in rows.where("part >= 0").groupBy("part", "y").count().collect()}  # two rows a mini-batch
    n = [sum(v for (_, y), v in counts.items() if y == label) for label in (0, 1)]
    share = tuple(sum(n) / (2 * max(1, k)) for k in n)
    net = Sage(net.features, [p.copy() for p in net.params], [p.copy() for p in net.first], [p.copy() for p in net.second], net.steps)
    best, kept, since = -1.0, None, 0
    ends = np.cumsum([p.size for p in net.params])[:-1]
    for _ in range(epochs):
        for part in sorted({p for p, _ in counts}):
            flat, _, size = _step_sums(rows.where(F.col("part") == part), net, share)
            net.steps += 1
            for k, (g, p) in enumerate(zip(np.split(flat / max(size, 1), ends), net.params, strict=True)):
                g = g.reshape(p.shape) + (PENALTY * p if k % 2 == 0 else 0)
                net.first[k] += 0.1 * (g - net.first[k])
                net.second[k] += 0.001 * (g * g - net.second[k])
                p -= RATE * (net.first[k] / (1 - 0.9**net.steps)) / (np.sqrt(net.second[k] / (1 - 0.999**net.steps)) + 1e-8)
        auc = _auc(rows.where("part = -1"), net)
        if auc is None:
            continue
        since += 1
        if auc > best:
            best, kept, since = auc, [p.copy() for p in net.params], 0
        elif since >= patience:
            break
    if kept is not None:
        net.params = kept
    return net


def fit(nodes: DataFrame, graph: DataFrame, features: list[str], label: str, epochs: int = EPOCHS, seed: int = 42) -> Sage:
    """A network on all labelled nodes (account_id, features..., label); graph: (src, dst, weight), an edge's ends among the nodes. A missing feature is 0."""
    return train(Sage.new(features, seed), training_rows(nodes, graph, features, label, seed), epochs)


def more(net: Sage, nodes: DataFrame, graph: DataFrame, label: str, epochs: int = MORE_EPOCHS, seed: int = 43) -> Sage:
    """The network trained further, on other nodes or other samples."""
    return train(net, training_rows(nodes, graph, net.features, label, seed), epochs)


def scored(net: Sage, nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(account_id, probability, score 0 to 100) for all nodes, from all their neighbours."""
    kind = nodes.schema["account_id"].dataType.simpleString()

    def first(batches):
        for b in batches:
            z = _vectors(b.column(1)) if b.num_rows else np.zeros((0, 2 * len(net.features)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(net.layer(0, z)), pa.list_(pa.float64()))], ["account_id", "h"])

    def last(batches):
        for b in batches:
            both = np.concatenate([_vectors(b.column(1)), _vectors(b.column(2))], 1) if b.num_rows else np.zeros((0, 2 * HIDDEN[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.out(net.layer(1, both)))], ["account_id", "probability"])

    h = settled(_read(nodes, graph, net.features).mapInArrow(first, f"account_id {kind}, h array<double>"))
    out = _neighbour_means(h, graph, HIDDEN[0]).mapInArrow(last, f"account_id {kind}, probability double")
    return out.select("account_id", "probability", F.bround(F.col("probability") * 100, 1).alias("score"))


def save(net: Sage, folder: str, spark: SparkSession) -> None:
    flat = [np.concatenate([p.ravel() for p in ps]).tolist() for ps in (net.params, net.first, net.second)]
    spark.createDataFrame([(net.features, [list(p.shape) for p in net.params], *flat, net.steps)], MODEL).coalesce(1).write.mode("overwrite").parquet(folder)


def load(folder: str, spark: SparkSession) -> Sage:
    r = spark.read.schema(MODEL).parquet(folder).first()
    if r is None:
        raise ValueError(f"no whole model in {folder}")
    ends = np.cumsum([int(np.prod(s)) for s in r["shapes"]])[:-1]
    params, first, second = ([p.reshape(s) for p, s in zip(np.split(np.array(r[c]), ends), r["shapes"], strict=True)] for c in ("weights", "first", "second"))
    return Sage(list(r["features"]), params, first, second, r["steps"])
