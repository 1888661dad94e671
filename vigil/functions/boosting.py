"""Gradient boosting of softmax trees from grouped histograms.

Features are cut into bins once. Each round grows one tree for each class, level by level, all classes at once: tasks sum
gradients and curvatures by (class, node, feature, bin), Spark adds these up, and the driver, which sees sums only (their
number follows the trees, not the rows), takes the split with the largest gain in each node. Rows hold
their bins, class and scores; every KEEP rounds the scores are written, so a pass applies few trees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.sources.store import store

BINS, KEEP = 64, 10
#: What keeps leaves small (added to curvature) and the least curvature of a child.
SHRINK, LEAST = 1.0, 1e-3


@dataclass
class Round:
    """One tree a class, all of one depth: feature and last bin that goes left of each inner node, and the leaves' values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def leaves(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The node of each row in each class's tree, after `depth` levels, numbered within its level."""
        levels = int(np.log2(self.leaf.shape[1])) if depth is None else depth
        node = np.zeros((len(bins), len(self.feature)), np.int64)
        rows, classes = np.arange(len(bins))[:, None], np.arange(len(self.feature))[None, :]
        for level in range(levels):
            at = (1 << level) - 1 + node
            right = bins[rows, self.feature[classes, at]] > self.cut[classes, at]
            node = 2 * node + right
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.leaf[np.arange(len(self.leaf))[None, :], self.leaves(bins)]


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]
    classes: int
    start: np.ndarray
    rounds: list[Round] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bins of rows: 0 for a missing value, else 1 + the number of edges below it."""
        out = [np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x, "left")) for x, e in zip(columns, self.edges)]
        return np.stack(out, 1).astype(np.uint8)

    def scores(self, bins: np.ndarray, rounds: list[Round] | None = None) -> np.ndarray:
        out = np.tile(self.start, (len(bins), 1)) if rounds is None else np.zeros((len(bins), self.classes))
        for r in self.rounds if rounds is None else rounds:
            out += r.values(bins)
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """df with probability (an array, by class) and prediction (the likeliest class)."""
        held, names = df.sparkSession.sparkContext.broadcast(self), df.columns
        values = F.array(*[F.col(c).cast("double") for c in self.features]).alias("_values")

        def run(batches):
            m = held.value
            for batch in batches:
                rows = batch.num_rows
                x = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)
                p = softmax(m.scores(m.binned(list(x.T))))
                offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * m.classes)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(p.ravel())), pa.array(p.argmax(1).astype(float))], [*names, "probability", "prediction"])

        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["probability array<double>", "prediction double"])
        return df.select(*names, values).mapInArrow(run, schema)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _histograms(rows: DataFrame, model: Boosted, since: list[Round], growing: Round, depth: int, weights: np.ndarray) -> np.ndarray:
    """Sums of gradient and curvature: class, node of the level, feature, bin, 2."""
    k, f, nodes = model.classes, len(model.features), 1 << depth
    held = rows.sparkSession.sparkContext.broadcast((model, since, growing, weights))

    def run(batches):
        m, new, tree, weight = held.value
        out = np.zeros((k * nodes * f * (BINS + 1), 2))
        for batch in batches:
            n = batch.num_rows
            bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(n, f)
            kept = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, k)
            y = batch.column(2).to_numpy(zero_copy_only=False).astype(int)
            p, w = softmax(kept + m.scores(bins, new)), weight[y][:, None]
            g = (p - (y[:, None] == np.arange(k))) * w
            h = np.maximum(p * (1 - p), 1e-6) * w
            node = tree.leaves(bins, depth)
            for c in range(k):
                for j in range(f):
                    at = ((c * nodes + node[:, c]) * f + j) * (BINS + 1) + bins[:, j]
                    out[:, 0] += np.bincount(at, g[:, c], len(out))
                    out[:, 1] += np.bincount(at, h[:, c], len(out))
        used = np.flatnonzero(out[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used, 0]), pa.array(out[used, 1])], ["cell", "g", "h"])

    sums = rows.select("bins", "scores", "y").mapInArrow(run, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    out = np.zeros((k * nodes * f * (BINS + 1), 2))
    out[sums["cell"]] = sums[["g", "h"]].to_numpy()
    return out.reshape(k, nodes, f, BINS + 1, 2)


def _grow(hist: np.ndarray, tree: Round, depth: int, rate: float, last: bool) -> None:
    """Takes the best split of each node of a level; the values of its children if it is the last."""
    k, nodes = hist.shape[:2]
    left = np.cumsum(hist, 3)[:, :, :, :-1]  # bins up to the cut go left
    total = hist.sum(3)[:, :, :1]
    right = total[:, :, :, None] - left
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + SHRINK)
    gain = worth(left) + worth(right) - worth(total)[..., None]
    gain[(left[..., 1] < LEAST) | (right[..., 1] < LEAST)] = -1
    flat = gain.reshape(k, nodes, -1)
    best = flat.argmax(2)
    at = (1 << depth) - 1 + np.arange(nodes)
    split = np.take_along_axis(flat, best[..., None], 2)[..., 0] > 1e-9
    tree.feature[:, at] = np.where(split, best // BINS, 0)
    tree.cut[:, at] = np.where(split, best % BINS, BINS + 1)  # no split: all go left
    if last:
        pick = lambda s: np.take_along_axis(s.reshape(k, nodes, -1, 2), best[..., None, None], 2)[:, :, 0]
        l, r = np.where(split[..., None], pick(left), total[:, :, 0]), np.where(split[..., None], pick(right), 0)
        value = lambda s: -rate * s[..., 0] / (s[..., 1] + SHRINK)
        tree.leaf[:, 0::2], tree.leaf[:, 1::2] = value(l), value(r)


def fit(df: DataFrame, features: list[str], label: str, classes: int, rounds: int = 40, depth: int = 3, rate: float = 0.2, balanced: bool = True) -> Boosted:
    """Boosted trees for label (0 to classes - 1; other rows take no part). balanced: classes weigh the same, whatever their rows."""
    df = df.where(F.col(label).between(0, classes - 1))
    marks = [i / (BINS - 1) for i in range(1, BINS - 1)]
    edges = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), marks, 10_000).alias(f"e{i}") for i, c in enumerate(features)]).first()
    counts = {int(r[0]): r[1] for r in df.groupBy(F.col(label).cast("int")).count().collect()}
    sizes = np.array([counts.get(c, 0) for c in range(classes)], float)
    model = Boosted(features, [np.unique(np.array(e if e is not None else [0.0], float)) for e in edges], classes, np.zeros(classes))
    if not sizes.sum():
        return model
    weights = np.where(sizes > 0, sizes.sum() / (max((sizes > 0).sum(), 1) * np.maximum(sizes, 1)), 0) if balanced else np.ones(classes)
    share = np.maximum(sizes * weights, 1e-9)
    model.start = np.log(share / share.sum())
    held = df.sparkSession.sparkContext.broadcast(model)

    def bins(batches):
        m = held.value
        for batch in batches:
            n = batch.num_rows
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            b = m.binned(list(x.T))
            s = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.classes), pa.array(np.tile(m.start, n)))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in b], pa.binary()), s, batch.column(1)], ["bins", "scores", "y"])

    def keep(new: list[Round]):
        sent = df.sparkSession.sparkContext.broadcast(new)

        def run(batches):
            for batch in batches:
                n = batch.num_rows
                b = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(n, -1)
                s = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) + held.value.scores(b, sent.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel())), batch.column(2)], ["bins", "scores", "y"])

        return run

    schema = "bins binary, scores array<double>, y int"
    rows = store(df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(label).cast("int").alias("y")).mapInArrow(bins, schema))
    since: list[Round] = []
    for _ in range(rounds):
        tree = Round(np.zeros((classes, (1 << depth) - 1), np.int64), np.full((classes, (1 << depth) - 1), BINS + 1), np.zeros((classes, 1 << depth)))
        for level in range(depth):
            _grow(_histograms(rows, model, since, tree, level, weights), tree, level, rate, level == depth - 1)
        model.rounds.append(tree)
        since.append(tree)
        if len(since) == KEEP:
            rows, since = store(rows.mapInArrow(keep(since), schema)), []
    return model
