"""Boosted trees for any number of classes: a tree for each class a round, splits from histograms that Spark sums."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Gradients are summed as whole numbers of this part of one, so that sums don't depend on how rows are dealt out.
UNIT = 1 << 22
#: Rows, about, that the bins' bounds are taken from.
SAMPLE = 200_000


@dataclass
class Tree:
    """Nodes by number (the children of k are 2k + 1 and 2k + 2): feature and bin of a split, -1 and a value for a leaf."""

    feature: list[int]
    bin: list[int]
    value: list[float]

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The value of the leaf that each row of binned features comes to."""
        feature, cut, value = np.array(self.feature), np.array(self.bin), np.array(self.value)
        at = np.zeros(len(bins), np.int64)
        for _ in range(depth):
            f = feature[at]
            inner = f >= 0
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]


@dataclass
class BoostedModel:
    """Trees by round and class over binned features, with a score for each class to begin with."""

    features: list[str]
    bounds: list[list[float]]
    start: list[float]
    depth: int
    trees: list[list[Tree]] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bin numbers: 0 for what is missing, then 1 more than the bounds below the value."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.int16)
        for k, x in enumerate(columns):
            known = np.isfinite(x)
            out[known, k] = 1 + np.searchsorted(np.array(self.bounds[k]), x[known], side="left")
        return out

    def add(self, scores: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
        for trees in rounds:
            for k, tree in enumerate(trees):
                scores[:, k] += tree.leaves(bins, self.depth)
        return scores

    def transform(self, df: DataFrame) -> DataFrame:
        """df with `probability` (an array, class by class) and `prediction` (the likeliest; of equal ones the first)."""
        model = self

        @F.pandas_udf("struct<probability: array<double>, prediction: double>")
        def score(rows: pd.Series) -> pd.DataFrame:
            x = np.array(rows.tolist(), float).reshape(len(rows), len(model.features))
            bins = model.binned(list(x.T))
            p = softmax(model.add(np.tile(model.start, (len(x), 1)), bins, model.trees))
            return pd.DataFrame({"probability": list(p), "prediction": p.argmax(axis=1).astype(float)})

        numbers = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in self.features])
        at = "_scored"
        while at.lower() in {c.lower() for c in df.columns}:
            at += "_"
        rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("probability", "prediction")]
        return df.withColumn(at, score(numbers)).select(*rest, F.col(f"{at}.probability").alias("probability"), F.col(f"{at}.prediction").alias("prediction"))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        found = json.loads(spark.read.text(path).first()[0])
        found["trees"] = [[Tree(**t) for t in trees] for trees in found["trees"]]
        return cls(**found)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int64)


@dataclass
class Boosted:
    """Learns BoostedModel from numeric columns and a label of 0 to K - 1.

    Each round fits a tree for every class to the gradients of the softmax loss. A level of all K trees
    takes one pass: each partition sums gradients, curvatures and rows by class, node, feature and bin,
    Spark adds those up, and the driver, which sees K * nodes * features * bins sums whatever the number of
    rows, takes the best splits. Rows that a later round begins with carry their scores, written every
    `keep_every` rounds. Sums are of whole numbers, so the trees don't depend on partitions. Null and
    non-finite values have a bin of their own, left of all others. Rows without a label are left out.
    """

    features: list[str]
    label: str
    rounds: int = 20
    depth: int = 3
    bins: int = 32
    rate: float = 0.2
    smooth: float = 1.0
    least: int = 20
    keep_every: int = 10

    def fit(self, df: DataFrame) -> BoostedModel:
        spark = df.sparkSession
        numbers = [F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(self.features)]
        rows = df.where(F.col(f"`{self.label}`").isNotNull()).select(*numbers, F.col(f"`{self.label}`").cast("int").alias("y"))
        counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if not counts or min(counts) < 0:
            raise ValueError("labels must be numbers from 0")
        total, n_classes = sum(counts.values()), max(counts) + 1
        start = [float(np.log(max(counts.get(k, 0), 0.5) / total)) for k in range(n_classes)]
        model = BoostedModel(list(self.features), self._bounds(rows, total), start, self.depth)
        rows = rows.mapInArrow(_bin_rows(model), "bins binary, y int, scores binary")
        rows, done = rows.persist(), 0
        try:
            while len(model.trees) < self.rounds:
                model.trees.append(self._round(rows, model, model.trees[done:]))
                if len(model.trees) - done == self.keep_every and len(model.trees) < self.rounds:
                    old, rows, done = rows, rows.mapInArrow(_add_scores(model, model.trees[done:]), rows.schema).persist(), len(model.trees)
                    rows.count()
                    old.unpersist()
        finally:
            rows.unpersist()
        return model

    def _bounds(self, rows: DataFrame, total: int) -> list[list[float]]:
        """At most bins - 2 bounds of each feature: exact quantiles of a sample by hash of the rows."""
        share = min(1.0, SAMPLE / total)
        keep = F.xxhash64("y", *(f"x{k}" for k in range(len(self.features)))) <= F.lit(min(int(share * (1 << 64)), (1 << 64) - 1) - (1 << 63))
        points = [F.lit((k + 1) / (self.bins - 1)) for k in range(self.bins - 2)]
        finite = [F.when(~F.isnan(f"x{k}") & (F.abs(f"x{k}") < float("inf")), F.col(f"x{k}")) for k in range(len(self.features))]
        found = rows.where(keep).agg(*[F.percentile(x, F.array(*points)).alias(f"b{k}") for k, x in enumerate(finite)]).first()
        return [sorted(set(b or [])) for b in found]

    def _round(self, rows: DataFrame, model: BoostedModel, since: list[list[Tree]]) -> list[Tree]:
        n_classes, size = len(model.start), (1 << (self.depth + 1)) - 1
        trees = [Tree([-1] * size, [0] * size, [0.0] * size) for _ in range(n_classes)]
        open_nodes = [(k, 0) for k in range(n_classes)]
        for level in range(self.depth):
            if not open_nodes:
                break
            made = self._histograms(rows, model, since, trees, open_nodes, level)
            following = []
            for (k, node), (g, h, n) in zip(open_nodes, made):
                best = self._split(g, h, n)
                if best is None:
                    trees[k].value[node] = self._leaf(g[0].sum(), h[0].sum())
                    continue
                f, b = trees[k].feature[node], trees[k].bin[node] = best
                if level + 1 < self.depth:
                    following += [(k, 2 * node + 1), (k, 2 * node + 2)]
                else:
                    trees[k].value[2 * node + 1] = self._leaf(g[f, : b + 1].sum(), h[f, : b + 1].sum())
                    trees[k].value[2 * node + 2] = self._leaf(g[f, b + 1 :].sum(), h[f, b + 1 :].sum())
            open_nodes = following
        return trees

    def _leaf(self, g: float, h: float) -> float:
        return float(-self.rate * g / (h + self.smooth))

    def _split(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[int, int] | None:
        """The feature and last bin of the left side that gain most; of equal gains the first."""
        gl, hl, nl = (x.cumsum(axis=1)[:, :-1] for x in (g, h, n))
        gr, hr, nr = g.sum(axis=1, keepdims=True) - gl, h.sum(axis=1, keepdims=True) - hl, n.sum(axis=1, keepdims=True) - nl
        gain = gl**2 / (hl + self.smooth) + gr**2 / (hr + self.smooth) - g[0].sum() ** 2 / (h[0].sum() + self.smooth)
        gain = np.where((nl >= self.least) & (nr >= self.least), gain, 0.0)
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        return (int(f), int(b)) if gain[f, b] > 1e-9 else None

    def _histograms(self, rows: DataFrame, model: BoostedModel, since: list[list[Tree]], trees: list[Tree], open_nodes: list[tuple[int, int]], level: int):
        n_features, n_bins, n_classes = len(self.features), self.bins, len(model.start)
        number = {node: i for i, node in enumerate(open_nodes)}
        slots = len(open_nodes) * n_features * n_bins

        def run(batches):
            sums = np.zeros((3, slots), np.int64)
            for batch in batches:
                bins, y, scores = _unpacked(batch, n_features, n_classes)
                p = softmax(model.add(scores, bins, since))
                for k in range(n_classes):
                    g, h = whole(p[:, k] - (y == k)), whole(np.maximum(p[:, k] * (1 - p[:, k]), 1e-6))
                    node = _nodes(trees[k], bins, level)
                    for at in np.unique(node).tolist():
                        if (k, at) not in number:
                            continue
                        here = node == at
                        for f in range(n_features):
                            slot = (number[k, at] * n_features + f) * n_bins + bins[here, f]
                            for m, w in enumerate((g[here], h[here], None)):
                                sums[m] += _whole_sums(slot, w, slots)
            used = np.flatnonzero(sums[2])
            yield pa.record_batch([used, *(s[used] for s in sums)], names=["slot", "g", "h", "n"])

        parts = rows.mapInArrow(run, "slot long, g long, h long, n long")
        out = np.zeros((3, slots))
        for r in parts.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect():
            out[:, r.slot] = r.g / UNIT, r.h / UNIT, r.n
        g, h, n = out.reshape(3, len(open_nodes), n_features, n_bins)
        return list(zip(g, h, n))


def _whole_sums(slot: np.ndarray, w: np.ndarray | None, size: int) -> np.ndarray:
    """Sums of whole numbers by slot; exact, as high and low halves are summed apart."""
    if w is None:
        return np.bincount(slot, minlength=size)
    high, low = w >> 16, w & 0xFFFF
    return (np.bincount(slot, high, size).astype(np.int64) << 16) + np.bincount(slot, low, size).astype(np.int64)


def _nodes(tree: Tree, bins: np.ndarray, level: int) -> np.ndarray:
    """The node of a level that each row is in; that of a leaf above stays."""
    feature, cut = np.array(tree.feature), np.array(tree.bin)
    at = np.zeros(len(bins), np.int64)
    for _ in range(level):
        f = feature[at]
        right = bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[at]
        at = np.where(f >= 0, 2 * at + 1 + right, at)
    return at


def _unpacked(batch: pa.RecordBatch, n_features: int, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int16).reshape(n, n_features)
    scores = np.frombuffer(b"".join(batch.column(2).to_pylist()), float).reshape(n, n_classes).copy()
    return bins, batch.column(1).to_numpy(), scores


def _packed(bins: np.ndarray, y, scores: np.ndarray) -> pa.RecordBatch:
    raw = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (bins, scores)]
    return pa.record_batch([raw[0], y, raw[1]], names=["bins", "y", "scores"])


def _bin_rows(model: BoostedModel):
    def run(batches):
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(model.features))]
            yield _packed(model.binned(columns), batch.column(len(columns)), np.tile(model.start, (batch.num_rows, 1)))

    return run


def _add_scores(model: BoostedModel, since: list[list[Tree]]):
    def run(batches):
        for batch in batches:
            bins, _, scores = _unpacked(batch, len(model.features), len(model.start))
            yield _packed(bins, batch.column(1), model.add(scores, bins, since))

    return run
