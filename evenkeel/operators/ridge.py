"""Ridge regression of all folds at once: moments by fold in one pass, the penalty by leave-one-out error in a second."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHAS = (0.1, 1.0, 10.0)


@dataclass
class RidgeModel:
    """A linear model on numeric columns; null and non-finite values count as the training mean."""

    features: list[str]
    mean: list[float]
    weights: list[float]
    start: float
    alpha: float
    #: Mean squared leave-one-out error of each penalty that was tried.
    errors: dict[str, float]

    def column(self):
        out = F.lit(self.start)
        for c, m, w in zip(self.features, self.mean, self.weights):
            x = F.col(f"`{c}`").cast("double")
            out = out + F.coalesce(F.when(F.abs(x) < float("inf"), x) - F.lit(m), F.lit(0.0)) * F.lit(w)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        rest = [F.col(f"`{c}`") for c in df.columns if c.lower() != "prediction"]
        return df.select(*rest, self.column().alias("prediction"))

    def save(self, path: str) -> None:
        SparkSession.active().createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RidgeModel:
        return cls(**json.loads(spark.read.text(path).first()[0]))


@dataclass
class Moments:
    """n, sums and products of the features and the target (last), around a fixed point; those of separate rows add up."""

    n: float
    sums: np.ndarray
    products: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.sums - other.sums, self.products - other.products)


class Solution:
    """The standardised problem of one training set, taken apart once for all penalties."""

    def __init__(self, m: Moments, around: np.ndarray):
        f = len(m.sums) - 1
        mean = m.sums / m.n
        scatter = m.products - m.n * np.outer(mean, mean)
        deviation = np.sqrt(np.maximum(np.diag(scatter)[:f] / m.n, 0))
        # rounding of a constant column isn't spread
        self.scale = np.where(deviation > 1e-7 * (1 + np.abs(mean[:f])), deviation, np.inf)
        self.mean, self.around, self.n = mean, around, m.n
        z = scatter[:f, :f] / np.outer(self.scale, self.scale)
        self.values, self.vectors = np.linalg.eigh(z)
        self.values = np.maximum(self.values, 0)
        self.target = self.vectors.T @ (scatter[:f, f] / self.scale)

    def errors(self, x: np.ndarray, y: np.ndarray, alphas: tuple[float, ...]) -> np.ndarray:
        """Squared leave-one-out errors of training rows (around the fixed point), summed for each penalty."""
        f = len(self.scale)
        z = ((x - self.mean[:f]) / self.scale) @ self.vectors
        y = y - self.mean[f]
        out = []
        for alpha in alphas:
            inverse = 1 / (self.values + alpha)
            own = np.minimum(1 / self.n + (z**2) @ inverse, 1 - 1e-12)
            out.append((((y - z @ (inverse * self.target)) / (1 - own)) ** 2).sum())
        return np.array(out)

    def weights(self, alpha: float) -> np.ndarray:
        return self.vectors @ (self.target / (self.values + alpha)) / self.scale


def _numbers(batch: pa.RecordBatch, f: int, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1 : f + 2]], axis=1)
    x = x - fill
    x[:, :f] = np.where(np.isfinite(x[:, :f]), x[:, :f], 0.0)
    return x[:, :f], x[:, f]


def fit_folds(df: DataFrame, features: list[str], label: str, fold: str | None = None, alphas: tuple[float, ...] = ALPHAS) -> dict[int | None, RidgeModel]:
    """For each fold a model of the rows of all other folds; without `fold` one model of all rows, under None.

    Three passes whatever the number of folds: means, moments by fold (a fold's training moments are the
    total less its own), then the leave-one-out errors of every penalty for all folds together. What comes
    to the driver is (features + 2) squared numbers a fold. The penalty of the least error counts, of equal
    ones the first. Features are standardised by the training rows and a constant one has no weight; values that are null or
    not finite count as the mean over all rows. Rows without a finite label or a fold are left out; folds
    whose training rows are fewer than 2 have no model.
    """
    names = [F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(features)]
    y = F.col(f"`{label}`").cast("double").alias("y")
    rows = df.select((F.col(f"`{fold}`").cast("long") if fold else F.lit(-1).cast("long")).alias("fold"), *names, y).where("fold is not null and abs(y) < double('inf')")
    f, finite = len(features), lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    first = rows.agg(*[F.avg(finite(f"x{k}")).alias(f"m{k}") for k in range(f)], F.avg("y").alias("m")).first()
    around = np.array([v or 0.0 for v in first])
    size = (f + 1) ** 2 + (f + 1) + 1

    def moments(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y = _numbers(batch, f, around)
            both, folds = np.column_stack([x, y]), batch.column(0).to_numpy()
            for k in np.unique(folds).tolist():
                some = both[folds == k]
                held[k] = held.get(k, 0) + np.concatenate([[len(some)], some.sum(axis=0), (some.T @ some).ravel()])
        for k, v in held.items():
            yield pa.record_batch([np.full(size, k), np.arange(size), v], names=["fold", "at", "v"])

    sums: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(moments, "fold long, at long, v double").groupBy("fold", "at").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r.fold, np.zeros(size))[r["at"]] = r.v
    by = {k: Moments(v[0], v[1 : f + 2], v[f + 2 :].reshape(f + 1, f + 1)) for k, v in sums.items()}
    if not by:
        return {}
    total = Moments(sum(m.n for m in by.values()), sum(m.sums for m in by.values()), sum(m.products for m in by.values()))
    sets = {k: total - m for k, m in by.items()} if fold else {-1: total}
    solved = {k: Solution(m, around) for k, m in sets.items() if m.n >= 2}

    def errors(batches):
        out = {k: np.zeros(len(alphas)) for k in solved}
        for batch in batches:
            x, y = _numbers(batch, f, around)
            folds = batch.column(0).to_numpy()
            for k, s in solved.items():
                train = folds != k if fold else slice(None)
                out[k] += s.errors(x[train], y[train], alphas)
        for k, v in out.items():
            yield pa.record_batch([np.full(len(v), k), np.arange(len(v)), v], names=["fold", "at", "v"])

    found = rows.mapInArrow(errors, "fold long, at long, v double").groupBy("fold", "at").agg(F.sum("v").alias("v")).collect()
    mean_error = {(r.fold, r["at"]): r.v / solved[r.fold].n for r in found}
    out = {}
    for k, s in solved.items():
        best = min(range(len(alphas)), key=lambda i: mean_error[k, i])
        w = s.weights(alphas[best])
        start = float(around[f] + s.mean[f] - w @ s.mean[:f])
        out[k if fold else None] = RidgeModel(list(features), around[:f].tolist(), w.tolist(), start, alphas[best], {str(a): mean_error[k, i] for i, a in enumerate(alphas)})
    return out


def predict_folds(df: DataFrame, models: dict[int, RidgeModel], fold: str) -> DataFrame:
    """df with the prediction of each row by its own fold's model, in one pass; rows whose fold has none are left out."""
    kept = sorted(models)
    if not kept:
        return df.withColumn("prediction", F.lit(None).cast("double")).limit(0)
    features = models[kept[0]].features
    mean = np.array(models[kept[0]].mean)
    weights, start = np.array([models[k].weights for k in kept]), np.array([models[k].start for k in kept])

    @F.pandas_udf("double")
    def score(folds: pd.Series, rows: pd.Series) -> pd.Series:
        x = np.array(rows.tolist(), float).reshape(len(rows), len(features)) - mean
        at = np.searchsorted(kept, folds.to_numpy())
        return pd.Series((np.where(np.isfinite(x), x, 0.0) * weights[at]).sum(axis=1) + start[at])

    numbers = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in features])
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() != "prediction"]
    return df.where(F.col(f"`{fold}`").isin(kept)).select(*rest, score(F.col(f"`{fold}`").cast("long"), numbers).alias("prediction"))


@dataclass
class Ridge:
    """Learns one RidgeModel, as the registry of models wants it."""

    features: list[str]
    label: str
    alphas: tuple[float, ...] = ALPHAS

    def fit(self, df: DataFrame) -> RidgeModel:
        found = fit_folds(df, self.features, self.label, None, self.alphas)
        if not found:
            raise ValueError("no rows to learn from")
        return found[None]
