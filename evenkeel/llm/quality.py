"""Operator 10: quality by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, held_out, parts_by_bytes, sampled, set_aside, table

#: Labelled rows that the densities are fitted to, at most (about; taken by a hash of the id).
SAMPLE = 20_000
FOLDS, FOLD = 5, 0
CUT = 0.3
#: Share of the pooled covariance, and of a multiple of the identity, in each class's.
POOL, RIDGE = 0.2, 0.05
SYMBOLS = re.compile(r"[^\w\s.,;:'\"()?!-]")
UPPER, DIGITS = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[0-9]")
STATISTICS = (
    "log_words", "mean_word", "log_distinct", "repeated_next", "upper", "digits", "symbols", "bangs", "stops", "lines_a_word", "same_lines", "long_words", "top_word",
)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a text; of an empty one, zeros."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, chars = len(words), len(text)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split("\n")
    share = lambda x, of=chars: np.log((x + 0.5) / (of + 5.0))
    letters = sum(map(len, words))
    # Heaps' law takes most of the length out of the number of distinct words
    return [
        np.log1p(n), np.log(letters / n), np.log(len(counts)) - 0.8 * np.log(n), share(sum(map(eq, words, words[1:])), n),
        share(len(UPPER.findall(text))), share(len(DIGITS.findall(text))), share(len(SYMBOLS.findall(text))),
        share(text.count("!")), share(text.count(".") + text.count(",")), share(len(lines), n), share(len(lines) - len(set(lines)), len(lines)),
        share(sum(1 for w in counts if len(w) > 16), len(counts)), share(max(counts.values()), n),
    ]


class Discriminant:
    """Two Gaussian densities with shrunken covariances, their Cholesky factors kept."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pool: float = POOL, ridge: float = RIDGE):
        self.sizes = [int((y == c).sum()) for c in (0, 1)]
        self.only = None if min(self.sizes) > 1 else (float(np.mean(y)) if len(y) else 0.5)
        if self.only is not None:
            return
        self.mid, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mid) / self.scale
        parts = [x[y == c] for c in (0, 1)]
        self.means = [p.mean(0) for p in parts]
        own = [np.cov(p.T, bias=True) for p in parts]
        pooled = sum(c * len(p) for c, p in zip(own, parts)) / len(x)
        self.factors = []
        for c in own:
            c = (1 - pool) * c + pool * pooled
            c = (1 - ridge) * c + ridge * np.trace(c) / len(c) * np.eye(len(c)) + 1e-9 * np.eye(len(c))
            self.factors.append(np.linalg.cholesky(c))
        self.inverse = [np.linalg.inv(f) for f in self.factors]
        self.offsets = [-np.log(np.diag(f)).sum() + np.log(s / len(x)) for f, s in zip(self.factors, self.sizes)]
        # one temperature for the log density difference, by the likelihood of the labels
        raw = self.difference(x, scaled=True)
        grid = [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0]
        self.temperature = min(grid, key=lambda t: np.mean(np.logaddexp(0, -np.where(y == 1, 1, -1) * raw * t)))

    def difference(self, x: np.ndarray, scaled: bool = False) -> np.ndarray:
        x = x if scaled else (x - self.mid) / self.scale
        each = [o - 0.5 * (((x - m) @ i.T) ** 2).sum(1) for m, i, o in zip(self.means, self.inverse, self.offsets)]
        return each[1] - each[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        return 1 / (1 + np.exp(-np.clip(self.difference(x) * self.temperature, -500, 500)))


def labelled_ids(labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """(doc_id, label) of about `most` labelled rows outside the fold, chosen by a hash of the id; all, if there are fewer."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = rows.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("label").alias("label"))
    return sampled(rows, most / max(rows.count(), 1), "sample", "doc_id")


def with_statistics(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in (part for whole in batches for part in parts_by_bytes(whole)):
            rows = [statistics(t) for t in column(batch, "text")]
            x = pa.FixedSizeListArray.from_arrays(pa.array(np.array(rows, float).ravel()), len(STATISTICS)) if rows else pa.array([], pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), x.cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def fitted(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD, most: int = SAMPLE) -> Discriminant:
    """Fitted to the statistics of at most about `most` labelled documents; only those numbers reach the driver."""
    ids = labelled_ids(labels, "quality", folds, fold, most)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    # a document of several rows counts with one of them, so there are no more rows than sampled ids
    rows = with_statistics(chosen).groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(ids), "doc_id").orderBy("doc_id").collect()
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(STATISTICS))
    return Discriminant(x, np.array([r.label for r in rows], int))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD, most: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """held_out, score (label 1 likelier the higher) and predicted of every document.

    Inputs of a score are statistics of the whole text alone. Null or empty text: the statistics
    are zeros, scored like any others. Rows with equal or null doc_id each get a row; of rows with
    one labelled doc_id the least by its statistics is learned from. A document labelled more than once counts once, with its largest label; labels other than 0 and 1 are left
    out. If one class has fewer than two rows, every score is the mean label (0.5 without labels).
    Other columns are ignored. No rows: no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, folds, fold, most))

    def whole(batches):
        for batch in (part for whole in batches for part in parts_by_bytes(whole)):
            rows = [statistics(t) for t in column(batch, "text")]
            yield pa.record_batch([batch.column(0), pa.array(model.value.score(np.array(rows, float).reshape(-1, len(STATISTICS))))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(whole, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier doesn't reject, with their columns."""
    docs, named = set_aside(docs, "doc_id", "text")
    model = spark.sparkContext.broadcast(fitted(docs, table(spark, sf_dir, "labels")))

    def run(batches):
        for batch in (part for whole in batches for part in parts_by_bytes(whole)):
            x = np.array([statistics(t) for t in column(batch, "text")], float).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.value.score(x) >= CUT))

    return named(docs.mapInArrow(run, docs.schema))
