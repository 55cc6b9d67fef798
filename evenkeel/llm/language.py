"""Operator 9: language by bit-sliced Bloom filters of n-grams, a bit for each language."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, column, held_out, limit, mixed, parts_by_bytes, table

FOLDS, FOLD = 4, 2
#: Documents of a language (about; by a hash of id and text) whose n-grams are counted.
SAMPLE = 1_500
#: An n-gram stands for a language if it makes up this share of the language's n-grams; so at most 1 / FREQUENT do.
FREQUENT = 5e-5
#: Sizes of n-grams in bytes, slots of the filter, probes of an n-gram.
SIZES, SLOTS, PROBES = (3, 4, 5), 1 << 20, 3
#: A language has an n-gram if it is at least this share as frequent there as where it is most frequent.
SHARE = 0.4
LETTER = re.compile(r"[^\W\d_]")
#: All ASCII but letters becomes a blank.
BLANK = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams of the text's bytes, in lower case, everything between words a blank."""
    raw = b" " + b" ".join(text.lower().encode().translate(BLANK).split()) + b" "
    x = np.frombuffer(raw, np.uint8).astype(U64)
    out = []
    for size in SIZES:
        n = len(x) - size + 1
        if n > 0:
            g = reduce(lambda g, j: g << U64(8) | x[j : j + n], range(1, size), x[:n].copy())
            out.append(g | U64(size) << U64(56))
    return np.concatenate(out) if out else np.zeros(0, U64)


class Filters:
    """Slot s holds a bit for each language; an n-gram is in the languages whose bits all its slots have."""

    def __init__(self, names: list[str], prior: np.ndarray, sets: list[np.ndarray]):
        self.names, self.best = names, int(np.argmax(prior)) if len(prior) else 0
        self.words = max(1, -(-len(names) // 64))
        self.slots = np.zeros((SLOTS, self.words), U64)
        for k, found in enumerate(sets):
            for at in self.places(found):
                self.slots[at, k // 64] |= U64(1) << U64(k % 64)
        fill = np.array([np.mean((self.slots[:, k // 64] >> U64(k % 64)) & U64(1)) for k in range(len(names))])
        self.false = fill**PROBES

    @staticmethod
    def places(found: np.ndarray) -> list[np.ndarray]:
        h = mixed(found)
        step = (h >> U64(32)) | U64(1)
        return [((h + U64(i) * step) % U64(SLOTS)).astype(np.int64) for i in range(PROBES)]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text):
            return "und", 0.0
        if not self.names:
            return "und", 0.0
        found = grams(text)
        hits = reduce(np.bitwise_and, (self.slots[at] for at in self.places(found)))
        counts = np.zeros(len(self.names))
        for w in range(self.words):
            some, times = np.unique(hits[:, w], return_counts=True)
            for k in range(64 * w, min(64 * w + 64, len(self.names))):
                counts[k] = times[(some >> U64(k % 64)) & U64(1) == 1].sum()
        # of the n-grams that a language hasn't, this many still seem to be in it
        true = np.maximum(counts - len(found) * self.false, 0) / (1 - self.false)
        if true.sum() <= 0:
            return self.names[self.best], 0.0
        best = int(np.argmax(true))
        return self.names[best], float(min(1.0, true[best] / true.sum()))


def counted(batches):
    """Rows (lang, text) to how often each n-gram is in the texts of a language, batch by batch."""
    for batch in batches:
        for part in parts_by_bytes(batch):
            by: dict[str, list] = {}
            for lang, text in zip(column(part, "lang"), column(part, "text")):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def fitted(docs: DataFrame) -> Filters:
    """Filters of the n-grams that are frequent in each language, as their documents outside the fold have them.

    Of a language with more documents than SAMPLE about so many are counted. One result for one
    table, however its rows lie over partitions.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang is not null and text is not null")
    rows = rows.where(~held_out(F.col("doc_id"), FOLDS, FOLD))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(sizes)
    limits = [(lang, limit(SAMPLE / n)) for lang, n in sizes.items()]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, below long")
    some = rows.join(F.broadcast(limits), "lang").where(F.xxhash64(F.lit("lang"), "doc_id", "text") <= F.col("below"))
    # rows that are equal are chosen together, so they count once
    some = some.groupBy("lang", "doc_id", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(some.select("lang", "text").mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    found = found.join(F.broadcast(found.groupBy("lang").agg(F.sum("n").alias("all"))), "lang").withColumn("share", F.col("n") / F.col("all")).where(F.col("share") >= FREQUENT)
    most = found.groupBy("gram").agg(F.max("share").alias("most"))
    kept = found.join(most, "gram").where(F.col("share") >= SHARE * F.col("most"))
    sets = {r.lang: r.grams for r in kept.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()}
    scratch.close()
    return Filters(names, np.array([sizes[x] for x in names]), [np.array(sorted(sets.get(x, ())), np.int64).view(U64) for x in names])


def identify(docs: DataFrame) -> DataFrame:
    """held_out, lang_pred and score of every document.

    A language's score is its share of the n-grams found in the filters, over all languages. Null
    text or text without a letter: `und`, score 0. Letters but no known n-gram: the most frequent
    language, score 0. No document to learn from: `und`, score 0. Rows with equal or null doc_id
    each get a row. Other columns are ignored. No rows: no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs))

    def run(batches):
        for batch in (part for whole in batches for part in parts_by_bytes(whole)):
            found = [model.value.predict(t) for t in column(batch, "text")]
            names, scores = zip(*found) if found else ((), ())
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "lang_pred", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
