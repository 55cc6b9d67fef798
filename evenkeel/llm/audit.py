"""Operator 12: what a chain of filters removes in every order, from counts of joint failures."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, table

FILTERS = "ABCDE"
SUBSETS = range(1 << len(FILTERS))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_flags(docs: DataFrame) -> DataFrame:
    """docs with mask: bits of the filters A to D that the text fails."""
    docs = docs.withColumn("words", F.split("text", "[\\x20\\x09-\\x0D]+"))
    # an empty word stands before white space that begins a text and after white space that ends one
    docs = docs.withColumn("n_words", F.size(F.array_remove("words", "")).cast("long")).withColumn("distinct_words", F.size(F.array_remove(F.array_distinct("words"), "")).cast("long"))
    capitals = F.length("text") - F.length(F.translate("text", UPPER, ""))
    fails = [
        F.col("n_words") < 100,
        100 * F.col("distinct_words") < 80 * F.col("n_words"),
        100 * capitals.cast("long") > 10 * F.length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    return docs.withColumn("mask", sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))).drop("words", "n_words", "distinct_words")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits of the filters A to E that fail), good, toxic and n: how many documents are alike in all of these.

    E, a text that a smaller doc_id has too, needs the least doc_id of each text: documents are
    first counted by text, part and labels, with their least doc_id and how many have it, so that a text
    with very many copies meets its other parts in a few rows. Texts are told apart by 128-bit digests.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    docs = text_flags(docs).select("doc_id", "part", "mask", F.md5("text").alias("digest"))
    # rows without an id have no label; they are dealt out by text and not all to one task
    docs = docs.withColumn("known", F.col("doc_id").isNotNull()).withColumn("key", F.coalesce("doc_id", F.xxhash64("digest")))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    docs = docs.join(marked.withColumn("known", F.lit(True)), ["key", "known"], "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    by = ["digest", "part", "mask", "good", "toxic"]
    # rows of one id and text count together: none of them is smaller than the other
    docs = docs.select("key", "known", "doc_id", "digest", "part", "mask", *flags).groupBy("key", "known", "doc_id", *by).agg(F.count("*").alias("n"))
    texts = docs.groupBy(*by).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("unknown"))
    first = F.min("least").over(Window.partitionBy("digest"))
    texts = texts.withColumn("first", first)
    firsts = F.col("unknown") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    e = 1 << FILTERS.index("E")
    cells = F.explode(F.array(F.struct(F.col("mask"), firsts.alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - firsts).alias("n")))).alias("cell")
    return texts.select("part", "good", "toxic", cells).select("part", F.col("cell.mask").alias("mask"), "good", "toxic", F.col("cell.n").alias("n")).where("n > 0")


def joint(cells: DataFrame) -> DataFrame:
    """A row per part: for each measure, the documents that fail all filters of each of the 32 subsets, by the subset's bits."""

    def fails_all(subset: int) -> Column:
        out = F.lit(1)
        for k in range(len(FILTERS)):
            if subset >> k & 1:
                out = out * F.col(f"f{k}")
        return out

    flags = [F.getbit("mask", F.lit(k)).cast("long").alias(f"f{k}") for k in range(len(FILTERS))]
    weights = [F.col("n"), *((F.col("n") * F.col(m).cast("int")).alias(m) for m in MEASURES[1:])]
    rows = cells.select("part", *flags, *weights)
    sums = [F.sum(F.col(m) * fails_all(s)).alias(f"{m}{s}") for m in MEASURES for s in SUBSETS]
    return rows.groupBy("part").agg(*sums).select("part", *(F.array(*(f"{m}{s}" for s in SUBSETS)).alias(m) for m in MEASURES))


def moebius() -> np.ndarray:
    """The matrix that takes joint failures (by subset) to the documents that fail exactly a subset's filters."""
    out = np.zeros((len(SUBSETS), len(SUBSETS)), np.int64)
    for t in SUBSETS:
        for s in SUBSETS:
            if s & t == t:
                out[t, s] = (-1) ** (s.bit_count() - t.bit_count())
    return out


def interactions(counts: DataFrame) -> DataFrame:
    """counts (as of joint) as one row per part, order of the filters and step.

    Inverting gives the documents by exactly what they fail. Those that fail none of an order's first
    filters are what these keep. The dividend of a set of filters in the game "documents removed"
    is its joint failures with alternating sign, and a filter's share over all orders is the number
    of orders times its dividends, each divided by its set's size.
    """
    names = ["".join(p) for p in permutations(FILTERS)]
    steps = [(name, k) for name in names for k in range(len(FILTERS))]
    filters = np.array([FILTERS.index(name[k]) for name, k in steps])
    before = np.array([sum(1 << FILTERS.index(f) for f in name[:k]) for name, k in steps])
    subsets = np.array(SUBSETS)
    # by filter set: 1 where an exact pattern fails none of the set
    passes = (subsets[:, None] & subsets[None, :] == 0).astype(np.int64)
    exact, size = moebius(), np.array([s.bit_count() for s in SUBSETS])
    shares = np.array([[(-1) ** (size[s] + 1) * len(names) // size[s] if s >> k & 1 else 0 for s in SUBSETS] for k in range(len(FILTERS))])

    def run(batches):
        for batch in batches:
            for part, *rows in zip(*(column(batch, c) for c in ("part", *MEASURES))):
                fails = np.array(rows, np.int64)
                left = passes @ exact @ fails.T
                after = before | 1 << filters
                removed = left[before] - left[after]
                alone = (exact @ fails[0])[1 << filters]
                redundant = fails[0][1 << filters] - removed[:, 0]
                values = [left[after][:, 0], removed[:, 0], redundant, alone, removed[:, 1], removed[:, 2], (shares @ fails[0])[filters]]
                yield pa.record_batch(
                    [[part] * len(steps), [name for name, _ in steps], pa.array([k + 1 for _, k in steps], pa.int32()), *(pa.array(np.ascontiguousarray(v)) for v in values)],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    return counts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (lang; null: ''), order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Needs doc_id, text and lang, and labels with doc_id, quality and toxic; other columns are ignored. A
    null text counts as empty, which fails A. A document counts as good or toxic if one of its label rows says
    so. Rows with a null doc_id have no labels, never fail E and make none fail; repeated rows each count, and rows
    of equal doc_id and text don't make each other fail. A text's words are held in one task. No rows: no rows.
    """
    return interactions(joint(failures(docs, labels)))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _fails(letter: str) -> str:
    return f"(mask >> (ascii({letter}) - 65)) & 1 = 1"


#: Every document's failures, counted by pattern; then each order goes through the patterns step by step.
SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words, min(doc_id) over (partition by text) as least from d),
m as (select doc_id, part,
        (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
        + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text))::int
        + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask
    from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l using (doc_id) group by part, mask),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from f a, f b, f c, f d, f e
    where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, step, filter_order[step] as f from o, (select unnest([1, 2, 3, 4, 5]) as step)),
p as (select *, list_bool_or(list_transform(range(1, step), lambda i: (mask >> (ascii(filter_order[i]) - 65)) & 1 = 1)) as gone, {_fails('f')} as here, mask = 1 << (ascii(f) - 65) as alone
    from s, c),
q as (select part, filter_order, step, f,
        sum(case when not coalesce(gone, false) and not here then n else 0 end)::bigint as kept,
        sum(case when not coalesce(gone, false) and here then n else 0 end)::bigint as removed,
        sum(case when coalesce(gone, false) and here then n else 0 end)::bigint as redundant,
        sum(case when alone then n else 0 end)::bigint as unique_fails,
        sum(case when not coalesce(gone, false) and here then good else 0 end)::bigint as good_lost,
        sum(case when not coalesce(gone, false) and here then toxic else 0 end)::bigint as toxic_lost
    from p group by part, filter_order, step, f)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, f))::bigint as shapley
from q
"""
