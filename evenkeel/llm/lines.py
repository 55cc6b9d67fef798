"""Operator 2: line dedup by a suffix array over line ids, built by prefix doubling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, durable, parts_by_bytes, set_aside, table

#: Words that a repeated run must have to be deleted.
MIN_WORDS = 5
AT = ["doc", "h"]
PLACE = ["doc", "h", "i"]


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc, h, at, i, line, words): the lines with a word, their place among all lines and among these."""

    def run(batches):
        for batch in (part for whole in batches for part in parts_by_bytes(whole)):
            out = []
            for doc, h, text in zip(column(batch, "doc"), column(batch, "h"), column(batch, "text")):
                i = 0
                for at, line in enumerate((text or "").split("\n")):
                    if words := line.split():
                        out.append((doc, h, at, i, xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63), len(words)))
                        i += 1
            for k in range(0, len(out), 50_000):
                doc, h, at, i, line, n = zip(*out[k : k + 50_000])
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(at, pa.int32()), pa.array(i, pa.int32()), pa.array(line, pa.int64()), pa.array(n, pa.int32())], names=["doc", "h", "at", "i", "line", "words"])

    return docs.select("doc", "h", "text").mapInArrow(run, "doc long, h long, at int, i int, line long, words int")


def ranked(keyed: DataFrame, keys: list[str], scratch: Scratch, in_order: bool = True) -> DataFrame:
    """(keys, rank, first) of the keys that more than one row has: their place in the keys' order (or else any number of their own), and their first row."""
    groups = keyed.groupBy(*keys).agg(F.count("*").alias("members"), F.min(F.struct(*PLACE)).alias("first")).where("members > 1")
    groups = groups.orderBy(*keys) if in_order else groups
    return scratch.write(groups.select(*keys, F.monotonically_increasing_id().alias("rank"), "first"), "groups")


def doubled(lines: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For k = 0, 1, ...: (doc, h, i, rank, later) of the suffixes whose first 2^k lines are there more than once.

    rank is the place of these lines in the order of all such beginnings, and so that of the suffix
    in the suffix array, as far as 2^k lines tell; later: whether an earlier suffix begins alike.
    Each round ranks the pairs of ranks 2^k lines apart. Suffixes that are alone drop out, so there
    are as many rounds as the longest repeated run's length has binary digits.
    """
    place = F.struct(*PLACE)
    levels, keyed, keys = [], lines.select(*PLACE, F.col("line").alias("one")), ["one"]
    while True:
        groups = ranked(keyed, keys, scratch)
        level = scratch.write(keyed.join(groups, keys).select(*PLACE, "rank", (place > F.col("first")).alias("later")))
        if not level.limit(1).count():
            return levels
        levels.append(level)
        ahead = level.select("doc", "h", (F.col("i") - (1 << len(levels) - 1)).alias("i"), F.col("rank").alias("two"))
        keyed, keys = scratch.write(level.join(ahead, PLACE).select(*PLACE, F.col("rank").alias("one"), "two"), "pairs"), ["one", "two"]


def deepest(levels: list[DataFrame], k: int) -> DataFrame:
    """The suffixes of a level that are no later copy twice as deep."""
    if k + 1 == len(levels):
        return levels[k]
    return levels[k].join(levels[k + 1].where("later").select(*PLACE), PLACE, "left_anti")


def longest_matches(levels: list[DataFrame], top: int, scratch: Scratch) -> DataFrame | None:
    """(doc, h, i, n): how many lines of a suffix are the longest that an earlier suffix begins with, too; 1 < n < 2^top.

    That is the depth of the deepest LCP interval in which the suffix isn't the first. Suffixes that
    are no later copy 2^(k + 1) lines deep are compared in steps of 2^(k - 1), ..., 2, 1 lines: those
    of an interval with equal ranks so far ahead are an interval of their own, into which all but
    the first go on; the first stays, and stands for the others, and goes along only as what they
    are compared with (own = false).
    """
    state = None
    for j in range(min(top, len(levels)) - 2, -1, -1):
        # from here on, suffixes whose longest match has 2^(j + 1) lines or more, but fewer than 2^(j + 2)
        new = deepest(levels, j + 1).select(*PLACE, F.col("rank").alias("of"), F.lit(2 << j).alias("n"), F.col("later").alias("own"))
        state = new if state is None else state.unionByName(new)
        ahead = levels[j].select("doc", "h", F.col("i").alias("at"), F.col("rank").alias("next"))
        tried = state.withColumn("at", F.col("i") + F.col("n")).join(ahead, ["doc", "h", "at"], "left").drop("at")
        tried = scratch.write(tried, "tried")
        groups = ranked(tried.where("next is not null"), ["n", "of", "next"], scratch, in_order=False)
        met = tried.join(groups, ["n", "of", "next"], "left")
        ends = F.col("first").isNull() | (F.struct(*PLACE) == F.col("first"))
        stay = F.when(ends, F.struct("of", "n", "own"))
        go = F.when(F.col("first").isNotNull(), F.struct(F.col("rank").alias("of"), (F.col("n") + (1 << j)).alias("n"), (F.col("own") & ~ends).alias("own")))
        met = met.select(*PLACE, F.explode(F.filter(F.array(stay, go), lambda x: x.isNotNull())).alias("x"))
        state = scratch.write(met.select(*PLACE, "x.*"), f"state{j % 2}")
    return None if state is None else state.where("own").select(*PLACE, "n")


def repeated_runs(lines: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """(doc, h, i, n): runs of n lines from line i on that an earlier place has, too, and that together make up the longest ones.

    Where a match is so deep that its lines have min_words words whatever they are, the suffix's run is
    as long as its deepest rank says; the rest of the match belongs to the runs of the suffixes that
    begin inside it. Shorter matches are followed to their exact length, since their words count.
    """
    levels = doubled(lines, scratch)
    top = max(min_words - 1, 0).bit_length()
    runs = lines.where("false").select(*PLACE, F.lit(1).alias("n"))
    for k in range(top, len(levels)):
        runs = runs.unionByName(deepest(levels, k).where("later").select(*PLACE, F.lit(1 << k).alias("n")))
    if levels and top:
        # a run of one line that hasn't the words is none; longer ones are counted where their text is
        single = deepest(levels, 0).where("later").join(lines.where(F.col("words") >= min_words).select(*PLACE), PLACE)
        runs = runs.unionByName(single.select(*PLACE, F.lit(1).alias("n")))
    longer = longest_matches(levels, top, scratch)
    return runs if longer is None else runs.unionByName(longer)


def cut(text: str, starts: np.ndarray, sizes: np.ndarray, min_words: int) -> tuple[str, int]:
    """The text less the runs (in lines with a word) that have min_words words, and how many lines that is."""
    lines = text.split("\n")
    words = np.array([len(x.split()) for x in lines])
    worded = np.flatnonzero(words)
    upto = np.r_[0, np.cumsum(words[worded])]
    a, b = starts, starts + sizes
    enough = upto[b] - upto[a] >= min_words
    step = np.bincount(a[enough], minlength=len(upto)) - np.bincount(b[enough], minlength=len(upto))
    gone = set(worded[np.cumsum(step)[:-1] > 0].tolist())
    return "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text less its later copies of repeated line runs, and `removed`, how many lines that was.

    Lines are equal if their words are; lines without words stay, and stand between no others. A
    maximal repeated run, one that can't be made longer at either end, is deleted where it has
    min_words words or more and an equal run begins earlier, in this or another document; so all
    copies go but the first. Documents come in order of doc_id, null last, then of a hash of their
    text. Rows with equal doc_id and equal text are one document: each gets the same result. Null
    text stays null, removed 0. All columns are kept; a column named `removed`, in any case, is replaced. No rows: no rows.
    """
    docs, named = set_aside(docs, "doc_id", "text", replaced=("removed",))
    names = docs.columns
    scratch = Scratch(docs.sparkSession)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    keyed = docs.select(doc.alias("doc"), F.xxhash64("text").alias("h"), "text")
    lines = scratch.write(line_rows(keyed).dropDuplicates(PLACE))
    runs = repeated_runs(lines, min_words, scratch)
    # no more runs for a document than it has lines
    gone = durable(runs.groupBy(*AT).agg(F.collect_list("i").alias("starts"), F.collect_list("n").alias("sizes")))
    scratch.close()

    @F.arrow_udf("text string, removed int")
    def less(text: pa.Array, starts: pa.Array, sizes: pa.Array) -> pa.Array:
        (a, x), (b, y) = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (starts, sizes))
        out = [None if t is None else cut(t, x[a[k] : a[k + 1]], y[b[k] : b[k + 1]], min_words) for k, t in enumerate(text.to_pylist())]
        texts, removed = pa.array([r and r[0] for r in out], pa.string()), pa.array([r and r[1] for r in out], pa.int32())
        return pa.StructArray.from_arrays([texts, removed], ["text", "removed"])

    # else the optimizer would have it done once for each use of its result
    less = less.asNondeterministic()
    whole = docs.select(F.struct(*names).alias("row"), doc.alias("doc"), F.xxhash64("text").alias("h")).join(gone, AT, "left")
    # texts without a run don't go to Python
    whole = whole.select("row", less(F.when(F.col("starts").isNotNull(), F.col("row.text")), "starts", "sizes").alias("new"))
    out = [F.coalesce("new.text", "row.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    return named(whole.select(*out, F.coalesce("new.removed", F.lit(0)).alias("removed")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without later copies of lines; a document of which no word is left goes."""
    plain, named = set_aside(docs, "doc_id", "text")
    out = without_repeats(plain)
    return named(out.where("removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").select(*plain.columns))
