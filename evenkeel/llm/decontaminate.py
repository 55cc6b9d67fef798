"""Operator 7: benchmark decontamination by SimHash of item-sized windows.

- A window has the length of an item. Those that can be alike an item at all are looked at: a filter
  of the items' shingles, each with its item's length, says how many of a window's shingles are
  in items of that length, and the similarity asked for needs a share of them.
- Windows and items have 64-bit fingerprints. Fingerprints within RADIUS of each other agree in one of
  BLOCKS blocks but for few bits, so items stand in an index under every value so near to their own,
  block by block, and windows are joined with it by length, block and value.
- Pairs within RADIUS are held against the exact weighted similarity of their shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, U64, WordIds, column, durable, mixed, parts_by_bytes, set_aside, shingles, table

WORDS, SIMILAR = 5, 0.8
#: Fingerprints of windows that are 0.8 alike differ in 10 of 64 bits, give or take 3.
RADIUS, BLOCKS = 15, 4
BLOCK_BITS = 64 // BLOCKS
#: What a value of a block is changed by to reach all values within RADIUS // BLOCKS bits.
NEAR = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), r)], np.int64)
#: Bits of the filter for each shingle of the benchmark, and at least and at most altogether.
BITS, LEAST_BITS, MOST_BITS = 256, 1 << 18, 1 << 28
EDGES = b".,;:!?\"'()[]{}*#%$&|-_<>/\\"


class PlainWords(WordIds):
    """Hashes of words without punctuation at their ends; 0 where nothing is left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        plain = word.strip(EDGES)
        out = self[word] = xxhash.xxh3_64_intdigest(plain) | 1 if plain else 0
        return out


def word_ids(text: str | None, ids: WordIds) -> np.ndarray:
    """Of the words that count, in order."""
    found = ids.of((text or "").lower().encode().split())
    return found[found != 0]


def votes(grams: np.ndarray) -> np.ndarray:
    """(shingles, 64): 1 where a bit of the shingle's hash is set, else -1."""
    return 2 * np.unpackbits(mixed(grams).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) - 1


def marks(sums: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row of summed votes."""
    return np.packbits(sums > 0, axis=1).view(np.int64).ravel()


def fingerprint(grams: np.ndarray) -> int:
    """Every occurrence of a shingle has weight one."""
    return int(marks(votes(grams).sum(0)[None])[0])


def places(grams: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Where the filter has shingles of items with so many words; 0: of any item."""
    if size:
        grams = mixed(grams + U64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return (grams & U64(bits - 1)).astype(np.int64)


def known(grams: np.ndarray, size: int, seen: np.ndarray) -> np.ndarray:
    """Which of the shingles the filter has."""
    at = places(grams, size, 8 * len(seen))
    return np.flatnonzero(seen[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard: a shingle's weight in a text is how often it is there."""
    names, of = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(of[: len(a)], minlength=len(names)), np.bincount(of[len(a) :], minlength=len(names))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def fingerprinted(items: DataFrame) -> DataFrame:
    """(item_id, size, mark, grams) of the different items with a word."""

    def run(batches):
        ids = PlainWords()
        for batch in batches:
            rows = [(k, w) for k, w in ((k, word_ids(t, ids)) for k, t in zip(column(batch, "item_id"), column(batch, "text"))) if len(w)]
            grams = [shingles(w, WORDS) for _, w in rows]
            columns = [pa.array([k for k, _ in rows], pa.int64()), pa.array([len(w) for _, w in rows], pa.int32()), pa.array([fingerprint(g) for g in grams], pa.int64())]
            yield pa.record_batch([*columns, pa.array([g.tobytes() for g in grams], pa.binary())], names=["item_id", "size", "mark", "grams"])

    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    return items.mapInArrow(run, "item_id long, size int, mark long, grams binary")


def shingle_filter(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bit for each shingle of an item, and for it with the item's length; the lengths.

    It has MOST_BITS bits at most; where these are full, more windows than need be go on to the index.
    """
    n = items.agg(F.sum(F.octet_length("grams") / 8)).first()[0] or 0
    bits = LEAST_BITS
    while bits < min(BITS * n, MOST_BITS):
        bits *= 2

    def run(batches):
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            for size, raw in zip(column(batch, "size"), column(batch, "grams")):
                grams = np.frombuffer(raw, U64)
                out += [places(grams, 0, bits), places(grams, size, bits)]
            yield pa.record_batch([pa.array(np.concatenate(out) + 1)], names=["at"])

    at = items.select("size", "grams").mapInArrow(run, "at long")
    at = at.groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in at.collect():
        begin = (r.bucket - 1) * len(r.bits)
        out[begin : begin + len(r.bits)] = np.frombuffer(r.bits, np.uint8)[: len(out) - begin]
    return out, sorted(r.size for r in items.select("size").distinct().collect())


def windows_of(words: np.ndarray, seen: np.ndarray, sizes: list[int]):
    """(size, first, words, mark, shingles) of every window of an item's length of which so many shingles are in
    items of that length as the similarity needs."""
    for k in sorted({min(WORDS, s) for s in sizes}):
        # a text shorter than a shingle is a window of its own
        grams = shingles(words, k)
        inside = known(grams, 0, seen)
        if not len(inside):
            continue
        for size in (s for s in sizes if min(WORDS, s) == k):
            whole = size - k + 1
            if len(inside) < SIMILAR * whole:
                continue
            mine = inside[known(grams[inside], size, seen)]
            if len(mine) < SIMILAR * whole:
                continue
            # at either end of the text a window may hang over
            start = np.arange(max(int(mine[0]) - whole + 1, -whole), int(mine[-1]) + 1)
            a, b = np.maximum(start, 0), np.minimum(start + whole, len(grams))
            hits = np.searchsorted(mine, b) - np.searchsorted(mine, a)
            good = (b > a) & (hits * (1 + SIMILAR) >= SIMILAR * (b - a + whole) - 1e-9)
            a, b = np.unique(np.stack((a[good], b[good]), 1), axis=0).T
            if not len(a):
                continue
            low = int(a.min())
            upto = np.zeros((int(b.max()) - low + 1, 64), np.int32)
            np.cumsum(votes(grams[low : b.max()]), axis=0, out=upto[1:])
            for x, y, mark in zip(a.tolist(), b.tolist(), marks(upto[b - low] - upto[a - low]).tolist()):
                yield size, x, min(y - x + k - 1, len(words)), mark, grams[x:y].tobytes()


def windows(docs: DataFrame, seen: np.ndarray, sizes: list[int]) -> DataFrame:
    """(row, doc_id, key, size, first, n, mark, grams) of the documents' windows; row tells documents apart."""
    held = docs.sparkSession.sparkContext.broadcast((seen, sizes))

    def run(batches):
        ids = PlainWords()
        for batch in (part for whole in batches for part in parts_by_bytes(whole)):
            out = []
            for row, doc_id, key, text in zip(*(column(batch, c) for c in ("row", "doc_id", "key", "text"))):
                for w in windows_of(word_ids(text, ids), *held.value):
                    out.append((row, doc_id, key, *w))
                    if len(out) >= 5000:
                        yield as_batch(out)
                        out = []
            if out:
                yield as_batch(out)

    def as_batch(out):
        kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["row", "doc_id", "key", "size", "first", "n", "mark", "grams"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, key long, size int, first int, n int, mark long, grams binary")


def index(items: DataFrame) -> DataFrame:
    """(size, block, value, item, mark): an item under all values that are near enough to its own."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                item, size, mark = (batch.column(k).slice(at, 50).to_numpy() for k in range(3))
                for block in range(BLOCKS):
                    own = mark >> (BLOCK_BITS * block) & ((1 << BLOCK_BITS) - 1)
                    value = (own[:, None] ^ NEAR[None, :]).ravel()
                    n = len(NEAR)
                    yield pa.record_batch([pa.array(np.repeat(size, n)), pa.array(np.full(len(value), block, np.int32)), pa.array(value), pa.array(np.repeat(item, n)), pa.array(np.repeat(mark, n))], names=["size", "block", "value", "item", "other"])

    return items.select("item", "size", "mark").mapInArrow(run, "size int, block int, value long, item long, other long")


def near_items(found: DataFrame, listed: DataFrame) -> DataFrame:
    """(row, size, first, n, item) of the windows, and items of an index(), whose fingerprints are within RADIUS."""
    blocks = F.array(*[F.expr(f"shiftright(mark, {BLOCK_BITS * k}) & {(1 << BLOCK_BITS) - 1}") for k in range(BLOCKS)])
    looked = found.select("row", "size", "first", "n", "mark", F.posexplode(blocks).alias("block", "value"))
    met = looked.join(listed, ["size", "block", "value"]).where(F.expr(f"bit_count(mark ^ other) <= {RADIUS}"))
    return met.select("row", "size", "first", "n", "item").distinct()


def alike(found: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc_id, key, item_id, first_word, n_words, similarity) of the windows that are similar enough to an item."""
    kinds = "row long, doc_id long, key long, item_id long, first_word int, n_words int, similarity double"

    def run(batches):
        for batch in batches:
            near = [similarity(np.frombuffer(a, U64), np.frombuffer(b, U64)) for a, b in zip(column(batch, "grams"), column(batch, "theirs"))]
            keep = pa.array(np.array(near, np.float64) >= SIMILAR, pa.bool_())
            yield pa.record_batch([*batch.columns[:6], pa.array(near, pa.float64())], names=["row", "doc_id", "key", "item_id", "first_word", "n_words", "similarity"]).filter(keep)

    # written, so that Spark knows its size before it picks a join
    listed = scratch.write(index(items))
    pairs = near_items(found, listed).join(found.select("row", "size", "first", "n", "doc_id", "key", "grams"), ["row", "size", "first", "n"])
    pairs = pairs.join(items.select("item", "item_id", F.col("grams").alias("theirs")), "item")
    return pairs.select("row", "doc_id", "key", "item_id", "first", "n", "grams", "theirs").mapInArrow(run, kinds)


def leaking(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    prepared = fingerprinted(items).withColumn("item", F.monotonically_increasing_id())
    items = scratch.write(prepared)
    found = scratch.write(windows(docs, *shingle_filter(items)))
    return alike(found, items, scratch)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) for documents with a passage like a benchmark item.

    Words are lower-cased and without punctuation at their ends; windows of an item's length are
    compared by 5-word shingles (a shorter item: its whole sequence), weighted similarity 0.8 or
    more. At a text's ends a window may have fewer words. One row for a document and item, that of
    the best window, the first of several. All windows within RADIUS are found; of those at a
    similarity of just 0.8 some 97 in 100 are, of more similar ones more. Null or wordless texts and
    items match nothing; null ids of items are left out. Rows with equal or null doc_id are
    separate documents; repeated items count once. Other columns are ignored. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    found = leaking(docs, items, scratch)
    best = F.max_by(F.struct("first_word", "n_words", "similarity"), F.struct("similarity", -F.col("first_word"), "n_words")).alias("best")
    out = found.groupBy("row", "item_id").agg(F.first("doc_id").alias("doc_id"), best)
    out = durable(out.select("doc_id", "item_id", "best.*"))
    scratch.close()
    return out


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaks_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs less the documents that leaks() would name, with all their columns."""
    docs, named = set_aside(docs, "doc_id", "text")
    scratch = Scratch(docs.sparkSession)
    try:
        gone = durable(leaking(docs, items, scratch).select("key").distinct())
    finally:
        scratch.close()
    return named(docs.withColumn("key", F.xxhash64("doc_id", "text")).join(gone, "key", "left_anti").select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a passage like a benchmark item."""
    return drop_leaks_of(docs, table(spark, sf_dir, "benchmark"))
