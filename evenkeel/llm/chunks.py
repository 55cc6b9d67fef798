"""Operator 3: substring dedup by content-defined chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, durable, set_aside, table

#: A chunk of LEAST bytes or more ends where this many top bits of the gear hash of the last WINDOW bytes are zero, or at MOST bytes.
BITS, LEAST, MOST, WINDOW = 5, 12, 160, 16
#: Words that consecutive repeated chunks must hold together to be deleted.
MIN_WORDS = 12
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: the sum of the last WINDOW bytes' table values, each shifted by its age."""
    h = GEAR[raw]
    for shift in (1, 2, 4, 8):  # sums over 2, 4, 8, WINDOW bytes
        if len(h) > shift:
            h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    return h


def cuts(raw: bytes) -> np.ndarray:
    """Ends of the chunks of a text's bytes; where a chunk ends depends on the bytes just before alone."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    h = gear(np.frombuffer(raw, np.uint8))
    # the hash's window holds fewer bytes at the start of a text: no chunk ends there
    ends = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0)
    ends = ends[ends >= WINDOW - 1] + 1
    out, last = [], 0
    for e in [*ends.tolist(), n]:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST or e == n and e > last:
            out.append(e)
            last = e
    return np.array(out, np.int64)


def digests(raw: bytes, ends: np.ndarray) -> list[int]:
    starts = [0, *ends[:-1].tolist()]
    return [xxhash.xxh3_64_intdigest(raw[a:b]) - (1 << 63) for a, b in zip(starts, ends.tolist())]


def without_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text less passages that are there before, the removed spans and how many words they hold.

    Chunks whose bytes a chunk before them has too, in this or another document, are repeated; a run
    of repeated chunks is deleted if it holds min_words words or more. The first copy stays.
    Documents come in order of doc_id (below 2^62), null last and these by a hash of their text; rows
    with an equal doc_id, or with none and an equal text, aren't copies of each other. `spans` are [begin, end) in
    bytes of the text's UTF-8, cut where characters begin. Null text stays null and empty text empty: no
    spans, 0 words. All columns are kept; columns named `spans` or `removed_words`, in any case, are replaced.
    No rows: no rows.
    """
    docs, named = set_aside(docs, "doc_id", "text", replaced=("spans", "removed_words"))
    names = docs.columns
    scratch = Scratch(docs.sparkSession)
    # documents without an id come last, by their texts' hashes
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62)))
    keyed = docs.select(doc.alias("doc"), F.xxhash64("text").alias("h"), "text")

    def run(batches):
        for batch in batches:
            doc, h, digest, n = [], [], [], 0
            for d, x, text in zip(column(batch, "doc"), column(batch, "h"), column(batch, "text")):
                raw = (text or "").encode()
                found = np.array(list(dict.fromkeys(digests(raw, cuts(raw)))), np.int64)
                doc.append(np.full(len(found), d))
                h.append(np.full(len(found), x))
                digest.append(found)
                n += len(found)
                if n > 50_000:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in (doc, h, digest)], names=["doc", "h", "digest"])
                    doc, h, digest, n = [], [], [], 0
            if n:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in (doc, h, digest)], names=["doc", "h", "digest"])

    chunks = scratch.write(keyed.mapInArrow(run, "doc long, h long, digest long"))
    first = chunks.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("digest", "first")
    again = chunks.join(scratch.write(first), "digest").where("doc > first").select("doc", "h", "digest")
    again = durable(again.groupBy("doc", "h").agg(F.collect_set("digest").alias("again")))
    scratch.close()

    mark, key, text_key = "again", "again_doc", "again_h"

    def rebuild(batches):
        for batch in batches:
            texts, spans, words = [], [], []
            for text, found in zip(column(batch, "text"), column(batch, mark)):
                new, cut, n = remove(text, set(found or ()), min_words)
                texts.append(new)
                spans.append([{"begin": a, "end": b} for a, b in cut])
                words.append(n)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(k) for k, c in enumerate(names)]
            yield pa.record_batch([*columns, pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(words, pa.int32())], names=[*names, "spans", "removed_words"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    marked = docs.select(*names, doc.alias(key), F.xxhash64("text").alias(text_key))
    marked = marked.join(again.select(F.col("doc").alias(key), F.col("h").alias(text_key), F.col("again").alias(mark)), [key, text_key], "left").select(*names, mark)
    return named(marked.mapInArrow(rebuild, f"{schema}, spans array<struct<begin: int, end: int>>, removed_words int"))


def remove(text: str | None, earlier: set[int], min_words: int):
    """The text less its runs of repeated chunks with enough words, their byte spans, and their words."""
    if not text:
        return text, [], 0
    raw = text.encode()
    ends = cuts(raw)
    found = digests(raw, ends)
    if not earlier and len(set(found)) == len(found):
        return text, [], 0
    starts = np.r_[0, ends[:-1]]
    mark, seen = np.zeros(len(ends) + 2, np.int8), set(earlier)
    for i, x in enumerate(found):
        mark[i + 1] = x in seen
        seen.add(x)
    step = np.diff(mark)
    spans, total = [], 0
    for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
        begin, end = int(starts[a]), int(ends[b - 1])
        while begin < end and raw[begin] & 0xC0 == 0x80:
            begin += 1
        while end < len(raw) and end > begin and raw[end] & 0xC0 == 0x80:
            end -= 1
        n = len(raw[begin:end].split())
        if n >= min_words:
            spans.append((begin, end))
            total += n
    keep, at = [], 0
    for a, b in spans:
        keep.append(raw[at:a])
        at = b
    keep.append(raw[at:])
    return b"".join(keep).decode(), spans, total


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
