"""Operator 6: token counts, each distinct pre-token counted once."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, sampled, table

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
#: Documents, about, whose pre-tokens are looked through for common ones; how many of those every
#: worker holds at most, and of how many bytes together.
SAMPLE, COMMON, COMMON_BYTES = 10_000, 200_000, 8 << 20
#: Bytes over which a pre-token isn't dealt out but tokenized where it is; how many bytes of such a task remembers.
LONG, REMEMBERED = 1 << 10, 16 << 20
#: Distinct pre-tokens that a task of the sample holds before it hands them on.
HELD = 100_000


def pieces_of(text: str) -> list[str]:
    """Pre-tokens of a text, whose token counts add up to the text's.

    No piece of the vocabulary holds a space mark after another character, and none holds a line
    feed, so no merge crosses the start of a run of spaces or touches a line feed. Tokenizing
    begins with one space mark, which stands for the space before the first word.
    """
    if not text:
        return []
    text = " " + text.replace("▁", " ")
    out: list[str] = []
    for line in text.split("\n"):
        words = line.split(" ")
        if words[0]:
            out.append(words[0])
        if "  " not in line and words[-1]:
            out += [" " + w for w in words[1:]]
            continue
        gap = 0
        for w in words[1:]:
            gap += 1
            if w:
                out.append(" " * gap + w)
                gap = 0
        if gap:
            out.append(" " * gap)
    out += ["\n"] * text.count("\n")
    return out


def load(path: str):
    """Token counter for a list of pre-tokens, by the file's library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(pieces: list[str]) -> list[int]:
        # a line feed in front stops the space mark that tokenizing would put before the piece
        return [len(x) - base for x in model.encode(["\n" + p for p in pieces], num_threads=1)]

    base = len(model.encode("\n", num_threads=1))
    return count


def frequent_pieces(docs: DataFrame, most: int) -> list[str]:
    """Pre-tokens found more than once in a sample of the documents, at most `most`.

    Which ones they are decides how fast a count is, not what it is.
    """

    def run(batches):
        held: Counter = Counter()

        def flush():
            names = [x for x in held if len(x.encode()) <= LONG]
            out = pa.record_batch([pa.array(names, pa.string()), pa.array([held[x] for x in names], pa.int64())], names=["piece", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in column(batch, "text"):
                if text:
                    held.update(pieces_of(text))
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    scratch = Scratch(docs.sparkSession)
    some = sampled(docs, SAMPLE / max(docs.count(), 1), "sample", "doc_id", "text").select("text")
    counted = scratch.write(some.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1"))
    # the least count that leaves few enough of them, from counts by powers of two
    by = counted.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("count"), F.sum(F.octet_length("piece")).alias("size"))
    least, total, size = 62, 0, 0
    for r in sorted(by.collect(), reverse=True):
        total, size = total + r["count"], size + r["size"]
        if total > most or size > COMMON_BYTES:
            break
        least = r.p
    found = [r.piece for r in counted.where(F.col("n") >= F.lit(1 << least)).select("piece").collect()]
    scratch.close()
    return found


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """n_bytes, n_tokens and over_limit of each document, as the tokenizer's library gives them.

    Common pre-tokens (COMMON at most, of COMMON_BYTES together at most) are tokenized once and go to
    every worker, which sums them document by document. The other pre-tokens of a document are dealt
    out by pre-token with their frequency, so that each distinct one is tokenized once, and their
    counts are summed by document; one of more than LONG bytes is tokenized by the task that finds it.
    No ids are kept. Needs doc_id and text; other columns are ignored. Null text counts as empty:
    0 bytes, 0 tokens. Rows with equal or null doc_id, and repeated rows, each get a row; rows are
    told apart by a 128-bit digest of doc_id and text. No rows: no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = frequent_pieces(docs, COMMON)
    known = spark.sparkContext.broadcast(dict(zip(names, load(path)(names))))
    del names

    def scan(batches):
        common, count, memo, held = known.value, None, {}, 0
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for start in range(0, len(ids), 500):
                rows = []
                for doc_id, text in zip(ids[start : start + 500], texts[start : start + 500]):
                    raw = (text or "").encode()
                    tokens, rest = 0, {}
                    for p in pieces_of(text or ""):
                        n = common.get(p)
                        if n is not None:
                            tokens += n
                        elif len(p) <= LONG // 4 or len(p.encode()) <= LONG:
                            rest[p] = rest.get(p, 0) + 1
                        else:
                            if p not in memo:
                                count = count or load(path)
                                held += len(p)
                                if held > REMEMBERED:
                                    memo, held = {}, len(p)
                                memo[p] = count([p])[0]
                            tokens += memo[p]
                    h = xxhash.xxh3_128_intdigest(f"{doc_id} ".encode() + raw)
                    g, h = (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)
                    rows.append((None, g, h, tokens, len(raw), doc_id))
                    rows += [(p, g, h, n, None, None) for p, n in rest.items()]
                piece, g, h, *rest = zip(*rows)
                yield pa.record_batch([pa.array(piece, pa.string()), *(pa.array(x, pa.int64()) for x in (g, h, *rest))], names=["piece", "g", "h", "n", "n_bytes", "doc_id"])

    def tokenize(batches):
        count, last, last_n = load(path), None, 0
        for batch in batches:
            pieces = batch.column(0).dictionary_encode()
            distinct = pieces.dictionary.to_pylist()
            fresh = count([p for p in distinct if p != last])
            if last in distinct:
                fresh.insert(distinct.index(last), last_n)
            if distinct:
                last, last_n = distinct[-1], fresh[-1]
            each = pa.array(fresh, pa.int64()).take(pieces.indices)
            n = pc.multiply(batch.column(3), pc.fill_null(each, 1))
            rows = pc.cast(pc.is_valid(batch.column(4)), pa.int32())
            yield pa.record_batch([batch.column(1), batch.column(2), n, rows, batch.column(4), batch.column(5)], names=["g", "h", "n", "rows", "n_bytes", "doc_id"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = docs.mapInArrow(scan, "piece string, g long, h long, n long, n_bytes long, doc_id long")
    # rows of documents, which have no piece, are dealt out by document
    dealt = F.when(F.col("piece").isNull(), F.col("g")).otherwise(F.xxhash64("piece"))
    pieces = pieces.repartition(parts, dealt).sortWithinPartitions("piece")
    every = pieces.mapInArrow(tokenize, "g long, h long, n long, rows int, n_bytes long, doc_id long")
    every = every.groupBy("g", "h").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.max("n_bytes").alias("n_bytes"), F.max("doc_id").alias("doc_id"))
    # equal rows were added up together: give each its share
    every = every.withColumn("n_tokens", F.expr("n div rows")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return every.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
