"""Operator 11: how two tokenizers' tokens of the same bytes line up, and how often over a corpus."""

from __future__ import annotations

import bisect
import os
import re
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, durable, parts_by_bytes, table

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct pairs that a task counts before it hands its counts on; bytes of segments that a task remembers (twice, see pieces).
PARTIAL, REMEMBERED, LONG = 1 << 20, 96 << 20, 1 << 10
#: Bytes of count shards that a task holds where their store can't be mapped into memory.
SHARD_BYTES = 256 << 20
#: Characters of the property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Ids of both tokenizers, by segments of space + text cut where neither joins tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        # Spark deals the work out; threads of its own would only hold memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = byte_letters()
        names = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(names.values()))
        for name, i in names.items():
            self.bytes_a[i] = bytes(letters.get(c, 0) for c in name)
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = [b.id_to_piece(i) for i in range(b.vocab_size()) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))]
        self.bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())]
        # neither joins tokens over the start of white space, but B where a piece has that character inside
        inside = re.compile(f"[^{WHITE}▁]([{WHITE}▁])")
        inner = {c for p in plain for c in inside.findall(p)}
        rest = f"(?:[{''.join(map(re.escape, sorted(inner)))}][{WHITE}]*[^{WHITE}]*)*" if inner else ""
        self.cut = re.compile(f"[{WHITE}]*[^{WHITE}]+{rest}|[{WHITE}]+" if not inner & {" ", "▁"} else "(?s:.+)").findall
        self.base = len(b.encode("\n", num_threads=1))
        self.held: dict[str, tuple[bytes, bytes]] = {}
        self.older, self.size = self.held, 0

    def remember(self, segment: str, found: tuple[bytes, bytes]) -> None:
        if len(segment) <= LONG:
            self.size += 300 + len(segment) + len(found[0]) + len(found[1])
            if self.size > REMEMBERED:
                self.older, self.held, self.size = self.held, {}, 0
            self.held[segment] = found

    def ids(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of A and of B of space + each text, as 32-bit numbers in a row."""
        cut = [self.cut(" " + t) if t else [] for t in texts]
        get = self.held.get
        here = {s: get(s) for segments in cut for s in segments}
        fresh = []
        for s, known in here.items():
            if known is None:
                if (known := self.older.get(s)) is None:
                    fresh.append(s)
                else:
                    here[s] = known
                    self.remember(s, known)
        if fresh:
            for start in range(0, len(fresh), 1000):
                some = fresh[start : start + 1000]
                # a line feed in front stops the space mark that tokenizing would put before the segment
                all_b = self.b.encode(["\n" + s for s in some], num_threads=1)
                for s, a, b in zip(some, self.a.encode_batch(some, add_special_tokens=False), all_b):
                    here[s] = found = array("i", a.ids).tobytes(), array("i", b[self.base :]).tobytes()
                    self.remember(s, found)
        out = []
        for segments in cut:
            found = [here[s] for s in segments]
            out.append((b"".join([a for a, _ in found]), b"".join([b for _, b in found])))
        return out


class Aligner:
    """Lines the two token sequences of texts up, many texts at once."""

    def __init__(self, path_a: str, path_b: str):
        self.both = Tokenizers(path_a, path_b)
        self.bytes = [pa.array(x, pa.binary()) for x in (self.both.bytes_a, self.both.bytes_b)]
        self.sizes = [np.array([len(p) for p in x], np.int64) for x in (self.both.bytes_a, self.both.bytes_b)]
        self.width = len(self.both.bytes_b)
        # each id's decimal digits, with the sign after it within its group and at the end of its side
        digits = [[str(i) for i in range(len(x))] for x in self.sizes]
        self.signs = pa.array([d + sign for names, end in zip(digits, "|;") for sign in ("," + end) for d in names], pa.string())

    @staticmethod
    def lists(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and where each row ends."""
        return np.frombuffer(b"".join(rows), np.int32), np.cumsum([len(r) // 4 for r in rows], dtype=np.int64)

    @staticmethod
    def joined(values: pa.Array, ends: np.ndarray):
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values), pa.scalar("" if values.type == pa.string() else b"", values.type))

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links) of each text; its groups as text; the ends of each text's distinct pairs among all, those, and the links of each."""
        found = self.both.ids(texts)
        want = pa.array([(" " + t).encode() if t else b"" for t in texts], pa.binary())
        rows = list(zip(*found))
        same = np.ones(len(texts), bool)
        for side, values in zip(rows, self.bytes):
            ids, ends = self.lists(side)
            same &= pc.equal(self.joined(values.take(pa.array(ids)), ends), want).to_numpy(zero_copy_only=False)
        ids, ends = zip(*(self.lists([r if ok else b"" for r, ok in zip(side, same)]) for side in rows))
        bytes_of = np.where(same, pc.binary_length(want).to_numpy(), 0)
        # the texts lie behind each other; both sides' tokens end somewhere in the same row of bytes
        text_ends = np.cumsum(bytes_of, dtype=np.int64)
        token_ends = [np.cumsum(size[i]) for size, i in zip(self.sizes, ids)]
        # between two ends of either side lies what one token of each have in common
        link_ends = np.union1d(*token_ends)
        a, b = (i[np.searchsorted(e, link_ends)].astype(np.int64) for i, e in zip(ids, token_ends))
        group_ends = np.intersect1d(*token_ends, assume_unique=True)
        n = len(texts)
        numbers = np.stack([np.diff(ends[0], prepend=0), np.diff(ends[1], prepend=0), *(np.bincount(np.searchsorted(text_ends, e), minlength=n)[:n] for e in (group_ends, link_ends))])
        # rows of links by text; a text's number stands above its pairs' bits
        bits = int(len(self.sizes[0]) * self.width).bit_length()
        keys, times = np.unique((np.searchsorted(text_ends, link_ends) << bits) + a * self.width + b, return_counts=True)
        pair_ends = np.cumsum(np.bincount(keys >> bits, minlength=n)[:n])
        # tokens by group, then side
        order, marks, shift = [], [], 0
        for side, (i, e) in enumerate(zip(ids, token_ends)):
            group = np.searchsorted(group_ends, e)
            order.append(2 * group + side)
            marks.append(shift + i + len(self.sizes[side]) * (group_ends[group] == e if len(e) else np.zeros(0, bool)))
            shift += 2 * len(self.sizes[side])
        marks = np.concatenate(marks)[np.argsort(np.concatenate(order), kind="stable")]
        groups = self.joined(self.signs.take(pa.array(marks)), ends[0] + ends[1])
        return numbers, [g[:-1] for g in groups.to_pylist()], pair_ends, keys & (1 << bits) - 1, times


@lru_cache(maxsize=1)
def one_aligner(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a worker process."""
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Groups and links of each document, by the library's own tokens.

    doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), pairs (the distinct linked id
    pairs, sorted, each packed into a long: A's id times B's vocabulary plus B's id) and times (links of
    each pair). Space + text is tokenized; tokens are linked where their byte ranges overlap, groups end
    where tokens of both end. Texts that are null, empty or don't come back byte by byte from both (a
    U+2581 in the text) have no tokens. Special strings are plain text. Null, equal and repeated doc_id:
    a row each. No shuffle; a text is held whole, with some 100 bytes a token. No rows: no rows.
    """

    def run(batches):
        aligner = one_aligner(path_a, path_b)
        for whole in batches:
            for batch in parts_by_bytes(whole, most=1 << 18):
                numbers, groups, ends, pairs, times = aligner.batch(column(batch, "text"))
                at = pa.array(np.concatenate([[0], ends]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((pairs, pa.int64()), (times, pa.int32()))]
                yield pa.record_batch([batch.column(0), *map(pa.array, numbers), pa.array(groups, pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def run_sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array, and the sum of each run."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(n, starts)


def partial_counts(batches):
    """Counts of the packed pairs of a partition, distinct up to PARTIAL."""
    keys, n, fresh, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def together():
        new, k = np.unique(np.concatenate(fresh), return_counts=True)
        both = np.concatenate([keys, new])
        order = np.argsort(both, kind="stable")
        return run_sums(both[order], np.concatenate([n, k])[order])

    for batch in batches:
        flat = pc.list_flatten(batch.column(0)).to_numpy()
        fresh.append(flat)
        waiting += len(flat)
        if waiting >= PARTIAL:
            keys, n = together()
            fresh, waiting = [], 0
            if len(keys) >= PARTIAL:
                yield pa.record_batch([keys, n], names=["pair", "n"])
                keys, n = keys[:0], n[:0]
    if waiting:
        keys, n = together()
    if len(keys):
        yield pa.record_batch([keys, n], names=["pair", "n"])


def store(uri: str):
    """The file system of a folder that all executors see, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def shard_writer(folder: str, width: int):
    """Sums the runs of a sorted partition and writes them as one file of sorted keys and counts.

    Gives a row per A id: the file, its first and last key, the id and its highest count there. Each
    attempt of a task has a file of its own, and only the rows of the attempt that counts name theirs.
    """

    def run(batches):
        last_key = last_n = sink = writer = None
        best: dict[int, int] = {}
        first = None
        schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

        def put(keys, n):
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] // width != keys[:-1] // width]))
            for a, top in zip((keys[starts] // width).tolist(), np.maximum.reduceat(n, starts).tolist()):
                best[a] = max(best.get(a, 0), top)
            writer.write_batch(pa.record_batch([keys, n], schema=schema))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if writer is None:
                system, at = store(folder)
                system.create_dir(at, recursive=True)
                name = f"{at}/{uuid.uuid4().hex}.arrow"
                sink = system.open_output_stream(name)
                writer = pa.ipc.new_file(sink, schema)
                first = int(keys[0])
            else:
                keys, n = np.concatenate([[last_key], keys]), np.concatenate([[last_n], n])
            keys, n = run_sums(keys, n)
            last_key, last_n = keys[-1], n[-1]
            if len(keys) > 1:
                put(keys[:-1], n[:-1])
        if writer is not None:
            put(np.array([last_key], np.int64), np.array([last_n], np.int64))
            writer.close()
            sink.close()
            rows = sorted(best.items())
            yield pa.record_batch([[name.rsplit("/", 1)[1]] * len(rows), [first] * len(rows), [int(last_key)] * len(rows), [a for a, _ in rows], [n for _, n in rows]], names=["file", "first", "last", "a", "best"])

    return run


class Shards:
    """Counts by key from sorted files, mapped into memory; from a store that can't be mapped, some of them are held."""

    def __init__(self, folder: str, files: list[tuple[int, int, str]]):
        self.folder, self.files = folder, sorted(files)
        self.lasts = [last for _, last, _ in self.files]
        self.open, self.size = {}, 0

    def shard(self, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if k not in self.open:
            from pyarrow import fs

            system, at = store(self.folder)
            name = f"{at}/{self.files[k][2]}"
            if isinstance(system, fs.LocalFileSystem):
                source = pa.memory_map(name)
            else:
                with system.open_input_file(name) as f:
                    source = pa.py_buffer(f.read())
                self.size += len(source)
                if self.size > SHARD_BYTES:
                    self.open, self.size = {}, len(source)
            reader = pa.ipc.open_file(source)
            parts = [reader.get_batch(i) for i in range(reader.num_record_batches)]
            self.open[k] = [(p.column(0).to_numpy(), p.column(1).to_numpy()) for p in parts]
        return self.open[k]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of each of some sorted keys that the files hold."""
        out = np.zeros(len(keys), np.int64)
        at = 0
        while at < len(keys):
            k = bisect.bisect_left(self.lasts, int(keys[at]))
            stop = int(np.searchsorted(keys, self.lasts[k], side="right"))
            for held, n in self.shard(k):
                if at == stop:
                    break
                if held[-1] < keys[at]:
                    continue
                end = at + int(np.searchsorted(keys[at:stop], held[-1], side="right"))
                out[at:end] = n[np.searchsorted(held, keys[at:end])]
                at = end
        return out


class PairCounts:
    """How many documents hold each id pair linked, as sorted shards, and the highest count of each A id."""

    def __init__(self, rows: DataFrame, width: int, scratch: Scratch):
        spark = rows.sparkSession
        self.width, self.folder = width, f"{scratch.path}/shards-{uuid.uuid4().hex}"
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        partial = scratch.write(rows.select("pairs").mapInArrow(partial_counts, "pair long, n long"))
        ranged = partial.repartitionByRange(parts, "pair").sortWithinPartitions("pair")
        made = scratch.write(ranged.mapInArrow(shard_writer(self.folder, width), "file string, first long, last long, a long, best long"))
        # one row a shard, one row an id of the vocabulary
        self.files = [(r["first"], r["last"], r["file"]) for r in made.select("file", "first", "last").distinct().collect()]
        self.best = made.groupBy("a").agg(F.max("best").alias("best"))

    def table(self, spark: SparkSession) -> DataFrame:
        """a, b and n: the counts as rows."""
        folder, width, names = self.folder, self.width, [f for _, _, f in self.files]

        def run(batches):
            for batch in batches:
                for name in column(batch, "file"):
                    for keys, n in Shards(folder, [(0, 0, name)]).shard(0):
                        yield pa.record_batch([keys // width, keys % width, n], names=["a", "b", "n"])

        return spark.createDataFrame([(n,) for n in names], "file string").repartition(max(len(names), 1), "file").mapInArrow(run, "a long, b long, n long")

    def scores(self, rows: DataFrame) -> DataFrame:
        """rows (as of align) with n_best and count_sum: links whose pair is the most frequent of its A id, and counts summed over links."""
        tops = self.best.collect()
        best = np.zeros(1 + max((r.a for r in tops), default=0), np.int64)
        for r in tops:
            best[r.a] = r.best
        folder, files, width = self.folder, self.files, self.width
        held = rows.sparkSession.sparkContext.broadcast((best, files))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

        def run(batches):
            best, files = held.value
            shards = Shards(folder, files)
            for batch in batches:
                pairs, times = batch.column(len(names)), batch.column(len(names) + 1)
                keys, back = np.unique(pc.list_flatten(pairs).to_numpy(), return_inverse=True)
                n = shards.counts(keys)
                top = n == best[keys // width] if len(keys) else np.zeros(0, bool)
                k = pc.list_flatten(times).to_numpy().astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(pairs).to_numpy())]).astype(np.int64)
                sums = [np.concatenate([[0], np.cumsum(k * x[back])]) for x in (top.astype(np.int64), n)]
                yield pa.record_batch([*batch.columns[: len(names)], *(s[ends[1:]] - s[ends[:-1]] for s in sums)], names=[*names, "n_best", "count_sum"])

        schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
        return rows.select(*names, "pairs", "times").mapInArrow(run, schema)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    import sentencepiece

    a, b = public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)
    rows = align(table(spark, sf_dir, "documents"), a, b)
    rows = rows.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))).drop("groups")
    scratch = Scratch(spark)
    try:
        rows = scratch.write(rows)
        counts = PairCounts(rows, sentencepiece.SentencePieceProcessor(model_file=b).vocab_size(), scratch)
        return durable(counts.scores(rows))
    finally:
        scratch.close()
