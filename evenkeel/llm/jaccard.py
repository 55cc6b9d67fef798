"""Operator 5: n-gram Jaccard join by a blocked sparse product.

The product of the document by n-gram incidence with its transpose holds the overlap of every pair.
Only entries that can reach the threshold are worked out:

- Rows that are equal are one class.
- N-grams are ordered, those that few rows have first, and a row stands in the columns of its first
  n - ceil(t n) + 1 n-grams alone: two rows within the threshold t share one of these.
- Columns are dealt out by n-gram. A column multiplies its rows, and overlap counts are summed by
  pair; pairs whose sizes, places in the order and counts so far leave them below the overlap that
  the threshold asks for are discarded.
- A row has a signature: bits, each the parity of how many of its n-grams fall there. Rows differ in as many
  n-grams as signatures in bits, at least; pairs whose signatures differ in more than the threshold allows are
  discarded, before whole rows move.
- A column with very many rows isn't multiplied out. Its rows meet the one that stands first in it;
  then rows that the links found so far leave apart meet, in tiles of rows by rows. A tile hands on which
  rows have a partner by place and signature, and then, from whole rows, the links that join them: never
  more rows than it has, whatever the number of pairs.
- The count of each pair that is left is finished by a product of whole rows, in blocks of one row by
  many others, and held against the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACES, Scratch, U64, WordIds, column, durable, groups, mixed, parts_by_bytes, set_aside, shingles, table
from .components import components

#: Bytes of an n-gram in a stored row of the matrix.
WIDTH = 6
GRAM = U64((1 << 8 * WIDTH) - 1)
#: Slots in which n-grams are counted by hash, for their order alone, and a summand of them that a row holds.
SLOTS, CHUNK = 1 << 19, 1 << 13
#: Bits of the filter that tells rows which later steps need, a power of two; 8 MB, at any size of the tables.
MARKS = 1 << 26
#: Bits of a signature: the power of two from the number of n-grams on, within these.
LEAST_BITS, MOST_BITS = 64, 2048
#: Large columns of a row, the first in order, by which a pair that meets in several is taken in one.
EARLY = 8
#: Rows of a column that are multiplied out; rows of a tile of a larger one, each way.
BLOCK, TILE = 64, 512
#: Rows that one other row is multiplied with at a time.
PARTNERS = 128
#: Rounds at most in which the rows of large columns meet one row each, before all that are still apart meet; the
#: pairs for each row that are few enough to do that at once.
STARS, FEW = 3, 200
#: Classes, and n-grams, of a component that one task multiplies with as many others; columns it holds at once.
PRODUCT, PRODUCT_GRAMS, COLUMNS = 1024, 3_000_000, 2048
#: Digests that a task remembers, to hand on an equal row once.
SEEN = 200_000
#: Halves of a packed number: n-grams of the row, and place of the n-gram in it.
N, AT = "shiftright({0}, 32)", "({0} & 4294967295)"


class Bound:
    """Integer forms of intersection / union >= percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n):
        return n - -(-self.percent * n // 100) + 1

    def least(self, both):
        """The overlap that two rows of so many n-grams together need."""
        return -(-self.percent * both // (100 + self.percent))

    def near(self, overlap, a, b):
        return 100 * overlap >= self.percent * (a + b - overlap)

    def most(self, both):
        """The n-grams in which two rows of so many together may differ."""
        return both - 2 * self.least(both)

    def can(self, a, b, i, j):
        """Whether rows of a and b n-grams whose first common ones are at places i and j can be near."""
        return np.minimum(a - i, b - j) >= self.least(a + b)

    def can_sql(self, x: str, y: str) -> str:
        """The same for packed numbers."""
        a, b, i, j = N.format(x), N.format(y), AT.format(x), AT.format(y)
        return f"least({a} - {i}, {b} - {j}) >= {self.least_sql(x, y)}"

    def least_sql(self, x: str, y: str) -> str:
        p = self.percent
        return f"(({p} * ({N.format(x)} + {N.format(y)}) + {99 + p}) div {100 + p})"

    def rest_sql(self, x: str) -> str:
        """How many n-grams of the row are in no column."""
        return f"(({self.percent} * {N.format(x)} + 99) div 100 - 1)"


def packed(x: np.ndarray) -> bytes:
    return (x >> U64(64 - 8 * WIDTH)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(x, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def signature(grams: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(grams) - 1).bit_length()))
    at = (grams >> U64(64 - 8 * WIDTH)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(at, minlength=bits) & 1 != 0, bitorder="little").tobytes()


def folded(signatures: np.ndarray, size: int) -> np.ndarray:
    """Signatures (rows of bytes) as they are with so many bytes."""
    return np.bitwise_xor.reduce(signatures.reshape(len(signatures), -1, size), axis=1)


def apart(a: bytes, b: bytes) -> int:
    """The bits in which two signatures differ, the longer one folded."""
    size = min(len(a), len(b))
    a, b = (folded(np.frombuffer(x, np.uint8)[None, :], size).tobytes() if len(x) > size else x for x in (a, b))
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def all_apart(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The same for each on the left with each on the right."""
    out = np.zeros((len(left), len(right)), np.int64)
    long = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    for size in np.unique(np.concatenate(long)):
        at = [np.flatnonzero(x >= size) for x in long]
        if not len(at[0]) or not len(at[1]):
            continue
        bits = [np.zeros((len(k), 8 * size), np.float32) for k in at]
        for side, k, x, to in zip((left, right), at, long, bits):
            for n in np.unique(x[k]):
                same = np.flatnonzero(x[k] == n)
                to[same] = np.unpackbits(folded(np.frombuffer(b"".join(side[r] for r in k[same]), np.uint8).reshape(-1, n), size), axis=1)
        differ = bits[0].sum(1)[:, None] + bits[1].sum(1)[None, :] - 2 * (bits[0] @ bits[1].T)
        here = np.minimum(long[0][at[0]][:, None], long[1][at[1]][None, :]) == size
        p, q = np.nonzero(here)
        out[at[0][p], at[1][q]] = differ[p, q].astype(np.int64)
    return out


def sets_of(texts: list[str | None], words: int, ids: WordIds):
    """The distinct n-grams of each text, sorted."""
    split = [(t or "").encode().lower().split() for t in texts]
    flat = ids.of([w for s in split for w in s])
    every = shingles(flat, words)
    end = 0
    for s in split:
        begin, end = end, end + len(s)
        grams = np.sort(every[begin : end - words + 1] if len(s) >= words else shingles(flat[begin:end], words))
        yield grams[np.r_[True, grams[1:] != grams[:-1]]] if len(grams) else grams


def incidence(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and h (hash of the text) to n (n-grams), id (64-bit digest of the set, null if empty or without doc_id)
    and, once or more for each id, the row of the matrix (the n-grams, packed in order of their hashes) and its signature."""

    def run(batches):
        ids, seen = WordIds(), set()
        for batch in batches:
            for part in parts_by_bytes(batch):
                n, keys, rows, marks = [], [], [], []
                doc_ids = column(part, "doc_id")
                for doc_id, grams in zip(doc_ids, sets_of(column(part, "text"), words, ids)):
                    key = row = mark = None
                    if len(grams) and doc_id is not None:
                        key = int(mixed(grams ^ PLACES[4]).sum(dtype=U64)) * 2 + len(grams) & (1 << 64) - 1
                        key -= (key >> 63) << 64
                        if key not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(key)
                            row, mark = packed(grams), signature(grams)
                    n.append(len(grams))
                    keys.append(key)
                    rows.append(row)
                    marks.append(mark)
                out = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(rows, pa.binary()), pa.array(marks, pa.binary())]
                yield pa.record_batch(out, names=["doc_id", "h", "n", "id", "row", "signature"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return docs.mapInArrow(run, "doc_id long, h long, n long, id long, row binary, signature binary")


def summed(values: DataFrame, size: int, add) -> np.ndarray:
    """Sum over all tasks of an array of `size` whole numbers, which is all that a task hands on, or the driver gets.

    add(batches) gives a task's array.
    """

    def run(batches):
        total = add(batches)
        chunks = [total[i : i + CHUNK].astype("<u4").tobytes() for i in range(0, size, CHUNK)]
        yield pa.record_batch([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks)], names=["at", "part"])

    def join(batches):
        for g in groups(batches, ["at"]):
            total = sum(np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in g.column("part"))
            yield pa.record_batch([g.column("at").combine_chunks().slice(0, 1), pa.array([total.tobytes()])], names=["at", "part"])

    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = values.mapInArrow(run, "at int, part binary").repartition(parts, "at").sortWithinPartitions("at")
    found = {r.at: np.frombuffer(r.part, np.int64) for r in tasks.mapInArrow(join, "at int, part binary").collect()}
    return np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(size, np.int64)


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams % U64(SLOTS)).astype(np.int64)


def column_counts(sets: DataFrame) -> np.ndarray:
    """How many rows (some of them stored more than once) have an n-gram of each slot."""

    def add(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in parts_by_bytes(batch, "row", 4 << 20):
                total += np.bincount(slots(unpacked(b"".join(column(part, "row")))), minlength=SLOTS)
        return total

    return summed(sets.where("row is not null").select("row"), SLOTS, add)


def marks(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of an id that is there, packed in words of 64."""
    at = ids.select(F.xxhash64("id").bitwiseAND(MARKS - 1).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(MARKS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[at >> 6] >> (at & 63) & 1 == 1


def needed(sets: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """(id, n, and the column of that name) of the given ids, each once.

    Those whose mark no given id has stay where they are; marks say less as ids grow (a row that
    isn't needed passes with 4 % at 3 million ids), up to every row moving once.
    """
    some = sets.sparkSession.sparkContext.broadcast(marks(ids))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(marked(some.value, batch.column(3).to_numpy()))).select([0, 1, 2])

    rows = sets.where(F.col(name).isNotNull()).select("id", "n", name, F.xxhash64("id").bitwiseAND(MARKS - 1).alias("at"))
    rows = rows.mapInArrow(run, f"id long, n long, {name} binary").join(ids, "id", "left_semi")
    return rows.groupBy("id").agg(F.first("n").alias("n"), F.first(name).alias(name))


def needed_rows(sets: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n, row) of the given ids, dealt by id: the one time that rows move for themselves."""
    return scratch.dealt(needed(sets, ids, "row"), "id")


def close_pairs(pairs: DataFrame, signatures: DataFrame, bound: Bound) -> DataFrame:
    """Of the pairs (a, b), those whose signatures (id, n, signature) leave them within the threshold."""
    for side in ("a", "b"):
        pairs = pairs.join(signatures.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("signature").alias(f"signature_{side}")), side)

    def run(batches):
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            differ = np.fromiter(map(apart, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, batch.num_rows)
            yield batch.filter(pa.array(differ <= bound.most(n))).select([0, 1])

    return pairs.select("a", "b", "n_a", "n_b", "signature_a", "signature_b").mapInArrow(run, "a long, b long")


def columns(sets: DataFrame, order, bound: Bound, often: bool) -> DataFrame:
    """Entries (gram, id, x) of the rows' first n-grams, either in slots that are often met or in the others.

    x holds the row's size and the n-gram's place in it.
    """

    def run(batches):
        rank, hot = order.value
        for batch in batches:
            for part in parts_by_bytes(batch, "row", 4 << 20):
                n = part.column(1).to_numpy()
                keys = unpacked(b"".join(column(part, "row")))
                keys = rank[slots(keys)].astype(U64) << U64(8 * WIDTH) | keys
                ends = np.cumsum(n)
                first = []
                for begin, end, p in zip(ends - n, ends, bound.prefix(n)):
                    row = keys[begin:end]
                    first.append(np.sort(np.partition(row, p - 1)[:p]))
                grams = np.concatenate(first) & GRAM if first else keys
                lengths = np.array([len(x) for x in first], np.int64)
                at = np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                keep = hot[slots(grams)] == often
                out = [grams.view(np.int64), np.repeat(part.column(0).to_numpy(), lengths), np.repeat(n, lengths) << 32 | at]
                yield pa.record_batch([pa.array(c[keep]) for c in out], names=["gram", "id", "x"])

    return sets.where("row is not null").select("id", "n", "row").mapInArrow(run, "gram long, id long, x long")


#: Columns of what products() and multiplied() give.
MET = ["gram", "a", "b", "x", "y"]


def products(batches, bound: Bound, block: int):
    """Entries (gram, id, x), sorted, to (a, b, x, y): every two rows of a column whose sizes allow a link, a < b.

    A column of more than `block` rows gives its entries back instead: (gram, null, id, x) as (gram, b = null, a = id, x).
    It is given back as it comes; no more than `block` + 1 of its entries are held beside a batch.
    """
    rest = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        gram, ids, x = (np.r_[r, batch.column(k).to_numpy()] for k, r in enumerate(rest))
        if not len(gram):
            continue
        new = np.r_[True, (gram[1:] != gram[:-1]) | (ids[1:] != ids[:-1])]  # an equal row may be stored more than once
        gram, ids, x = gram[new], ids[new], x[new]
        last = np.searchsorted(gram, gram[-1])
        yield from multiplied(gram[:last], ids[:last], x[:last], bound, block)
        held = max(last, len(gram) - block - 1)  # what stays is still more than a block if the column is
        if held > last:
            yield given_back(gram[last:held], ids[last:held], x[last:held])
        rest = [gram[held:], ids[held:], x[held:]]
    yield from multiplied(*rest, bound, block)


def given_back(gram: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(gram), pa.int64())
    return pa.record_batch([pa.array(gram), pa.array(ids), none, pa.array(x), none], names=MET)


def multiplied(gram: np.ndarray, ids: np.ndarray, x: np.ndarray, bound: Bound, block: int):
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
    size = np.repeat(np.diff(np.r_[starts, len(gram)]), np.diff(np.r_[starts, len(gram)]))
    many = size > block
    if many.any():
        yield given_back(gram[many], ids[many], x[many])
    few = (size > 1) & ~many
    gram, ids, x, size = gram[few], ids[few], x[few], size[few]
    for d in range(1, int(size.max(initial=1))):
        a = np.flatnonzero(gram[d:] == gram[:-d])
        b = a + d
        low, high = np.minimum(x[a] >> 32, x[b] >> 32), np.maximum(x[a] >> 32, x[b] >> 32)
        ok = 100 * low >= bound.percent * high
        if ok.any():
            a, b = a[ok], b[ok]
            yield pa.record_batch([pa.nulls(len(a), pa.int64()), *(pa.array(c) for c in (ids[a], ids[b], x[a], x[b]))], names=MET)


def linked_pairs(pairs: DataFrame, rows: DataFrame, bound: Bound) -> DataFrame:
    """Of the pairs (a, b), those within the threshold by the product of their whole rows.

    Of a pair, the row that is in more pairs is multiplied with up to PARTNERS others at a time and moved once
    for these, so a row that meets very many isn't moved for each of them. rows are dealt by id
    and are joined where they are.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("met"))
    for side in ("a", "b"):
        pairs = pairs.join(met.select(F.col("id").alias(side), F.col("met").alias(f"met_{side}")), side)
    turn = F.col("met_b") > F.col("met_a")
    turned = pairs.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), F.ceil(F.greatest("met_a", "met_b") / PARTNERS).cast("int").alias("blocks"))
    wanted = turned.select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = wanted.join(rows, "id").select("a", "block", (F.col("id") != F.col("a")).alias("other"), "id", "row")
    wanted = wanted.repartition(parts, "a", "block").sortWithinPartitions("a", "block", "other")

    def run(batches):
        left = None
        for batch in batches:
            out = []
            for a, other, b, row in zip(*(column(batch, c) for c in ("a", "other", "id", "row"))):
                row = unpacked(row)
                if not other:
                    left = row
                    continue
                at = np.searchsorted(left, row)
                at[at == len(left)] = 0
                if bound.near(int((left[at] == row).sum()), len(left), len(row)):
                    out.append((a, b))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), ()))], names=["a", "b"])

    return wanted.mapInArrow(run, "a long, b long")


def met_before(gram: int, left: list[list[int]], right: list[list[int]]) -> np.ndarray:
    """Of each on the left with each on the right, whether they have an n-gram in common that both have before this one.

    Each list is of n-grams in order.
    """
    left, right = ([x[: x.index(gram)] if gram in x else x for x in side] for side in (left, right))
    at = {g: k for k, g in enumerate({g for x in left for g in x} & {g for x in right for g in x})}
    if not at:
        return np.zeros((len(left), len(right)), bool)
    sides = [np.zeros((len(side), len(at)), np.float32) for side in (left, right)]
    for side, to in zip((left, right), sides):
        for k, x in enumerate(side):
            to[k, [at[g] for g in x if g in at]] = 1
    return sides[0] @ sides[1].T > 0


def tile_partners(batches, bound: Bound):
    """Tiles of large columns (gram, i, j, at, id, x, comp, early, signature), sorted: the rows (gram, i, j, at, id, comp) that
    can be near another in the tile, of another component."""
    for t in groups(batches, ["gram", "i", "j"]):
        gram, i, j = (t.column(c)[0].as_py() for c in ("gram", "i", "j"))
        at, ids, x, comp = (t.column(c).to_numpy() for c in ("at", "id", "x", "comp"))
        p, q = np.flatnonzero(at == i), np.flatnonzero(at == j)
        n, place = x >> 32, x & 0xFFFFFFFF
        early, signatures = t.column("early").to_pylist(), t.column("signature").to_pylist()
        some = np.zeros(len(at), bool)
        for r in np.array_split(p, -(-len(p) // TILE)) if len(p) else ():
            for c in np.array_split(q, -(-len(q) // TILE)) if len(q) else ():
                ok = bound.can(n[r][:, None], n[c][None, :], place[r][:, None], place[c][None, :]) & (comp[r][:, None] != comp[c][None, :])
                u, v = r[ok.any(1)], c[ok.any(0)]
                if len(u):
                    ok = ok[np.ix_(ok.any(1), ok.any(0))] & ~met_before(gram, [early[k] for k in u], [early[k] for k in v])
                    ok &= all_apart([signatures[k] for k in u], [signatures[k] for k in v]) <= bound.most(n[u][:, None] + n[v][None, :])
                    some[u[ok.any(1)]] = some[v[ok.any(0)]] = True
        if some.any():
            yield t.select(["gram", "i", "j", "at", "id", "comp"]).filter(pa.array(some)).combine_chunks().to_batches()[0]


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Of a symmetric matrix of links, as few as join all that they join."""
    seen, out = np.zeros(len(near), bool), []
    for root in np.flatnonzero(near.any(1)):
        rest = [] if seen[root] else [root]
        seen[root] = True
        while rest:
            u = rest.pop()
            new = np.flatnonzero(near[u] & ~seen)
            seen[new] = True
            rest.extend(new)
            out.extend((u, v) for v in new)
    return out


def tile_links(batches, bound: Bound):
    """Tiles (gram, i, j, at, id, comp, n, row), sorted: links (a, b) that join all rows within the threshold, by whole rows."""
    for t in groups(batches, ["gram", "i", "j"]):
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        at, ids, comp, n = (t.column(c).to_numpy() for c in ("at", "id", "comp", "n"))
        p, q = np.flatnonzero(at == i), np.flatnonzero(at == j)
        if not len(p) or not len(q):
            continue
        sets = [unpacked(r) for r in t.column("row").to_pylist()]
        ok = bound.near(overlaps([sets[k] for k in p], [sets[k] for k in q]), n[p][:, None], n[q][None, :]) & (comp[p][:, None] != comp[q][None, :])
        near = np.zeros((len(at), len(at)), bool)
        near[np.ix_(p, q)] = ok
        found = spanning(near | near.T)
        if found:
            a, b = ids[np.array(found)].T
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def links_in_tiles(members: DataFrame, early: DataFrame, signatures: DataFrame, rows: DataFrame, bound: Bound, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join what members (gram, id, x, comp, tiles) of columns can join across components.

    A pair is taken in the first of its columns alone, as far as early (id, early) has these, so whole
    rows move about once and not for each column.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(tiles: DataFrame) -> DataFrame:
        return tiles.repartition(parts, "gram", "i", "j").sortWithinPartitions("gram", "i", "j")

    tiles = members.join(early, "id").join(signatures.select("id", "signature"), "id")
    tiles = tiles.withColumn("at", F.pmod(F.xxhash64("id"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = dealt(tiles.select("gram", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "id", "x", "comp", "early", "signature"))
    some = scratch.write(tiles.mapInArrow(lambda x: tile_partners(x, bound), "gram long, i int, j int, at int, id long, comp long"))
    return dealt(some.join(rows, "id").select("gram", "i", "j", "at", "id", "comp", "n", "row")).mapInArrow(lambda x: tile_links(x, bound), "a long, b long").distinct()


def star_pairs(members: DataFrame, first, bound: Bound) -> DataFrame:
    """Pairs of each member (gram, id, x, comp) of a column with the one that is least by `first`, across components."""
    leads = members.groupBy("gram").agg(F.min(F.struct(first.alias("key"), "id", "x", "comp")).alias("lead"))
    met = members.join(leads, "gram").where("comp <> lead.comp").withColumn("y", F.col("lead.x")).where(bound.can_sql("x", "y"))
    return met.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()


def still_apart(big: DataFrame, linked: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, bool]:
    """The components (id, component) of linked; members (gram, id, x, comp, tiles) of the columns that have rows of several,
    None without any; whether their pairs are few enough for tiles."""
    parted = components(linked, scratch).withColumnRenamed("node", "id")
    members = big.join(parted, "id", "left").select("gram", "id", "x", F.coalesce("component", "id").alias("comp"))
    each = members.groupBy("gram", "comp").agg(F.count("*").alias("n"), F.sum(F.shiftright("x", 32)).alias("grams")).groupBy("gram")
    cols = each.agg(F.sum("n").alias("size"), F.sum("grams").alias("grams"), F.count("*").alias("comps"), F.sum(F.col("n") * F.col("n")).alias("inside")).where("comps > 1")
    # whole rows are held in a tile, so their n-grams count, too
    tiles = F.ceil(F.greatest(F.col("size") / TILE, F.col("grams") / PRODUCT_GRAMS)).cast("int").alias("tiles")
    cols = scratch.write(cols.select("gram", tiles, "size", ((F.col("size") * F.col("size") - F.col("inside")) / 2).alias("pairs")), "apart")
    size, pairs = cols.agg(F.sum("size"), F.sum("pairs")).first()
    if not size:
        return parted, None, True
    return parted, scratch.write(members.join(cols.select("gram", "tiles"), "gram"), "members"), pairs <= FEW * size


def links_of_large_columns(big: DataFrame, linked: DataFrame, tried: DataFrame, signatures: DataFrame, rows: DataFrame, bound: Bound, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """linked, with links that join all that members (gram, id, x) of large columns can join; the components (id, component) of them all.

    What a few rounds of one row against its column leave apart meets in tiles. A link's first common
    n-gram is in a column where both rows stand; where that is a large one and the rows are still
    in different components, they meet here. Components are worked out anew only where links were added, and a
    round of a row taken by hash that leaves no pair to try is the last.
    """
    place = F.struct(F.col("x").bitwiseAND(0xFFFFFFFF).alias("place"), "gram")
    early = big.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(place)), 1, EARLY)["gram"].alias("early"))
    parted, members, few = still_apart(big, linked, scratch)
    for k in range(STARS):
        if few:
            break
        # first the row with the fewest rarer n-grams, then others
        found = star_pairs(members, F.col("x").bitwiseAND(0xFFFFFFFF) if not k else F.xxhash64(F.lit(k), "id"), bound)
        found = scratch.write(found.join(tried, ["a", "b"], "left_anti"))
        if not found.limit(1).count():
            if k:
                break
            continue
        tried = tried.unionByName(found)
        new = scratch.write(linked_pairs(found, rows, bound))
        if new.limit(1).count():
            linked = linked.unionByName(new)
            parted, members, few = still_apart(big, linked, scratch)
    if members is not None:
        new = scratch.write(links_in_tiles(members, early, signatures, rows, bound, scratch))
        if new.limit(1).count():
            linked = linked.unionByName(new)
            parted = components(linked, scratch).withColumnRenamed("node", "id")
    return linked, parted


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set on the left shares with each on the right: a sparse product, accumulated by blocks of columns."""
    grams = np.concatenate(left + right)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    new = np.r_[True, grams[1:] != grams[:-1]]
    many = ~(new & np.r_[new[1:], True])  # a column with one entry adds nothing
    row, at = row[many], np.cumsum(new[many]) - 1
    out = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        lo, hi = np.searchsorted(at, [start, start + COLUMNS])
        block = np.zeros((len(left) + len(right), int(at[hi - 1]) - start + 1), np.float32)
        block[row[lo:hi], at[lo:hi] - start] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return out.astype(np.int64)


def tile_counts(batches, bound: Bound):
    """Tiles of components (component, i, j, at, id, times, n, row), sorted: (id, linked), the documents in other classes linked with a class."""
    for t in groups(batches, ["component", "i", "j"]):
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        at, ids, times, n = (t.column(c).to_numpy() for c in ("at", "id", "times", "n"))
        x, y = np.flatnonzero(at == i), np.flatnonzero(at == j)
        if not len(x) or not len(y):
            continue
        ok = 100 * np.minimum(n[x][:, None], n[y][None, :]) >= bound.percent * np.maximum(n[x][:, None], n[y][None, :])
        ok &= ids[x][:, None] < ids[y][None, :] if i == j else True
        left, right = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        if not len(left):
            continue
        p, q = np.nonzero(ok[np.ix_(left, right)])
        sets = [unpacked(r) for r in t.column("row").to_pylist()]
        shared = overlaps([sets[k] for k in x[left]], [sets[k] for k in y[right]])[p, q]
        p, q = x[left[p]], y[right[q]]
        near = bound.near(shared, n[p], n[q])
        p, q = p[near], q[near]
        linked = np.bincount(p, weights=times[q], minlength=len(at)) + np.bincount(q, weights=times[p], minlength=len(at))
        some = np.flatnonzero(linked)
        yield pa.record_batch([pa.array(ids[some]), pa.array(linked[some].astype(np.int64))], names=["id", "linked"])


def link_counts(parted: DataFrame, times: DataFrame, rows: DataFrame, bound: Bound, scratch: Scratch) -> DataFrame:
    """(id, linked) of the classes of components (id, component), each pair of a component tried in one tile, none handed on.

    No link leaves a component, so these are all links. A row of the matrix goes to as many tasks as
    its component has tiles to a side.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = scratch.write(parted.join(rows.select("id", "n"), "id").join(times, "id"), "each")
    sizes = each.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / PRODUCT, F.sum("n") / PRODUCT_GRAMS)).cast("int").alias("tiles"))
    tiles = each.join(sizes, "component").join(rows.select("id", "row"), "id")
    tiles = tiles.withColumn("at", F.pmod(F.xxhash64("id"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = tiles.select("component", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "id", "times", "n", "row")
    tiles = tiles.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return tiles.mapInArrow(lambda x: tile_counts(x, bound), "id long, linked long")


def all_link_counts(linked: DataFrame, parted: DataFrame, big: DataFrame | None, times: DataFrame, rows: DataFrame, bound: Bound, scratch: Scratch) -> DataFrame:
    """(id, linked): how many documents of other classes a class is linked with.

    Outside large columns every link was found by itself; a component with a row in one is gone through anew.
    """
    whole = None
    if big is not None:
        whole = scratch.write(parted.join(big.select("id").distinct(), "id").select("component").distinct(), "whole")
        each = link_counts(parted.join(whole, "component").select("id", "component"), times, rows, bound, scratch)
        at = parted.join(whole, "component", "left_anti").select("id")
        linked = linked.join(at.withColumnRenamed("id", "a"), "a", "left_semi")
    both = linked.select(F.col("a").alias("id"), F.col("b").alias("to")).union(linked.select("b", "a"))
    out = both.join(times.select(F.col("id").alias("to"), F.col("times").alias("linked")), "to").select("id", "linked")
    out = out if whole is None else out.unionByName(each)
    return out.groupBy("id").agg(F.sum("linked").alias("linked"))


def similar_rows(docs: DataFrame, words: int, percent: int, count_links: bool, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, n_links (null unless counted), component_id and kept of every document.

    kept: whether it is the first of its component, by doc_id and then h.
    """
    spark, bound = docs.sparkSession, Bound(percent)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = scratch.write(incidence(docs, words))
    filled = sets.where("id is not null").select("doc_id", "h", "n", "id")
    classes = scratch.write(filled.groupBy("id").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("times")))

    # the order of n-grams, and which ones have so many rows that a task shouldn't have a column to itself
    counts = column_counts(sets)
    hot = counts > max(4096, 8 * counts.mean())
    order = spark.sparkContext.broadcast((np.floor(1000 * np.log2(counts + 1.0)).astype(np.uint16), hot))
    entries = columns(sets, order, bound, False).repartition(parts, "gram").sortWithinPartitions("gram", "id")
    found = entries.mapInArrow(lambda x: products(x, bound, block), "gram long, a long, b long, x long, y long")
    # sums the overlaps of pairs; entries of large columns are groups of one
    found = scratch.write(found.groupBy("gram", "a", "b").agg(F.count("*").alias("o"), F.min("x").alias("x"), F.min("y").alias("y")))
    big = found.where("b is null").select("gram", F.col("a").alias("id"), "x")
    if hot.any():
        met = scratch.write(columns(sets, order, bound, True).distinct())
        several = met.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1").select("gram")
        big = scratch.write(big.unionByName(met.join(several, "gram")))
    pairs = found.where("b is not null").withColumn("unseen", F.lit(0))
    large = big.limit(1).count() > 0
    if large:
        # of a pair's common n-grams, so many at most are in large columns, and so not in its count
        at = scratch.write(big.groupBy("id").agg(F.count("*").alias("at")))
        pairs = pairs.join(at.select(F.col("id").alias("a"), F.col("at").alias("p")), "a", "left").join(at.select(F.col("id").alias("b"), F.col("at").alias("q")), "b", "left")
        pairs = pairs.withColumn("unseen", F.least(F.coalesce("p", F.lit(0)), F.coalesce("q", F.lit(0))))
    reach = f"unseen + least({N.format('x')} - {AT.format('x')}, {N.format('y')} - {AT.format('y')}) >= {bound.least_sql('x', 'y')}"
    total = f"unseen + o + greatest({bound.rest_sql('x')}, {bound.rest_sql('y')}) >= {bound.least_sql('x', 'y')}"
    pairs = scratch.write(pairs.where(f"{reach} and {total}").select("a", "b"))

    def met(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        return scratch.write((ids.union(big.select("id")) if large else ids).distinct())

    signatures = scratch.write(needed(sets, met(pairs), "signature"))
    pairs = scratch.write(close_pairs(pairs, signatures, bound))
    rows = needed_rows(sets, met(pairs), scratch)

    linked = scratch.write(linked_pairs(pairs, rows, bound))
    if large:
        linked, parted = links_of_large_columns(big, linked, pairs, signatures, rows, bound, scratch)
    else:
        parted = components(linked, scratch).withColumnRenamed("node", "id")
    if count_links:
        counted = all_link_counts(linked, parted, big if large else None, classes.select("id", "times"), rows, bound, scratch)
        classes = scratch.write(classes.join(counted, "id", "left").withColumn("n_links", F.col("times") - 1 + F.coalesce("linked", F.lit(0))))
    else:
        classes = classes.withColumn("n_links", F.lit(None).cast("long"))
    lowest = parted.join(classes, "id").groupBy("component").agg(F.min("first").alias("lowest"))
    parted = parted.join(lowest, "component").select("id", "lowest")
    known = scratch.write(classes.join(parted, "id", "left").select("id", "n_links", F.coalesce("lowest", "first").alias("head")))
    out = filled.join(known, "id").select(
        "doc_id", "h", F.col("n").alias("n_shingles"), "n_links", F.col("head.doc_id").alias("component_id"), (F.struct("doc_id", "h") == F.col("head")).alias("kept")
    )
    none = F.lit(0 if count_links else None).cast("long").alias("n_links")
    rest = sets.where("id is null").select("doc_id", "h", F.col("n").alias("n_shingles"), none, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(rest)


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80, count_links: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; with `count_links` also n_links, the documents linked directly.

    Words are what ASCII white space parts, with A-Z lower-cased; a document's set is that of its
    shingles of so many words (of the whole sequence if it has fewer). Documents whose sets have
    intersection / union >= percent / 100 are linked; component_id is the least doc_id that links
    reach. No text or no word: n_shingles 0, linked with nothing. Rows with equal doc_id each get a
    row; they are linked if their sets are. A null doc_id is linked with nothing: component_id null,
    n_links 0.
    Other columns are ignored. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        return durable(similar_rows(docs, words, percent, count_links, scratch, block).select("doc_id", "n_shingles", *["n_links"] * count_links, "component_id"))
    finally:
        scratch.close()


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), words=3, percent=90, count_links=True)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Pipeline stage: of each group of similar documents the one with the least doc_id, all columns kept.

    Rows with equal doc_id are told apart by their text; of rows equal in both one stays, if their
    document does. Documents without words, and rows with a null doc_id, all stay.
    """
    docs, named = set_aside(docs, "doc_id", "text")
    scratch = Scratch(docs.sparkSession)
    try:
        heads = similar_rows(docs, words, percent, False, scratch).where("kept and n_shingles > 0 and doc_id is not null")
        heads = durable(heads.select(F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h")).distinct())
    finally:
        scratch.close()
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()
    marked = docs.withColumn("h", F.xxhash64("text"))
    kept = marked.where(worded).join(heads, (F.col("doc_id") == F.col("kept_id")) & (F.col("h") == F.col("kept_h")), "left_semi")
    return named(kept.dropDuplicates(["doc_id", "h"]).drop("h").unionByName(docs.where(~worded)))
