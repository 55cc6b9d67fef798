"""Operator 8: embedding near-dedup by cross-polytope hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, durable, groups, table
from .components import components

COSINE = 0.93
#: Hash values that make a bucket, and tables with such buckets, by the number of different vectors:
#: each value parts them 2 * dimension ways; more values find a near pair less often in one table.
PLANS = ((1 << 14, 1, 6), (1 << 22, 2, 10), (1 << 30, 3, 16), (1 << 62, 4, 24))
#: Further buckets of each vector and table that are looked into.
PROBES = 2
#: Members of a bucket that one task sets against as many others.
TILE = 1024
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, -1, 2, step)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), 2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def hashes(x: np.ndarray, values: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket numbers: the vector's own, then those that are nearest otherwise.

    A value is the nearest of the 2 * width signed axes after three rounds of random signs and a
    Hadamard transform. The probes change one value to its second axis, where that costs least.
    """
    n, dims = x.shape
    width = 1 << max(1, dims - 1).bit_length()
    padded = np.zeros((n, width))
    padded[:, :dims] = x
    out = np.zeros((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        axes, others, costs = [], [], []
        for v in range(values):
            signs = np.random.default_rng([SEED, t, v]).choice([-1.0, 1.0], (3, width))
            y = padded
            for s in signs:
                y = hadamard(y * s)
            size = np.abs(y)
            top = np.argpartition(-size, min(2, width - 1), axis=1)[:, : min(3, width)]
            order = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
            at = order + width * (np.take_along_axis(y, order, 1) < 0)
            axes.append(at[:, 0])
            for k in range(1, order.shape[1]):
                others.append((v, at[:, k]))
                costs.append(np.take_along_axis(size, order[:, :1], 1)[:, 0] - np.take_along_axis(size, order[:, k : k + 1], 1)[:, 0])
        base = (2 * width) ** np.arange(values, dtype=np.int64)
        own = (np.array(axes).T * base).sum(1)
        out[:, t, 0] = own
        best = np.argsort(np.array(costs).T, axis=1, kind="stable")
        moved = np.array([own + (at - axes[v]) * base[v] for v, at in others]).T
        for p in range(probes):
            out[:, t, 1 + p] = np.take_along_axis(moved, best[:, p % moved.shape[1] :][:, :1], 1)[:, 0]
    return out


def valid(raw) -> np.ndarray | None:
    """Unit vector in double precision, or none for null, empty, zero vectors and those with a null or non-finite component."""
    if raw is None or not len(raw) or any(v is None for v in raw):
        return None
    x = np.array(raw, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, label, id, vec): id is a digest of label and vector, null for what is linked with nothing."""

    def run(batches):
        for batch in batches:
            vecs = [valid(v) for v in batch.column(1).to_pylist()]
            labels = batch.column(2).to_pylist()
            vecs = [v if k is not None else None for v, k in zip(vecs, labels)]
            ids = [None if v is None else xxhash.xxh3_64_intdigest(repr(k).encode() + b"\0" + v.tobytes()) - (1 << 63) for v, k in zip(vecs, labels)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(ids, pa.int64()), pa.array([None if v is None else v.tobytes() for v in vecs], pa.binary())], names=["vec_id", "label", "id", "vec"])

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    return rows.mapInArrow(run, "vec_id long, label string, id long, vec binary")


def forest(p: np.ndarray, q: np.ndarray, far: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Which of the edges p[e]-q[e] make a least spanning forest of the components; nearest first."""
    names, label = np.unique(comp, return_inverse=True)
    key = far.astype(np.int64) * len(p) + np.arange(len(p))
    taken, never = [], np.iinfo(np.int64).max
    root = np.arange(len(names))
    while True:
        a, b = label[p], label[q]
        cross = a != b
        if not cross.any():
            return np.unique(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
        best = np.full(len(names), never)
        np.minimum.at(best, a[cross], key[cross])
        np.minimum.at(best, b[cross], key[cross])
        new = np.unique(best[best < never] % len(p))
        taken.append(new)
        for e in new:
            x, y = label[p[e]], label[q[e]]
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def tile_links(batches, cosine: float):
    """Tiles of buckets (bucket, i, j, t, id, at, home, times, codes, vec), sorted: (a, b, n).

    Where b is null, n more vectors are linked with a; else a and b are an edge of a tile's spanning
    forest. A pair counts only in the first of the buckets in which it meets.
    """
    for g in groups(batches, ["bucket", "i", "j"]):
        i, j, t = (g.column(c)[0].as_py() for c in ("i", "j", "t"))
        at, ids, home, times = (g.column(c).to_numpy() for c in ("at", "id", "home", "times"))
        if len(ids) < 2:
            continue
        x, y = np.flatnonzero(at == i), np.flatnonzero(at == j)
        if not len(x) or not len(y):
            continue
        vecs = np.frombuffer(b"".join(g.column("vec").to_pylist())).reshape(len(at), -1)
        near = vecs[x] @ vecs[y].T >= cosine
        near &= ids[x][:, None] < ids[y][None, :] if i == j else True
        near &= home[x][:, None] | home[y][None, :]
        p, q = np.nonzero(near)
        if not len(p):
            continue
        p, q = x[p], y[q]
        codes = np.frombuffer(b"".join(g.column("codes").to_pylist()), np.int64).reshape(len(at), -1, 1 + PROBES)
        first = np.ones(len(p), bool)
        for k in range(t):
            first &= ~meets(codes[p, k], codes[q, k])[0]
        both, mine, theirs = meets(codes[p, t], codes[q, t])
        # in this table the pair meets where both are at home; else in the bucket of the one with the lesser id, if the other looks there
        same = codes[p, t, 0] == codes[q, t, 0]
        low_is_p = ids[p] < ids[q]
        at_low = np.where(low_is_p, home[p], home[q])
        low_found = np.where(low_is_p, theirs, mine)
        first &= np.where(same, home[p] & home[q], np.where(low_found, at_low, ~at_low))
        p, q = p[first], q[first]
        if not len(p):
            continue
        counts = np.bincount(p, weights=times[q], minlength=len(at)) + np.bincount(q, weights=times[p], minlength=len(at))
        some = np.flatnonzero(counts)
        e = forest(p, q, np.zeros(len(p)), ids)
        a, b = np.r_[ids[some], ids[p[e]]], [None] * len(some) + ids[q[e]].tolist()
        yield pa.record_batch([pa.array(a), pa.array(b, pa.int64()), pa.array(np.r_[counts[some], np.zeros(len(e))].astype(np.int64))], names=["a", "b", "n"])


def meets(a: np.ndarray, b: np.ndarray):
    """Whether two vectors share a bucket of a table in which one is at home; whether a looks where b is at home; b where a is."""
    same = a[:, 0] == b[:, 0]
    a_looks = (a[:, 1:] == b[:, :1]).any(1)
    b_looks = (b[:, 1:] == a[:, :1]).any(1)
    return same | a_looks | b_looks, a_looks, b_looks


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors with equal labels and as many components are linked if their cosine, in double precision,
    is `cosine` or more; pairs are looked for where their hashes meet, equal vectors always meet. How
    many hashes there are goes by the number of different vectors (PLANS): of pairs at a cosine of
    0.93, in 64 to 768 dimensions, each plan finds nine in ten or more, so which of the others
    are found may change when vectors are added. n_links counts the
    vectors linked directly, component_id is the least vec_id that links reach. Vectors that are
    null, empty or zero, hold a null or a component that isn't finite, or have no label, are linked
    with nothing: n_links 0, component_id their own. Rows with equal vec_id are separate vectors.
    A null vec_id is counted by others; its component_id is its component's, null if it is alone.
    Other columns are ignored. No rows: no rows.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark)
    found = scratch.write(prepared(rows))
    some = found.where("id is not null")
    classes = some.groupBy("id").agg(F.count("*").alias("times"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = scratch.write(classes)
    n = classes.count()
    values, tables = next((v, t) for most, v, t in PLANS if n <= most)

    def hashed(batches):
        for batch in batches:
            names = batch.schema.names
            vecs, labels = batch.column(names.index("vec")).to_pylist(), batch.column(names.index("label")).to_pylist()
            by: dict[int, list[int]] = {}
            for k, v in enumerate(vecs):
                by.setdefault(len(v), []).append(k)
            for _, at in by.items():
                h = hashes(np.frombuffer(b"".join(vecs[k] for k in at)).reshape(len(at), -1), values, tables)
                for t in range(tables):
                    for p in range(1 + PROBES):
                        keys = [xxhash.xxh3_64_intdigest(f"{t} {c} {len(vecs[k])} {labels[k]}") - (1 << 63) for c, k in zip(h[:, t, p].tolist(), at)]
                        yield pa.record_batch(
                            [pa.array(keys, pa.int64()), batch.column(names.index("id")).take(pa.array(at)), pa.array([p == 0] * len(at)), pa.array([t] * len(at), pa.int32())], names=["bucket", "id", "home", "t"]
                        )

    def coded(batches):
        for batch in batches:
            names = batch.schema.names
            vecs = batch.column(names.index("vec")).to_pylist()
            codes = [hashes(np.frombuffer(v).reshape(1, -1), values, tables).tobytes() for v in vecs] if len({len(v) for v in vecs}) > 1 else [h.tobytes() for h in hashes(np.frombuffer(b"".join(vecs)).reshape(len(vecs), -1), values, tables)] if vecs else []
            yield pa.record_batch([batch.column(names.index(c)) for c in ("id", "times", "vec")] + [pa.array(codes, pa.binary())], names=["id", "times", "vec", "codes"])

    entries = scratch.write(classes.mapInArrow(hashed, "bucket long, id long, home boolean, t int").dropDuplicates(["bucket", "id", "home"]))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.max("home").alias("lived_in"))
    sizes = scratch.write(sizes.where("size > 1 and lived_in").select("bucket", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")))
    codes = scratch.write(classes.mapInArrow(coded, "id long, times long, vec binary, codes binary"))
    tiles = scratch.write(entries.join(sizes, "bucket")).join(codes, "id")
    tiles = tiles.withColumn("at", F.pmod(F.xxhash64("id"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = tiles.select("bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "t", "id", "at", "home", "times", "codes", "vec")
    tiles = tiles.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    links = scratch.write(tiles.mapInArrow(lambda x: tile_links(x, cosine), "a long, b long, n long"))
    counts = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    parted = components(links.where("b is not null").select("a", "b").distinct(), scratch).withColumnRenamed("node", "id")
    firsts = classes.select("id", "times", "first")
    lowest = parted.join(firsts, "id").groupBy("component").agg(F.min("first").alias("lowest"))
    parted = parted.join(lowest, "component").select("id", "lowest")
    known = firsts.join(counts, "id", "left").join(parted, "id", "left")
    known = scratch.write(known.select("id", (F.col("times") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("lowest", "first").alias("component_id")))
    out = some.select("vec_id", "id").join(known, "id").select("vec_id", "n_links", "component_id")
    rest = found.where("id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = durable(out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
    scratch.close()
    return out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
