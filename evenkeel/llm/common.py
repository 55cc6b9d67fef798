"""What several operators share: tables, durable intermediates, hashing, groups in a sorted stream."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Odd multipliers of the words of a shingle, by place.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U64)
NO_COALESCE = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset and all runs on one machine, as in tests, a temporary one; on a cluster an error.
    """
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="evenkeel-")
        shared_dir.own = at
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(at)
    return at


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the checkpoint folder.

    The result claims no partitioning (coalesce to more partitions than there are moves
    nothing), so a later join shuffles both of its sides and Spark can split hot keys there.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True).coalesce(NO_COALESCE)


def set_aside(docs: DataFrame, *own: str, replaced: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns other than `own` under names that clash with nothing, and what gives them their names back.

    Names are told apart without regard to case, as Spark does, and may hold dots. Columns named like
    one of `replaced` go.
    """
    kept = [c for c in docs.columns if c.lower() not in replaced]
    inner = {c: c.lower() if c.lower() in own else f"_other{k}" for k, c in enumerate(kept)}
    outer = {v: c for c, v in inner.items()}
    plain = docs.select(*[F.col(_quoted(c)).alias(n) for c, n in inner.items()])
    return plain, lambda out: out.select(*[F.col(_quoted(c)).alias(outer.get(c, c)) for c in out.columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Scratch:
    """Parquet tables in the shared folder for the length of one operator call."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n, self.named, self.tables = 0, {}, []
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """The rows of df, computed once. An earlier table of the same name goes when this one is there."""
        self.n += 1
        df.write.parquet(to := f"{self.path}/{self.n}")
        if name:
            if name in self.named:
                self._delete(self.named[name])
            self.named[name] = to
        return self.spark.read.schema(df.schema).parquet(to)

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """The rows of df, computed once and kept in buckets by a key: a join by it moves the other side alone."""
        self.n += 1
        name = f"scratch_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables.append(name)
        df.write.format("parquet").bucketBy(parts, key).sortBy(key).option("path", f"{self.path}/{self.n}").saveAsTable(name)
        return self.spark.table(name)

    def _delete(self, at: str) -> None:
        if self.spark.sparkContext._jsc is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        atexit.unregister(self.close)
        if self.spark.sparkContext._jsc is not None:
            for name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._delete(self.path)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * MIX_1
    x = x ^ (x >> U64(27))
    x = x * MIX_2
    return x ^ (x >> U64(31))


class WordIds(dict):
    """64-bit hash of each word; forgets all when it has grown to its bound."""

    BOUND = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-word shingle in order; of the whole sequence if it has fewer words; none without words."""
    if not len(ids):
        return ids
    k = min(k, len(ids))
    n = len(ids) - k + 1
    out = ids[:n] * PLACES[0]
    for j in range(1, k):
        out = out + ids[j : j + n] * PLACES[j]
    return mixed(out + U64(k))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.names.index(name)).to_pylist()


def parts_by_bytes(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20):
    """The batch in pieces of so many bytes of one column, about; a longer value is a piece of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(name))), 0).to_numpy(zero_copy_only=False)
    starts = np.unique(np.cumsum(size, dtype=np.int64) // most, return_index=True)[1]
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def groups(batches, keys: list[str]):
    """Tables of the rows with equal keys, from batches sorted by keys; a group may span batches."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        t = t.combine_chunks()
        starts = edges(t, keys)
        for a, b in zip(starts[:-1], starts[1:]):
            yield t.slice(a, b - a)
        rest = t.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def edges(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each run of equal keys starts."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def held_out(doc_id, folds: int, fold: int):
    """Whether crc32 of the id as text falls in the fold that is not learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def limit(share: float) -> int:
    """The hash (of 64 bits, signed) up to which so large a share of all hashes lies."""
    return min(int(share * (1 << 64)), (1 << 64) - 1) - (1 << 63)


def sampled(rows: DataFrame, share: float, seed: str, *keys: str) -> DataFrame:
    """About that share of the rows, by a hash of their keys; all of them from 1 on."""
    return rows.where(F.xxhash64(F.lit(seed), *keys) <= F.lit(limit(share)))
