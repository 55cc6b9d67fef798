"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.scalars import finite
from evenkeel.operators.relational import upsert


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def replace_parquet(df: DataFrame, path: str) -> None:
    """Overwrites a table, also one that df reads.

    The new files are complete before the old ones move, and the old ones stay beside them until the
    new ones are in place; where that fails they are moved back.
    """
    spark = df.sparkSession
    new, old = (f"{path.rstrip('/')}.{uuid.uuid4().hex}" for _ in range(2))
    df.write.parquet(new)
    fs, at = _fs(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path
    there = fs.exists(at)
    if there and not fs.rename(at, place(old)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(place(new), at):
        if there:
            fs.rename(place(old), at)
        raise OSError(f"cannot move {new} to {path}")
    fs.delete(place(old), True)


def csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; `single` is for small reports, whose one file a person reads."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def _safe(c, kind: T.DataType):
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _safe(v, kind.valueType))
    if isinstance(kind, T.StructType) and len(kind):
        return F.when(c.isNotNull(), F.struct(*[_safe(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """Non-finite numbers as null, at any depth."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def json_report(df: DataFrame, path: str) -> None:
    """A small report of one row as a JSON file for people: indented, and what JSON has no kind for as text."""
    import json

    row = json_safe(df).limit(2).collect()
    if len(row) != 1:
        raise ValueError("a report has one row")
    fs, at = _fs(df.sparkSession, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(row[0].asDict(recursive=True), indent=2, default=str, ensure_ascii=False).encode()))
    finally:
        out.close()


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON document a row, nulls kept."""
    return json_safe(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def upsert_parquet(new: DataFrame, path: str, keys: list[str]) -> None:
    """Rows of new take the place of those with the same key."""
    spark = new.sparkSession
    replace_parquet(upsert(spark.read.parquet(path), new, keys) if exists(spark, path) else new, path)


def resume_parquet(new: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys aren't there yet; nothing that is there is written again."""
    spark = new.sparkSession
    todo = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if exists(spark, path) else new
    todo.write.mode("append").parquet(path)
