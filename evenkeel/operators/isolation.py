"""Work by key that goes on where some keys fail."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a reason that are kept.
REASON = 160


def by_key(df: DataFrame, keys: list[str], block: Callable[[pa.Table], dict | list[dict]], output: str) -> DataFrame:
    """(keys, the output columns, error): what block(rows of a key) gives, a row or several, or why it failed.

    A key whose block raises has one row with `error` (the kind and the message) and nulls; so does one whose values
    don't fit the output columns. The others go on and have a null error; a block may give no rows. The rows of a key are
    in one task and in no certain order. Column names of df may hold dots; a key or output named `error` is an error.
    """
    fields = T.StructType.fromDDL(output).fields
    if "error" in {c.lower() for c in (*keys, *(f.name for f in fields))}:
        raise ValueError("`error` is the name of the reason")
    names = list(df.columns)
    plain = df.toDF(*[f"c{k}" for k in range(len(names))])
    at = [next(k for k, c in enumerate(names) if c.lower() == key.lower()) for key in keys]
    schema = T.StructType([*(T.StructField(key, df.schema.fields[k].dataType) for key, k in zip(keys, at)), *(T.StructField(f.name, f.dataType) for f in fields), T.StructField("error", T.StringType())])
    inner = T.StructType([T.StructField(f"o{k}", f.dataType) for k, f in enumerate(schema.fields)])
    kinds = _arrow(inner)

    def run(rows: pa.Table) -> pa.Table:
        key = [rows.column(k)[0].as_py() for k in at]
        try:
            made = block(rows.rename_columns(names))
            made = [made] if isinstance(made, dict) else list(made)
            values = [[*key, *(m.get(f.name) for f in fields), None] for m in made]
            return _table(values, kinds)
        except Exception as e:  # noqa: BLE001 - one key must not end the others
            return _table([[*key, *[None] * len(fields), f"{type(e).__name__}: {e}"[:REASON]]], kinds)

    out = plain.groupBy(*[f"c{k}" for k in at]).applyInArrow(run, inner)
    return out.toDF(*schema.fieldNames())


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _table(rows: list[list], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def failures(df: DataFrame, first: int = 10) -> tuple[int, int, list[tuple]]:
    """(keys that went well, keys that failed, the first failures by key) of what by_key() gave."""
    keys = df.columns[: df.columns.index("error")]
    marked = df.select(F.col("error").isNotNull().alias("failed"), *[F.col(f"`{c}`") for c in df.columns])
    counts = {r.failed: r.n for r in marked.groupBy("failed").agg(F.count("*").alias("n")).collect()}
    some = marked.where("failed").orderBy(*[F.col(f"`{c}`") for c in keys]).limit(first).collect()
    return counts.get(False, 0), counts.get(True, 0), [tuple(r)[1:] for r in some]
