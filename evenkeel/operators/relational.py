"""Joins with checks, matching by tolerance, set operations, reshaping, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def join_complete(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join; an error if a left row finds no partner."""
    missing = left.join(right, keys, "left_anti").limit(1).count()
    if missing:
        raise ValueError(f"rows without a partner on {keys}")
    return left.join(right, keys, "left")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join; an error if a key repeats on either side."""
    for name, side in (("left", left), ("right", right)):
        if duplicates(side, keys).limit(1).count():
            raise ValueError(f"repeated key {keys} on the {name} side")
    return left.join(right, keys, "left")


def match_within(left: DataFrame, right: DataFrame, block: list[str], key: str, pairs: list[tuple[str, str, float]]) -> DataFrame:
    """Inner join of rows in one block whose values differ by no more than each tolerance, where a left key has one match.

    The first pair is cut into cells of its tolerance, so that only neighbouring cells meet.
    """
    a, b, tolerance = pairs[0]
    cell = lambda c: F.floor(c / tolerance)
    near = left.withColumn("_cell", F.explode(F.array(*[cell(F.col(a)) + k for k in (-1, 0, 1)])))
    met = near.join(right.withColumn("_cell", cell(F.col(b))), [*block, "_cell"]).drop("_cell")
    for x, y, most in pairs:
        met = met.where(F.abs(F.col(x) - F.col(y)) <= most)
    return met.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old with other keys."""
    return old.join(new, keys, "left_anti").unionByName(new)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) for each column, in one pass over grouping sets."""
    sets = [[c] for c in columns]
    which = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in columns])
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("n"), which.alias("facet"), value.alias("value"))
    return out.where("value is not null").select("facet", "value", "n")


def exact_quantiles(df: DataFrame, columns: list[str], points: list[float], near: float = 1e-3) -> DataFrame:
    """(column, point, value): exact quantiles, linear between neighbours, of whole tables; no row for a column without values.

    Approximate quantiles on either side of each point say between which values it lies, and only
    values in between are put in order. So no task holds, or orders, more than some thousandths of a column.
    """
    spark = df.sparkSession
    cast = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    ends = [x for p in points for x in (max(p - near, 0.0), min(p + near, 1.0))]
    row = cast.agg(*[F.percentile_approx(c, ends, 10_000).alias(c) for c in columns]).first()
    ranges = [(c, p, row[c][2 * k], row[c][2 * k + 1]) for c in columns if row[c] for k, p in enumerate(points)]
    if not ranges:
        return spark.createDataFrame([], "column string, point double, value double")
    long = cast.unpivot([], columns, "column", "v").where("v is not null")
    near_values = long.join(F.broadcast(spark.createDataFrame(ranges, "column string, point double, low double, high double")), "column")
    inside = F.col("v").between(F.col("low"), F.col("high"))
    counts = near_values.groupBy("column", "point").agg(F.count("*").alias("n"), F.count_if(F.col("v") < F.col("low")).alias("below"))
    some = near_values.where(inside).groupBy("column", "point", "v").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("column", "point").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = some.join(counts, ["column", "point"]).withColumn("upto", F.col("below") + F.sum("k").over(upto))
    rank = (F.col("n") - 1) * F.col("point")
    # the value at a rank (from 0) is the least one with more rows up to it
    low, high = F.floor(rank), F.ceil(rank)
    found = placed.groupBy("column", "point").agg(
        F.min(F.when(F.col("upto") > low, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > high, F.col("v"))).alias("b"), F.first(rank - low).alias("share")
    )
    return found.select("column", "point", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("value"))


def describe(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """(column, n, mean, std, min, p5, p25, p50, p75, p95, max), exact, a row for each column."""
    points = [0.05, 0.25, 0.5, 0.75, 0.95]
    row = df.agg(*[x for c in columns for x in (F.count(c).alias(f"{c}|n"), F.avg(c).alias(f"{c}|mean"), F.stddev_samp(c).alias(f"{c}|std"), F.min(c).alias(f"{c}|min"), F.max(c).alias(f"{c}|max"))])
    r = lambda x: F.round(x.cast("double"), digits)
    each = [F.struct(F.lit(c).alias("column"), F.col(f"{c}|n").alias("n"), *[r(F.col(f"{c}|{k}")).alias(k) for k in ("mean", "std", "min", "max")]) for c in columns]
    plain = row.select(F.explode(F.array(*each)).alias("r")).select("r.*")
    found = exact_quantiles(df, columns, points).groupBy("column").agg(*[r(F.max(F.when(F.col("point") == p, F.col("value")))).alias(f"p{int(p * 100)}") for p in points])
    return plain.join(found, "column", "left").select("column", "n", "mean", "std", "min", *[f"p{int(p * 100)}" for p in points], "max")


def average_rank(column: str, keys: list[str]) -> Column:
    """Rank with ties at their mean."""
    ties = F.count("*").over(Window.partitionBy(*keys, column))
    return F.rank().over(Window.partitionBy(*keys).orderBy(column)) + (ties - 1) / 2.0


def rank_correlation(df: DataFrame, keys: list[str], a: str, b: str, least: int = 5) -> DataFrame:
    """(keys, n, rho): Spearman's; null with fewer than `least` rows or a constant side."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = rows.withColumn("_a", average_rank(a, keys)).withColumn("_b", average_rank(b, keys))
    n, sa, sb, sab, saa, sbb = F.count("*"), F.sum("_a"), F.sum("_b"), F.sum(F.col("_a") * F.col("_b")), F.sum(F.col("_a") * F.col("_a")), F.sum(F.col("_b") * F.col("_b"))
    top, bottom = n * sab - sa * sb, F.sqrt(n * saa - sa * sa) * F.sqrt(n * sbb - sb * sb)
    return rows.groupBy(*keys).agg(n.alias("n"), F.when((n >= least) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(top, bottom)).alias("rho"))


def paired_delta(df: DataFrame, keys: list[str], arm: str, base: str, metrics: list[str]) -> DataFrame:
    """(keys, arm, metric, base, other, delta): each other arm against the base arm, in one pass without a self-join."""
    long = df.unpivot([*keys, arm], metrics, "metric", "value")
    every = Window.partitionBy(*keys, "metric")
    out = long.withColumn("base", F.max(F.when(F.col(arm) == base, F.col("value"))).over(every))
    return out.where((F.col(arm) != base) & F.col("base").isNotNull()).select(*keys, arm, "metric", "base", F.col("value").alias("other"), (F.col("value") - F.col("base")).alias("delta"))


def search(df: DataFrame, pattern: str | None = None, on: str | None = None, limit: int = 300, **equal) -> tuple[DataFrame, DataFrame]:
    """(page, total): rows with the given values and a regular expression in `on`; filters that are None don't apply."""
    from evenkeel.functions.scalars import matches

    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if pattern and on:
        df = df.where(matches(F.col(on), pattern))
    return df.limit(limit), df.agg(F.count("*").alias("total"))


def all_null_columns(df: DataFrame, columns: list[str]) -> list[str]:
    row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if not row[c]]


def columns_like(df: DataFrame, prefix: str, kinds: tuple[str, ...], deny: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if f.name.startswith(prefix) and f.dataType.simpleString() in kinds and f.name not in deny]


def present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, each once, in the order wanted."""
    return df.select(*[c for c in dict.fromkeys(wanted) if c in df.columns])


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly the columns of a training table; those that are missing hold 0."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])
