"""Time-series operators on integer ticks: windows, alignment, runs, edges, smoothing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from math import isfinite

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the hat matrices of a quadratic through 7 and 5 equally spaced points, times 42 and 35 (fixed values).
SMOOTH_7 = [
    [32, 15, 3, -4, -6, -3, 5],
    [15, 12, 9, 6, 3, 0, -3],
    [3, 9, 12, 12, 9, 3, -6],
    [-4, 6, 12, 14, 12, 6, -4],
    [-6, 3, 9, 12, 12, 9, 3],
    [-3, 0, 3, 6, 9, 12, 15],
    [5, -3, -6, -4, 3, 15, 32],
]
SMOOTH_5 = [
    [31, 9, -3, -5, 3],
    [9, 13, 12, 6, -5],
    [-3, 12, 17, 12, -3],
    [-5, 6, 12, 13, 9],
    [3, -5, -3, 9, 31],
]


def decision_times(window: float, stride: float, least_lead: float = 0.0, most_lead: float | None = None, start: float = -10.0) -> list[float]:
    """Times at which windows end, from the farthest lead to the nearest, `stride` apart; a window fits after `start`.

    A time is never after 0, the moment that is foretold; its lead is less its sign. An error where
    no window fits or a bound makes no sense.
    """
    most_lead = -start - window if most_lead is None else most_lead
    if not (0 < window < -start and stride > 0 and 0 <= least_lead <= most_lead):
        raise ValueError(f"window {window}, stride {stride}, leads {least_lead} to {most_lead} don't fit {-start} s")
    first, last = max(start + window, -most_lead), -least_lead
    if first > last + 1e-9:
        raise ValueError("no window fits between the leads")
    return [round(first + stride * k, 6) + 0.0 for k in range(int((last - first) / stride + 1e-9) + 1)]


def build_windows(df: DataFrame, time: str, times: list[float], window: float) -> DataFrame:
    """A row for each decision time whose closed window [s - window, s] holds the row, with decision_t_s, lead_s and window_s.

    The times are few and the same for all keys, so membership is worked out row by row.
    """
    inside = F.filter(F.array(*map(F.lit, times)), lambda s: F.col(time).between(s - window - 1e-9, s + 1e-9))
    out = df.withColumn("decision_t_s", F.explode(inside))
    return out.withColumn("lead_s", -F.col("decision_t_s") + F.lit(0.0)).withColumn("window_s", F.lit(float(window)))


def sliding(df: DataFrame, tick: str, width: int, stride: int, first: int, last: int) -> DataFrame:
    """A row for each window that holds the row: window j is the closed range [j * stride - width, j * stride].

    Membership is worked out from the tick, so windows cost one shuffle on (key, j) and no range join.
    """
    u = F.col(tick)
    low = F.greatest(F.expr(f"({tick} + {stride - 1}) div {stride}"), F.lit(first))
    high = F.least(F.expr(f"({tick} + {width}) div {stride}"), F.lit(last))
    out = df.withColumn("_low", low).withColumn("_high", high).where((F.col("_low") <= F.col("_high")) & u.isNotNull())
    return out.withColumn("j", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")


def scaffold(keys: DataFrame, first: int, last: int) -> DataFrame:
    """Every window of every key, so that windows without rows are there too."""
    return keys.withColumn("j", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))


def grid(keys: DataFrame, n: int, step: int) -> DataFrame:
    """n regular ticks for every key."""
    return keys.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("g", F.col("i") * step)


def _with_grid(df: DataFrame, points: DataFrame, key: str, tick: str, value: Column, tie: str) -> DataFrame:
    seen = df.where(value.isNotNull()).select(key, F.col(tick).alias("_t"), value.alias("_v"), F.col(tie).alias("_tie"), F.lit(None).cast("long").alias("i"), F.lit(0).alias("_on"))
    asked = points.select(key, F.col("g").alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(None).cast("long").alias("_tie"), "i", F.lit(1).alias("_on"))
    return seen.unionByName(asked)


def _around(df: DataFrame, points: DataFrame, key: str, tick: str, value: Column, tie: str, width: int) -> DataFrame:
    """Grid ticks with _a and _b, (tick, value) of the last value up to them and of the first from them on.

    Time is cut into slices of `width` ticks. Each slice's first and last value, found before anything is
    gathered, are carried over the slices of a key; then ticks look in their own slice and, where it has
    nothing, take what was carried. So a key with very many rows is spread over its slices.
    """
    at = F.when(F.col("_on") == 0, F.struct("_t", "_v"))
    place = F.when(F.col("_on") == 0, F.struct("_t", "_tie"))
    rows = _with_grid(df, points, key, tick, value, tie).withColumn("_at", at).withColumn("_slice", F.floor(F.col("_t") / F.lit(width)).cast("long"))
    ends = rows.groupBy(key, "_slice").agg(F.min_by("_at", place).alias("_first"), F.max_by("_at", place).alias("_last"))
    # what follows is looked up backwards: Spark works out a frame that ends with the last row anew for every row
    along, on = Window.partitionBy(key).orderBy("_slice"), Window.partitionBy(key).orderBy(F.desc("_slice"))
    carried = ends.select(
        F.col(key).alias("_k"), F.col("_slice").alias("_s"),
        F.last("_last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.last("_first", True).over(on.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    inside = Window.partitionBy(key, "_slice")
    back = inside.orderBy("_t", "_on", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    ahead = inside.orderBy(F.desc("_t"), "_on", F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_a", F.last("_at", True).over(back)).withColumn("_b", F.last("_at", True).over(ahead)).where("_on = 1")
    rows = rows.join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s")), "left")
    return rows.withColumn("_a", F.coalesce("_a", "_before")).withColumn("_b", F.coalesce("_b", "_after"))


def as_of(df: DataFrame, points: DataFrame, key: str, tick: str, value: Column, tie: str, backfill: bool = False, width: int | None = None) -> DataFrame:
    """(key, i, g, value): the last value at or before each grid tick; `backfill` gives earlier ticks the first value.

    With a `width` (in ticks) a key's rows are worked on by slices of that width and not all in one task.
    """
    if width:
        found = F.coalesce("_a", "_b") if backfill else F.col("_a")
        return _around(df, points, key, tick, value, tie, width).select(key, "i", F.col("_t").alias("g"), found["_v"].alias("value"))
    before = Window.partitionBy(key).orderBy("_t", "_on", "_tie")
    every = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = F.last("_v", True).over(before.rowsBetween(Window.unboundedPreceding, 0))
    if backfill:
        out = F.coalesce(out, F.first("_v", True).over(every))
    return _with_grid(df, points, key, tick, value, tie).withColumn("value", out).where("_on = 1").select(key, "i", F.col("_t").alias("g"), "value")


def interpolate(df: DataFrame, points: DataFrame, key: str, tick: str, value: Column, tie: str, clamp: bool = False, width: int | None = None) -> DataFrame:
    """(key, i, g, value): linear between the values around each grid tick; outside null, or the end value. `width` as in as_of()."""
    if width:
        rows = _around(df, points, key, tick, value, tie, width)
    else:
        rows = _with_grid(df, points, key, tick, value, tie).withColumn("_at", F.when(F.col("_on") == 0, F.struct("_t", "_v")))
        back = Window.partitionBy(key).orderBy("_t", "_on", "_tie").rowsBetween(Window.unboundedPreceding, 0)
        ahead = Window.partitionBy(key).orderBy("_t", F.desc("_on"), "_tie").rowsBetween(0, Window.unboundedFollowing)
        rows = rows.withColumn("_a", F.last("_at", True).over(back)).withColumn("_b", F.first("_at", True).over(ahead)).where("_on = 1")
    a, b = F.col("_a"), F.col("_b")
    share = (F.col("_t") - a["_t"]).cast("double") / F.nullif(b["_t"] - a["_t"], F.lit(0)).cast("double")
    line = F.when(a["_t"] == b["_t"], a["_v"]).otherwise(a["_v"] + (b["_v"] - a["_v"]) * share)
    return rows.select(key, "i", F.col("_t").alias("g"), (F.coalesce(line, a["_v"], b["_v"]) if clamp else line).alias("value"))


def nearest(df: DataFrame, tick: str, at: Column, value: Column) -> Column:
    """Aggregate: the value whose tick is nearest, the earlier of two."""
    return F.min(F.struct(F.abs(F.col(tick) - at).alias("d"), F.col(tick).alias("t"), value.alias("v")))["v"]


def native_rate(df: DataFrame, key: str, tick: str, tie: str) -> DataFrame:
    """(key, rate): one over the median step, for keys with more than two rows and a positive median."""
    step = F.col(tick) - F.lag(tick).over(Window.partitionBy(key).orderBy(tick, tie))
    out = df.withColumn("_d", step).groupBy(key).agg(F.percentile("_d", F.lit(0.5)).alias("_m"), F.count("*").alias("_n"))
    return out.select(key, F.when((F.col("_n") > 2) & (F.col("_m") > 0), F.lit(1e6) / F.col("_m")).alias("rate_hz"))


def falling(flag: Column, order) -> Column:
    """Whether the flag was set in the row before and isn't any more."""
    return F.coalesce(F.lag(flag.cast("int")).over(order), F.lit(0)).cast("boolean") & ~flag


def rising(flag: Column, order) -> Column:
    return flag & ~F.coalesce(F.lag(flag.cast("int")).over(order), F.lit(0)).cast("boolean")


def longest_run(df: DataFrame, keys: list[str], tick: str, tie: str, flag: Column) -> DataFrame:
    """(keys, longest): greatest span of ticks of a run of rows with the flag; 0 for single rows and without any."""
    order = Window.partitionBy(*keys).orderBy(tick, tie)
    rows = df.withColumn("_f", F.coalesce(flag, F.lit(False)).cast("int")).withColumn("_n", F.row_number().over(order))
    rows = rows.withColumn("_island", F.col("_n") - F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "_island").agg((F.max(F.when(F.col("_f") == 1, F.col(tick))) - F.min(F.when(F.col("_f") == 1, F.col(tick)))).alias("_span"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max("_span"), F.lit(0)).alias("longest"))


def rolling_median(value: Column, order, rows: int) -> Column:
    return F.percentile(value, F.lit(0.5)).over(order.rowsBetween(-rows, 0))


def onsets(df: DataFrame, key: str, tick: str, tie: str, value: str, rows: int, factor: float, floor: float) -> DataFrame:
    """df with `above` (value over factor * trailing median and over floor) and `onset` (above, but not in the row before)."""
    order = Window.partitionBy(key).orderBy(tick, tie)
    out = df.withColumn("_median", rolling_median(F.col(value), order, rows))
    out = out.withColumn("above", F.col(value) > F.greatest(F.col("_median") * factor, F.lit(floor)))
    return out.withColumn("onset", rising(F.col("above"), order)).drop("_median")


def sustained_switch(df: DataFrame, key: str, tick: str, tie: str, flag: Column, ahead: int, share: float) -> DataFrame:
    """(key, switch): tick of the first row that ends the flag with less than `share` of it in the rows ahead."""
    order = Window.partitionBy(key).orderBy(tick, tie)
    rows = df.withColumn("_f", flag.cast("int"))
    rows = rows.withColumn("_off", (F.lag("_f").over(order) == 1) & (F.col("_f") == 0)).withColumn("_next", F.avg("_f").over(order.rowsBetween(1, ahead)))
    return rows.groupBy(key).agg(F.min(F.when(F.col("_off") & (F.col("_next") < share), F.col(tick))).alias("switch"))


def every_kth(df: DataFrame, order, k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(order)).where((F.col("_n") - 1) % k == 0).drop("_n")


def smoothed(values: Column) -> Column:
    """Quadratic smoothing of an array over 7 neighbours (5, with 5 or 6 values; fewer stay as they are)."""
    n = F.size(values)

    def by(rows: list[list[int]], total: int) -> Column:
        width = len(rows)
        table = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])

        def at(i: Column) -> Column:
            start = F.greatest(F.lit(0), F.least(i - width // 2, n - width))
            row = F.get(table, i - start)
            return sum((F.get(row, F.lit(k)) * F.get(values, start + k) for k in range(1, width)), F.get(row, F.lit(0)) * F.get(values, start)) / total

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return F.when(n >= 7, by(SMOOTH_7, 42)).when(n >= 5, by(SMOOTH_5, 35)).otherwise(values)


def step_rates(values: Column, step: float) -> Column:
    """|difference| / step of neighbours in an array; null with fewer than 5 values."""
    return F.when(
        F.size(values) >= 5,
        F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda b, a: F.abs(b - a) / step),
    )


def episodes(df: DataFrame, key: str, tick: str, tie: str, flag: Column, gap: int, least_on: int, least_off: int) -> DataFrame:
    """(key, start, end, on_span, off_span, switch): stretches with the flag, those less than `gap` ticks apart as one.

    A row's flag (null: not set) holds until the next row. `end` is the first row without the flag, or the
    key's last row; off_span goes on to the next stretch or the last row. `switch` tells that the flag was on
    for `least_on` ticks and then off for `least_off`. Only rows where the flag changes are put together.
    """
    order = Window.partitionBy(key).orderBy(tick, tie)
    on = F.coalesce(flag, F.lit(False))
    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{tick}`").alias("tick"), on.alias("on"), F.coalesce(F.lag(on).over(order), F.lit(False)).alias("was"),
        F.row_number().over(order).alias("n"), F.max(tick).over(Window.partitionBy(key)).alias("last"),
    )
    by = Window.partitionBy("key").orderBy("n")
    edges = rows.where(F.col("on") != F.col("was")).withColumn("before", F.lag("tick").over(by))
    fresh = F.col("on") & (F.col("before").isNull() | (F.col("tick") - F.col("before") >= gap))
    edges = edges.withColumn("nth", F.sum(fresh.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.max_by(F.struct("tick", (~F.col("on")).alias("closed")), "n").alias("end")
    out = edges.groupBy("key", "nth").agg(F.min("tick").alias("start"), end, F.max("last").alias("last"))
    # the last edge of a stretch is its end, but where the flag is on to the last row
    closed = F.when(F.col("end.closed"), F.col("end.tick")).otherwise(F.col("last"))
    out = out.select("key", "start", closed.alias("end"), "last", "nth", F.col("end.closed").alias("closed"))
    following = F.coalesce(F.lead("start").over(Window.partitionBy("key").orderBy("nth")), F.col("last"))
    on, off = F.col("end") - F.col("start"), following - F.col("end")
    return out.select(F.col("key").alias(key), "start", "end", on.alias("on_span"), off.alias("off_span"), (F.col("closed") & (on >= least_on) & (off >= least_off)).alias("switch"))


def rolling_medians_by_rate(df: DataFrame, key: str, tick: str, tie: str, value: str, span: float) -> DataFrame:
    """df with `median` over the row and as many before it as `span` ticks hold at the key's own pace: max(1, round(span / median step)).

    Each key's rows pass once, in order of tick and tie; a list kept in order of the last rows' values gives
    the median, so a row costs a search in it and not a sort. Nulls and non-finite values keep their places but don't
    count. A key whose median step isn't above 0 has one row before. A column named `median` is replaced.
    """
    step = F.col(f"`{tick}`") - F.lag(f"`{tick}`").over(Window.partitionBy(f"`{key}`").orderBy(f"`{tick}`", f"`{tie}`"))
    paces = df.select(F.col(f"`{key}`").alias("key"), step.alias("step")).groupBy("key").agg(F.percentile("step", F.lit(0.5)).alias("step"))
    ahead = F.when(F.col("step") > 0, F.greatest(F.lit(1), F.rint(F.lit(float(span)) / F.col("step")).cast("int"))).otherwise(1)
    names = [c for c in df.columns if c.lower() != "median"]
    inner = [f"c{k}" for k in range(len(names))]
    places = {c.lower(): n for c, n in zip(names, inner)}
    k, t, e, v = (places[c.lower()] for c in (key, tick, tie, value))
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(names, inner)])
    rows = rows.join(paces.select(F.col("key"), ahead.alias("look")), F.col(k).eqNullSafe(F.col("key"))).drop("key")
    rows = rows.withColumn("number", F.col(v).cast("double")).repartition(k).sortWithinPartitions(k, t, e)

    def run(batches):
        recent, ordered, last = deque(), [], object()
        for batch in batches:
            keys, looks, values = (batch.column(batch.schema.names.index(c)).to_pylist() for c in (k, "look", "number"))
            out = []
            for key_now, look, x in zip(keys, looks, values):
                if key_now != last:
                    recent, ordered, last = deque(), [], key_now
                x = x if x is not None and isfinite(x) else None
                recent.append(x)
                if x is not None:
                    insort(ordered, x)
                if len(recent) > look + 1 and (gone := recent.popleft()) is not None:
                    del ordered[bisect_left(ordered, gone)]
                n = len(ordered)
                out.append(None if not n else (ordered[(n - 1) // 2] + ordered[n // 2]) / 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(inner))), pa.array(out, pa.float64())], names=[*inner, "median"])

    schema = rows.select(*inner, F.lit(None).cast("double").alias("median")).schema
    return rows.mapInArrow(run, schema).toDF(*names, "median")
