"""A recording as one JSON document: every series on a common grid, what is derived from them, rates, warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions import scalars as S

from . import timeline

#: Grid of 20 Hz over 20 s, the event 10 s after the first row, least rows of the main topic, cap of time to collision (fixed values).
HZ, SECONDS, EVENT, LEAST_ROWS, TTC_CAP = 20, 20, 10, 5, 100.0
MAIN = "carState"


def long_series(topics: dict[str, DataFrame], keys: list[str], flags: dict[str, list[str]]) -> DataFrame:
    """(keys, topic, column, flag, u, v): the finite values of all topics, u in microseconds."""
    parts = []
    for name, df in topics.items():
        values = [c for c in df.columns if c not in (*keys, "time_s")]
        rows = df.unpivot([*keys, "time_s"], [F.col(c).cast("double").alias(c) for c in values], "column", "v")
        flag = F.col("column").isin(*flags.get(name, [])) if flags.get(name) else F.lit(False)
        parts.append(rows.select(*keys, F.lit(name).alias("topic"), "column", flag.alias("flag"), F.round(F.col("time_s") * 1_000_000).cast("long").alias("u"), S.finite(F.col("v")).alias("v")))
    return reduce(DataFrame.unionByName, parts).where("v is not null")


def _derived(m: Column) -> dict[str, Column]:
    """From a map of a grid point's values: margins to a leader, null without one, and whether the system is engaged."""
    get = lambda c: F.try_element_at(m, F.lit(c))
    lead = F.coalesce(get("leadOne_status"), F.lit(0.0)) > 0.5
    closing = S.closing_speed(get("leadOne_vRel"))
    ttc = S.clipped(S.time_to_collision(get("leadOne_dRel"), closing), 0.0, TTC_CAP)
    thw = S.time_headway(get("leadOne_dRel"), get("vEgo"))
    out = {"ttc": F.round(F.when(lead, ttc), 3), "thw": F.round(F.when(lead, thw), 3), "closing_mps": F.round(F.when(lead, closing), 3)}
    return out | {"adas_engaged": S.engaged(get("enabled"), get("cruiseState_enabled")).cast("double")}


def telemetry(topics: dict[str, DataFrame], index: DataFrame, keys: list[str], flags: dict[str, list[str]]) -> DataFrame:
    """(keys, document) of each recording whose main topic has LEAST_ROWS rows or more.

    topics: by name, rows with the keys and time_s. Numbers are linear between their neighbours and
    null outside of them, with two values at least; flags hold the last value, before the first one that. `t` is
    relative to the event. index gives the side-car fields log_kind and log_hz; a recording that is not in it has none.
    """
    long = long_series(topics, keys, flags)
    main = topics[MAIN].where("time_s is not null").groupBy(*keys).agg(F.min("time_s").alias("t0"), F.count("*").alias("rows")).where(F.col("rows") >= LEAST_ROWS).drop("rows")
    clip = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    long = long.join(main.select(*keys), keys, "left_semi").withColumn("clip", clip).withColumn("series", F.concat_ws("\t", "clip", "column")).withColumn("tie", F.lit(0).cast("long"))
    starts = main.select(clip.alias("clip"), F.round(F.col("t0") * 1_000_000).cast("long").alias("start"))
    found = long.groupBy("series", "clip", "column", "flag").agg(F.count("*").alias("n")).where("flag or n >= 2")
    points = found.join(starts, "clip").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HZ * SECONDS).cast("long")))).withColumn("g", F.col("start") + F.col("i") * (1_000_000 // HZ))
    numbers = timeline.interpolate(long.where("not flag"), points.where("not flag").select("series", "i", "g"), "series", "u", F.col("v"), "tie")
    held = timeline.as_of(long.where("flag"), points.where("flag").select("series", "i", "g"), "series", "u", F.col("v"), "tie", backfill=True)
    parts = F.split("series", "\t")
    values = numbers.select("series", "i", F.round("value", 4).alias("v")).unionByName(held.select("series", "i", F.round("value", 3).alias("v")))
    values = values.select(F.get(parts, F.lit(0)).alias("clip"), F.get(parts, F.lit(1)).alias("column"), "i", "v")
    at = values.groupBy("clip", "i").agg(F.map_from_entries(F.collect_list(F.struct("column", "v"))).alias("m"))
    more = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("column"), x.alias("v")) for c, x in _derived(F.col("m")).items()]))
    # a grid has as many points in every recording, so what is gathered of one is bounded
    every = at.select("clip", "i", F.explode(F.map_concat("m", more)).alias("column", "v"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    arrays = every.groupBy("clip", "column").agg(F.transform(ordered, lambda x: x["v"]).alias("a"), F.avg("v").alias("mean"))
    parsed = arrays.groupBy("clip").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "a")))).alias("series"), F.max(F.size("a")).alias("n_samples"),
        (F.max(F.when(F.col("column") == "adas_engaged", F.col("mean"))) * 100).alias("adas_engaged_pct"),
    )
    main_rows = topics_rates(topics, keys).withColumn("clip", clip).groupBy("clip").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "hz")))).alias("native_hz"))
    meta = index.select(clip.alias("clip"), "log_kind", "log_hz")
    out = main.withColumn("clip", clip).join(parsed, "clip").join(main_rows, "clip", "left").join(meta, "clip", "left")
    step = F.transform(F.sequence(F.lit(0), F.lit(HZ * SECONDS)), lambda i: F.round(i / HZ - EVENT, 3))
    warnings = S.warnings(
        (~F.map_contains_key("series", "leadOne_dRel"), F.lit("no leader distance")),
        (F.coalesce(F.try_element_at("native_hz", F.lit(MAIN)) < HZ, F.lit(False)), F.format_string("%s at %.1f Hz, under the grid's rate", F.lit(MAIN), F.try_element_at("native_hz", F.lit(MAIN)))),
    )
    document = F.struct(
        F.col("t0").alias("t0_csv"), (F.col("t0") + EVENT).alias("event_t"), F.lit(EVENT * HZ).alias("event_index"), F.col("t0").alias("grid_start_s"), (F.col("t0") + SECONDS).alias("grid_end_s"),
        "n_samples", F.lit(float(HZ)).alias("resample_hz"), step.alias("t"), "series", "native_hz", "log_kind", "log_hz", "adas_engaged_pct", warnings.alias("warnings"),
    )
    return out.select(*keys, F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def topics_rates(topics: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, topic, hz): one over the median step of each topic of each recording with more than two rows."""
    parts = []
    for name, df in topics.items():
        rows = df.where("time_s is not null").select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("clip"), *keys, F.round(F.col("time_s") * 1_000_000).cast("long").alias("u"), F.lit(0).alias("tie"))
        rates = timeline.native_rate(rows, "clip", "u", "tie").join(rows.select("clip", *keys).distinct(), "clip")
        parts.append(rates.select(*keys, F.lit(name).alias("topic"), F.col("rate_hz").alias("hz")))
    return reduce(DataFrame.unionByName, parts).where("hz is not null")
