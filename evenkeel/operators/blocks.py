"""Feature blocks: all aggregates of a window in one grouping by (key, window); what doesn't depend on the window comes before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions import reducers as R
from evenkeel.functions import scalars as S

from . import timeline

#: Caps of time to collision (s) and required deceleration (m/s2), and thresholds of exposure (fixed values).
TTC_CAP, DRAC_CAP = 100.0, 50.0
TTC_LIMITS, THW_LIMITS, DRAC_LIMITS = (1.5, 2.0, 3.0), (0.8, 1.0, 1.5), (3.0, 4.0)


def margins(df: DataFrame) -> DataFrame:
    """Adds gap, headway, time to collision and required deceleration of the row, null without a leader."""
    lead = F.coalesce(F.col("lead_status"), F.lit(0.0)) > 0.5
    gap = F.when(lead, F.col("d_rel"))
    closing = S.closing_speed(F.when(lead, F.col("v_rel")))
    out = df.withColumn("lead", lead).withColumn("gap", gap).withColumn("thw", S.time_headway(gap, F.col("speed")))
    return out.withColumn("ttc", S.time_to_collision(gap, closing)).withColumn("drac", S.required_deceleration(gap, closing))


def with_edges(df: DataFrame, key: str, lead: Column, time: Column) -> DataFrame:
    """Adds lead_before and t_before (of the row before, in order of time), and lead_since (start of the row's run of leads).

    Worked out once a row, not once for each window that holds it: a window is a stretch of these rows.
    """
    order = Window.partitionBy(key).orderBy(time)
    df = df.withColumn("_lead", F.coalesce(lead, F.lit(False)))
    df = df.withColumn("lead_before", F.coalesce(F.lag("_lead").over(order), F.lit(False))).withColumn("t_before", F.lag(time).over(order))
    begins = F.when(F.col("_lead") & ~F.col("lead_before"), time)
    since = F.last(begins, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("lead_since", F.when(F.col("_lead"), since)).drop("_lead")


def _drops(lead: Column, begin: Column) -> Column:
    """Aggregate: how often a window that starts at `begin` has a lead in a row and none in the next."""
    return F.count_if(F.col("lead_before") & (F.col("t_before") >= begin) & ~F.coalesce(lead, F.lit(False)))


def _longest_lead(begin: Column) -> Column:
    """Aggregate: the greatest span of a run of leads in a window that starts at `begin`; one that began before is cut there."""
    inside = F.max(F.when(F.col("lead_since") >= begin, F.col("t") - F.col("lead_since")))
    across = F.max(F.when(F.col("lead_since") < begin, F.col("t"))) - F.min("t")
    return F.coalesce(F.greatest(inside, across), F.lit(0.0))


def _sorted(rows: str, column: str) -> Column:
    """The values of one field of an array of structs, in order, without nulls."""
    return F.array_sort(F.filter(F.transform(rows, lambda x: x[column]), lambda x: x.isNotNull()))


def _with_rates(df: DataFrame, rows: str, rates: dict[str, str], step: float) -> DataFrame:
    """For each name and field: an array `_<name>` of structs (v, t), the rates of change of the smoothed field, each
    halfway between its two rows, and of `_<name>_v`, the rates in order; null for fewer than 5 values.

    Each step is a column of its own, so that nothing is worked out again for each element that looks at it.
    """
    tail = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    head = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    field = lambda c: lambda x: x[c]
    there = lambda c: lambda x: x[c].isNotNull()
    df = df.withColumns({f"_{n}_at": F.filter(F.col(rows), there(c)) for n, c in rates.items()})
    df = df.withColumns({f"_{n}_raw": F.transform(f"_{n}_at", field(c)) for n, c in rates.items()})
    df = df.withColumns({f"_{n}_smooth": timeline.smoothed(F.col(f"_{n}_raw")) for n in rates})
    df = df.withColumns({f"_{n}_rate": timeline.step_rates(F.col(f"_{n}_smooth"), step) for n in rates})
    df = df.withColumns({f"_{n}_mid": F.when(F.col(f"_{n}_rate").isNotNull(), F.zip_with(tail(f"_{n}_at"), head(f"_{n}_at"), lambda b, a: (a["t"] + b["t"]) / 2)) for n in rates})
    df = df.withColumns({f"_{n}": F.zip_with(f"_{n}_rate", f"_{n}_mid", lambda v, t: F.struct(v.alias("v"), t.alias("t"))) for n in rates})
    return df.withColumns({f"_{n}_v": F.array_sort(f"_{n}_rate") for n in rates})


def motion_block(df: DataFrame, keys: list[str], step: float, begin: Column) -> DataFrame:
    """Kinematics, margins and exposure of each window, in one grouping.

    df: keys, t, and the signals speed, accel, steer_angle, steer_torque, cruise, curvature,
    desired_curvature, lead_status, d_rel, v_rel, left_prob, right_prob, fcw, with the columns of
    margins() and with_edges(), which are best added before rows are copied into windows. `begin` is
    a window's first tick. Order and quantiles come from one array of a window's rows. Windows of
    fewer than two rows are left out.
    """
    t = F.col("t")
    df = df.withColumn("ttc_cap", S.clipped(F.col("ttc"), 0.0, TTC_CAP)).withColumn("drac_cap", F.when(F.col("drac").isNotNull(), F.least("drac", F.lit(DRAC_CAP))))
    held = ["accel", "steer_angle", "gap", "thw", "ttc_cap", "drac_cap"]
    plain = [
        *[R.last_value(F.col(c), t).alias(c) for c in ("speed", "accel", "steer_angle", "steer_torque", "cruise")],
        F.avg("speed").alias("speed_mean"), R.change(F.col("speed"), t).alias("speed_delta"),
        F.min("accel").alias("accel_min"), F.max("accel").alias("accel_max"), R.when_least(F.col("accel"), t).alias("time_of_peak_decel"),
        *[F.max(F.abs(c)).alias(f"{c}_max_abs") for c in ("steer_angle", "steer_torque", "curvature", "desired_curvature")],
        F.count_if("lead").alias("n_lead"), F.avg(F.col("lead").cast("double")).alias("lead_rate"), _drops(F.col("lead"), begin).alias("lead_drops"),
        F.min("gap").alias("gap_min"), F.min("thw").alias("thw_min"),
        F.min("ttc").alias("ttc_min_raw"), F.min("ttc_cap").alias("ttc_min"), R.when_least(F.col("ttc"), t).alias("time_of_min_ttc"),
        F.max("drac").alias("drac_max_raw"), F.max("drac_cap").alias("drac_max"), R.when_most(F.col("drac"), t).alias("time_of_max_drac"),
        *[R.time_under(F.col("ttc_cap"), x, step).alias(f"time_below_ttc_{x}".replace(".", "_")) for x in TTC_LIMITS],
        *[R.severity(F.col("ttc_cap"), x, step).alias(f"severity_ttc_{x}".replace(".", "_")) for x in TTC_LIMITS],
        *[R.time_under(F.col("thw"), x, step).alias(f"time_below_thw_{x}".replace(".", "_")) for x in THW_LIMITS],
        *[R.time_under(-F.col("drac_cap"), -x, step).alias(f"time_above_drac_{x}".replace(".", "_")) for x in DRAC_LIMITS],
        (F.count("left_prob") + F.count("right_prob") > 0).cast("int").alias("has_lane_probs"), F.avg("left_prob").alias("left_prob_mean"), F.avg("right_prob").alias("right_prob_mean"),
        R.ever(F.coalesce(F.col("fcw"), F.lit(0.0)) > 0.5).alias("fcw_present"), _longest_lead(begin).alias("lead_longest"),
    ]
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.struct(*plain).alias("_plain"), F.array_sort(F.collect_list(F.struct("t", *held))).alias("_rows")).where("n >= 2")
    asked = {"accel": (0.05, 0.5, 0.95), "gap": (0.05,), "thw": (0.05, 0.5, 0.95), "ttc_cap": (0.05, 0.5, 0.95), "drac_cap": (0.5, 0.95)}
    rates = {"jerk": ("accel", (0.5, 0.95)), "steer_rate": ("steer_angle", (0.95,))}
    out = _with_rates(out.withColumns({f"_{c}": _sorted("_rows", c) for c in asked}), "_rows", {name: c for name, (c, _) in rates.items()}, step)
    new = {f"{c.replace('_cap', '')}_p{int(p * 100)}": R.at_quantile(F.col(f"_{c}"), p) for c, ps in asked.items() for p in ps}
    for name, (_, ps) in rates.items():
        new[f"{name}_max"] = F.array_max(f"_{name}_v")
        new |= {f"{name}_p{int(p * 100)}": R.at_quantile(F.col(f"_{name}_v"), p) for p in ps}
        # the earliest of the greatest
        new[f"time_of_peak_{name}"] = F.array_min(F.transform(f"_{name}", lambda x: F.struct((-x["v"]).alias("v"), x["t"].alias("t"))))["t"]
    return out.select(*keys, "n", "_plain.*", *[x.alias(n) for n, x in new.items()])


#: Rows and columns of the grid of cells in which boxes are counted, and states of a light.
CELLS = [(r, c) for r in range(3) for c in range(3)]
LIGHTS = ("red", "amber", "green", "unknown")


def box_block(df: DataFrame, windows: DataFrame, keys: list[str], available: Column, begin: Column) -> DataFrame:
    """Geometry of the leading box and counts of each window, in one grouping; 0 in windows without rows, which are there too.

    df: keys, t (s), lead, area, cx, y2, conf, vehicles, corridor, person, bicycle, light, stop,
    brightness, motion, the lights by state (red, amber, green, unknown), n_<r><c> and a_<r><c> (boxes
    of a grid cell and their area), and the columns of with_edges(). `begin` is a window's first tick.
    """
    t, lead = F.col("t"), F.col("lead")
    on = lambda c: F.when(lead, F.col(c))
    aggregates = {
        "n_frames": F.count("*"), "lead_available": R.ever(lead), "lead_rate": R.rate(lead),
        "area_mean": F.avg(on("area")), "area_max": F.max(on("area")), "area_p90": R.quantile(on("area"), 0.9), "area_last": R.last_value(on("area"), t),
        "area_growth": R.slope(on("area"), t), "area_delta": R.change(on("area"), t),
        "cx_mean": F.avg(on("cx")), "cx_last": R.last_value(on("cx"), t), "cx_max_abs": F.max(F.abs(on("cx"))), "y2_mean": F.avg(on("y2")), "y2_max": F.max(on("y2")), "conf_mean": F.avg(on("conf")),
        "lead_drops": _drops(lead, begin),
        "vehicles_mean": F.avg("vehicles"), "vehicles_max": F.max("vehicles"), "vehicles_delta": R.change(F.col("vehicles"), t),
        "corridor_mean": F.avg("corridor"), "corridor_max": F.max("corridor"), "corridor_clear": (F.max("corridor") <= 0).cast("int"), "any_vehicle": (F.max("vehicles") > 0).cast("int"),
        **{f"{c}_max": F.max(c) for c in ("person", "bicycle", "light", "stop")},
        "any_vru": ((F.max("person") > 0) | (F.max("bicycle") > 0)).cast("int"), "any_light": (F.max("light") > 0).cast("int"),
        "brightness_mean": F.avg("brightness"), "motion_mean": F.avg("motion"),
        **{f"{x}_{r}{c}_mean": F.avg(f"{x}_{r}{c}") for r, c in CELLS for x in ("n", "a")},
        **{f"{x}_any": R.ever(F.col(x) > 0) for x in LIGHTS}, **{f"{x}_frac": R.rate(F.col(x) > 0) for x in LIGHTS[:3]},
        "lead_longest": _longest_lead(begin),
    }
    out = windows.join(df.groupBy(*keys).agg(*[x.alias(n) for n, x in aggregates.items()]), keys, "left")
    return out.select(*windows.columns, available.cast("int").alias("available"), *[F.coalesce(n, F.lit(0)).alias(n) for n in aggregates])


def flow_block(df: DataFrame, windows: DataFrame, keys: list[str], end: Column, available: Column, recent: float) -> DataFrame:
    """Residual motion of each window; 0 in windows without rows.

    df: keys, t, valid, residual, corridor_residual, sideways, lengthways, divergence, movers, mover_area,
    onset, corridor_onset, scale, rotation, last_onset (time of the last onset up to the row, over the key's
    whole history). `end` is the window's decision time.
    """
    v = F.col("valid") > 0.5
    on = lambda c: F.when(v, F.col(c))
    aggregates = {
        "n_samples": F.count("*"),
        "residual_mean": F.avg(on("residual")), "residual_max": F.max(on("residual")), "residual_p90": R.quantile(on("residual"), 0.9),
        "corridor_mean": F.avg(on("corridor_residual")), "corridor_max": F.max(on("corridor_residual")),
        "sideways_mean": F.avg(on("sideways")), "sideways_max_abs": F.max(F.abs(on("sideways"))), "lengthways_max_abs": F.max(F.abs(on("lengthways"))),
        "divergence_mean": F.avg(on("divergence")), "divergence_max": F.max(on("divergence")),
        "movers_mean": F.avg(F.when(v, F.col("movers")).otherwise(0.0)), "movers_max": F.max(F.when(v, F.col("movers")).otherwise(0.0)), "mover_area_max": F.max("mover_area"), "movers_any": R.ever(v & (F.col("movers") > 0)),
        "onsets": F.sum("onset"), "corridor_onsets": F.sum("corridor_onset"), "onset_recent": R.ever((F.col("onset") > 0) & (F.col("t") >= end - recent)),
        "since_onset": F.coalesce(F.max(end) - F.max("last_onset"), F.max(end) + 10),
        "scale_mean": F.avg(on("scale")), "rotation_std": F.stddev_pop(on("rotation")),
    }
    out = windows.join(df.groupBy(*keys).agg(*[x.alias(n) for n, x in aggregates.items()]), keys, "left")
    return out.select(*windows.columns, available.cast("int").alias("available"), *[F.coalesce(n, F.lit(0)).alias(n) for n in aggregates])
