"""Feature blocks and the nested document."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import scalars as S
from evenkeel.operators import blocks as B
from evenkeel.operators import timeline as L

from .base import FIRST, HOUR, LAST, SIGNALS, STEP, STRIDE, WIDTH, WIN, events, in_duckdb, query, windows, with_signals
from .series import SMOOTH, with_onsets

KJ = ["k", "j"]
SIGNAL_SQL = ", ".join(f"{in_duckdb(x)} as {c}" for c, x in SIGNALS.items())
Q = lambda c, *ps: ", ".join(f"quantile_cont({c}, {p}) as {c.replace('_cap', '')}_p{int(p * 100)}" for p in ps)


def peaks(column: str, name: str) -> str:
    """Smoothed rate of change of a linear signal of v."""
    base = SMOOTH.replace("from win)", f"from (select k, j, t as u, {column} as v from sig))")
    return f"with sig as (select * from sig), {base}, r as (select k, j, n, i, u, abs(lead(s) over (partition by k, j order by i) - s) / 0.05 as x, (u + lead(u) over (partition by k, j order by i)) / 2 as m from sm) select k, j, max(x) as {name}_max, quantile_cont(x, 0.5) as {name}_p50, quantile_cont(x, 0.95) as {name}_p95, arg_min(m, {{'x': -x, 'm': m}}) filter (x is not null) as time_of_peak_{name} from r where n >= 5 group by all"


MOTION = f"""with {WIN}, sig0 as (select k, j, {SIGNAL_SQL} from win),
sig1 as (select *, lead_status > 0.5 as lead, case when lead_status > 0.5 then d_rel end as gap, case when lead_status > 0.5 and v_rel < -0.5 then -v_rel end as closing from sig0),
sig as (select *, case when speed > 0.5 and gap / speed > 0 then gap / speed end as thw, case when gap > 5 and closing > 0 then gap / closing end as ttc, case when gap > 5 and closing > 0 then least(gap / closing, 100) end as ttc_cap,
  case when gap > 5 then closing * closing / (gap * 2) end as drac, case when gap > 5 and closing is not null then least(closing * closing / (gap * 2), 50) end as drac_cap, coalesce(lag(lead) over (partition by k, j order by t), false) and not lead as dropped,
  row_number() over (partition by k, j order by t) - row_number() over (partition by k, j, lead order by t) as island from sig1),
agg as (select k, j, count(*) as n, {", ".join(f"arg_max({c}, t) as {c}" for c in ("speed", "accel", "steer_angle", "steer_torque", "cruise"))},
  avg(speed) as speed_mean, arg_max(speed, t) - arg_min(speed, t) as speed_delta, min(accel) as accel_min, max(accel) as accel_max, {Q("accel", 0.05, 0.5, 0.95)}, arg_min(t, {{'v': accel, 't': t}}) as time_of_peak_decel,
  {", ".join(f"max(abs({c})) as {c}_max_abs" for c in ("steer_angle", "steer_torque", "curvature", "desired_curvature"))},
  count(*) filter (lead) as n_lead, avg(lead::int::double) as lead_rate, count(*) filter (dropped) as lead_drops, min(gap) as gap_min, {Q("gap", 0.05)}, min(thw) as thw_min, {Q("thw", 0.05, 0.5, 0.95)},
  min(ttc) as ttc_min_raw, min(ttc_cap) as ttc_min, {Q("ttc_cap", 0.05, 0.5, 0.95)}, arg_min(t, {{'v': ttc, 't': t}}) filter (ttc is not null) as time_of_min_ttc,
  max(drac) as drac_max_raw, max(drac_cap) as drac_max, {Q("drac_cap", 0.5, 0.95)}, arg_min(t, {{'v': -drac, 't': t}}) filter (drac is not null) as time_of_max_drac,
  {", ".join(f"count(*) filter (ttc_cap < {x}) * 0.05 as time_below_ttc_{str(x).replace('.', '_')}, coalesce(sum(greatest({x} - ttc_cap, 0)) filter (ttc_cap is not null), 0) * 0.05 as severity_ttc_{str(x).replace('.', '_')}" for x in B.TTC_LIMITS)},
  {", ".join(f"count(*) filter (thw < {x}) * 0.05 as time_below_thw_{str(x).replace('.', '_')}" for x in B.THW_LIMITS)}, {", ".join(f"count(*) filter (drac_cap > {x}) * 0.05 as time_above_drac_{str(x).replace('.', '_')}" for x in B.DRAC_LIMITS)},
  (count(left_prob) + count(right_prob) > 0)::int as has_lane_probs, avg(left_prob) as left_prob_mean, avg(right_prob) as right_prob_mean, max((fcw > 0.5)::int) as fcw_present
  from sig group by all having count(*) >= 2),
jerk as ({peaks("accel", "jerk")}), steer as ({peaks("steer_angle", "steer_rate")}),
runs as (select k, j, max(span) as lead_longest from (select k, j, lead, case when lead then max(t) - min(t) else 0 end as span from sig group by k, j, lead, island) group by all)
select agg.*, jerk_max, jerk_p50, jerk_p95, time_of_peak_jerk, steer_rate_max, steer_rate_p95, time_of_peak_steer_rate, lead_longest from agg left join jerk using (k, j) left join steer using (k, j) left join runs using (k, j)"""


def begin():
    """A window's first tick, in hours."""
    return F.col("j") * (STRIDE / HOUR) - WIDTH / HOUR


def in_windows(rows):
    return L.sliding(rows, "u", WIDTH, STRIDE, FIRST, LAST)


@query("q_block_motion", MOTION, "k j n n_lead lead_drops has_lane_probs fcw_present")
def block_motion(spark, sf):
    rows = B.margins(with_signals(events(spark, sf)))
    return B.motion_block(in_windows(B.with_edges(rows, "k", F.col("lead"), F.col("t"))), KJ, 0.05, begin())


BOX = {
    "t": f"u / {HOUR}.0D", "lead": "v > 150", "area": "v / 500", "cx": "v / 250 - 1", "y2": "v / 490", "conf": "v / 495", "vehicles": "id % 5", "corridor": "id % 3",
    "person": "case when e = 'error' then 1 else 0 end", "bicycle": "case when e = 'signup' then id % 2 else 0 end", "light": "case when e = 'view' then 2 else 0 end", "stop": "case when e = 'purchase' then 1 else 0 end",
    "red": "case when e = 'click' then 1 else 0 end", "amber": "case when id % 97 = 0 then 1 else 0 end", "green": "case when e = 'view' then id % 3 else 0 end", "unknown": "case when id % 211 = 1 then 1 else 0 end",
    "brightness": "v / 3", "motion": "case when e <> 'signup' then v / 9 end",
    **{f"n_{r}{c}": f"(id + {3 * r + c}) % 4" for r, c in B.CELLS}, **{f"a_{r}{c}": f"case when id % {r + 2} = 0 then v / {900 + c} end" for r, c in B.CELLS},
}
BOX_INTS = (
    "k j available n_frames lead_available lead_drops vehicles_max vehicles_delta corridor_max corridor_clear any_vehicle"
    " person_max bicycle_max light_max stop_max any_vru any_light red_any amber_any green_any unknown_any"
)
SCAFFOLD = "s as (select k, j from (select distinct k from ev), d)"
BOX_SQL = f"""with {WIN}, {SCAFFOLD},
x as (select k, j, {", ".join(f"{in_duckdb(e)} as {c}" for c, e in BOX.items())} from win),
y as (select *, coalesce(lag(lead) over (partition by k, j order by t), false) and not lead as dropped,
  row_number() over (partition by k, j order by t) - row_number() over (partition by k, j, lead order by t) as island from x),
a as (select k, j, count(*) as n_frames, max(lead::int) as lead_available, avg(lead::int::double) as lead_rate,
  avg(area) filter (lead) as area_mean, max(area) filter (lead) as area_max, quantile_cont(area, 0.9) filter (lead) as area_p90, arg_max(area, t) filter (lead) as area_last,
  case when count(*) filter (lead) >= 3 then regr_slope(area, t) filter (lead) end as area_growth,
  case when count(*) filter (lead) >= 2 then (arg_max(area, t) filter (lead)) - (arg_min(area, t) filter (lead)) end as area_delta,
  avg(cx) filter (lead) as cx_mean, arg_max(cx, t) filter (lead) as cx_last, max(abs(cx)) filter (lead) as cx_max_abs,
  avg(y2) filter (lead) as y2_mean, max(y2) filter (lead) as y2_max, avg(conf) filter (lead) as conf_mean, count(*) filter (dropped) as lead_drops,
  avg(vehicles) as vehicles_mean, max(vehicles) as vehicles_max, case when count(*) >= 2 then arg_max(vehicles, t) - arg_min(vehicles, t) end as vehicles_delta,
  avg(corridor) as corridor_mean, max(corridor) as corridor_max, (max(corridor) <= 0)::int as corridor_clear, (max(vehicles) > 0)::int as any_vehicle,
  {", ".join(f"max({c}) as {c}_max" for c in ("person", "bicycle", "light", "stop"))},
  (max(person) > 0 or max(bicycle) > 0)::int as any_vru, (max(light) > 0)::int as any_light, avg(brightness) as brightness_mean, avg(motion) as motion_mean,
  {", ".join(f"avg({x}_{r}{c}) as {x}_{r}{c}_mean" for r, c in B.CELLS for x in ("n", "a"))},
  {", ".join(f"max(({x} > 0)::int) as {x}_any" for x in B.LIGHTS)}, {", ".join(f"avg(({x} > 0)::int::double) as {x}_frac" for x in B.LIGHTS[:3])}
  from y group by all),
r as (select k, j, max(span) as lead_longest from (select k, j, lead, case when lead then max(t) - min(t) else 0 end as span from y group by k, j, lead, island) group by all),
f as (select s.k, s.j, 1 as available, a.* exclude (k, j), r.lead_longest from s left join a using (k, j) left join r using (k, j))
select coalesce(columns(*), 0) from f"""


@query("q_block_boxes", BOX_SQL, BOX_INTS)
def block_boxes(spark, sf):
    e = events(spark, sf)
    rows = B.with_edges(e.select("k", "u", *[F.expr(x).alias(c) for c, x in BOX.items()]), "k", F.col("lead"), F.col("t"))
    s = L.scaffold(e.select("k").distinct(), FIRST, LAST)
    return B.box_block(in_windows(rows), s, KJ, F.lit(True), begin())


FLOW = {"t": f"u / {HOUR}.0D", "valid": "case when e <> 'signup' then 1.0D else 0.0D end", "residual": "v / 40", "corridor_residual": "v / 50", "sideways": "(v - 245) / 70", "lengthways": "(245 - v) / 80", "divergence": "(v - 200) / 90", "movers": "cast(id % 4 as double)", "mover_area": "v / 900", "scale": "1 + v / 5000", "rotation": "(v - 245) / 4000"}


@query(
    "q_block_flow",
    f"""with {WIN}, {SCAFFOLD}, m as (select *, quantile_cont(v, 0.5) over (partition by k order by u rows between 8 preceding and current row) as med from ev), ab as (select *, v > greatest(1.8 * med, 1) as above from m),
    o as (select id, u, k, (above and not coalesce(lag(above) over (partition by k order by u), false))::int as onset from ab), l as (select id, onset, max(case when onset = 1 then u / {HOUR}.0::double end) over (partition by k order by u) as last_onset from o),
    x as (select k, j, {", ".join(f"{in_duckdb(e)} as {c}" for c, e in FLOW.items())}, onset, onset * (v > 300)::int as corridor_onset, last_onset, j * 12.0::double as s from win join l using (id)),
    a as (select k, j, count(*) as n_samples, avg(residual) filter (valid > 0.5) as residual_mean, max(residual) filter (valid > 0.5) as residual_max, quantile_cont(residual, 0.9) filter (valid > 0.5) as residual_p90, avg(corridor_residual) filter (valid > 0.5) as corridor_mean, max(corridor_residual) filter (valid > 0.5) as corridor_max,
      avg(sideways) filter (valid > 0.5) as sideways_mean, max(abs(sideways)) filter (valid > 0.5) as sideways_max_abs, max(abs(lengthways)) filter (valid > 0.5) as lengthways_max_abs, avg(divergence) filter (valid > 0.5) as divergence_mean, max(divergence) filter (valid > 0.5) as divergence_max,
      avg(case when valid > 0.5 then movers else 0 end) as movers_mean, max(case when valid > 0.5 then movers else 0 end) as movers_max, max(mover_area) as mover_area_max, max((valid > 0.5 and movers > 0)::int) as movers_any, sum(onset)::bigint as onsets, sum(corridor_onset)::bigint as corridor_onsets, max((onset > 0 and t >= s - 12)::int) as onset_recent,
      coalesce(max(s) - max(last_onset), max(s) + 10) as since_onset, avg(scale) filter (valid > 0.5) as scale_mean, stddev_pop(rotation) filter (valid > 0.5) as rotation_std from x group by all),
    f as (select s.k, s.j, 1 as available, a.* exclude (k, j) from s left join a using (k, j)) select coalesce(columns(*), 0) from f""",
    "k j available n_samples movers_any onsets corridor_onsets onset_recent",
)
def block_flow(spark, sf):
    from pyspark.sql import Window

    rows = with_onsets(spark, sf).withColumn("onset", F.col("onset").cast("int"))
    order = Window.partitionBy("k").orderBy("u", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("last_onset", F.max(F.when(F.col("onset") == 1, F.col("u") / float(HOUR))).over(order)).withColumn("corridor_onset", F.when(F.col("v") > 300, F.col("onset")).otherwise(0))
    rows = L.sliding(rows, "u", WIDTH, STRIDE, FIRST, LAST).select(*KJ, "onset", "corridor_onset", "last_onset", *[F.expr(x).alias(c) for c, x in FLOW.items()])
    s = L.scaffold(events(spark, sf).select("k").distinct(), FIRST, LAST)
    return B.flow_block(rows, s, KJ, F.col("j") * 12.0, F.lit(True), 12.0)


@query("q_telemetry_doc")
def telemetry_doc(spark, sf):
    """A JSON document for each key: the series on the grid, native rate, warnings."""
    e = events(spark, sf)
    g = L.interpolate(e, L.grid(e.select("k").distinct(), 120, STEP), "k", "u", F.col("v"), "id")
    series = g.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("a"))
    rates = L.native_rate(e, "k", "u", "id")
    n = F.size("a")
    doc = F.struct(
        F.col("k").alias("key"), n.alias("n_samples"), F.transform("a", lambda x: x["i"] * 6).alias("t"),
        F.create_map(F.lit("value"), S.finite_values(F.transform("a", lambda x: F.bround(x["value"], 4)))).alias("series"), F.create_map(F.lit("value"), F.col("rate_hz")).alias("native_hz"),
        S.warnings((n < 120, F.lit("short grid")), (F.col("rate_hz") < 1e-4, F.format_string("low rate %.6f Hz", "rate_hz"))).alias("warnings"),
    )
    return series.join(rates, "k", "left").select("k", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))
