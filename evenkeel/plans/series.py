"""Windows, alignment, runs, onsets, smoothing over the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evenkeel.functions import reducers as R
from evenkeel.operators import isolation as I
from evenkeel.operators import relational as O
from evenkeel.operators import timeline as L

from .base import EV, FIRST, HOUR, LAST, POINTS, STEP, STRIDE, WIDTH, WIN, events, query, windows

GRID = f"g as (select k, i, (i * {STEP}::bigint)::bigint as g from (select distinct k from ev), (select unnest(range(0, {POINTS})) as i))"
KJ = ["k", "j"]


def points(spark, sf):
    return L.grid(events(spark, sf).select("k").distinct(), POINTS, STEP)


@query("q_asof_ffill", f"with {EV}, {GRID} select g.k, g.i, ev.v as value from g asof left join ev on g.k = ev.k and ev.u <= g.g", "k i")
def asof(spark, sf):
    return L.as_of(events(spark, sf), points(spark, sf), "k", "u", F.col("v"), "id").select("k", "i", "value")


@query(
    "q_asof_ffill_backfill",
    f"with {EV}, {GRID}, f as (select k, arg_min(v, u) as first from ev group by 1) select g.k, g.i, coalesce(ev.v, f.first) as value "
    "from g asof left join ev on g.k = ev.k and ev.u <= g.g join f on f.k = g.k",
    "k i",
)
def asof_backfill(spark, sf):
    return L.as_of(events(spark, sf), points(spark, sf), "k", "u", F.col("v"), "id", backfill=True).select("k", "i", "value")


AROUND = f"with {EV}, {GRID}, a as (select g.k, g.i, g.g, ev.u as u0, ev.v as v0 from g asof left join ev on g.k = ev.k and ev.u <= g.g), b as (select a.*, ev.u as u1, ev.v as v1 from a asof left join ev on a.k = ev.k and ev.u >= a.g)"
LINE = "case when u0 = u1 then v0 else v0 + (v1 - v0) * ((g - u0)::double / (u1 - u0)::double) end"


@query("q_interp_grid", f"{AROUND} select k, i, {LINE} as value from b", "k i")
def interp(spark, sf):
    return L.interpolate(events(spark, sf), points(spark, sf), "k", "u", F.col("v"), "id").select("k", "i", "value")


@query("q_interp_clamped", f"{AROUND} select k, i, coalesce({LINE}, v0, v1) as value from b", "k i")
def interp_clamped(spark, sf):
    return L.interpolate(events(spark, sf), points(spark, sf), "k", "u", F.col("v"), "id", clamp=True).select("k", "i", "value")


@query("q_nearest_join", f"with {EV} select k, arg_min(v, {{'d': abs(u - {300 * HOUR}::bigint), 'u': u}}) as value from ev group by 1", "k")
def nearest(spark, sf):
    e = events(spark, sf)
    return e.groupBy("k").agg(L.nearest(e, "u", F.lit(300 * HOUR), F.col("v")).alias("value"))


@query("q_range_join_windows", f"with {WIN} select k, j, count(*) as n from win group by all")
def range_join(spark, sf):
    return windows(spark, sf).groupBy(*KJ).agg(F.count("*").alias("n"))


@query(
    "q_scaffold_zero_inflated",
    f"with {WIN}, s as (select k, j from (select distinct k from ev), d) "
    "select s.k, s.j, count(v) as n, coalesce(avg(v), 0) as mean, coalesce(max(v), 0) as top, (count(v) > 0)::int as filled from s "
    "left join win using (k, j) group by all",
    "k j n filled",
)
def zero_inflated(spark, sf):
    s = L.scaffold(events(spark, sf).select("k").distinct(), FIRST, LAST)
    a = windows(spark, sf).groupBy(*KJ).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("top"))
    out = s.join(a, KJ, "left")
    return out.select(*KJ, F.coalesce("n", F.lit(0)).alias("n"), R.zero(F.col("mean")).alias("mean"), R.zero(F.col("top")).alias("top"), F.col("n").isNotNull().cast("int").alias("filled"))


@query("q_window_stats", f"with {WIN} select k, j, count(*) as n, min(v) as low, max(v) as high, avg(v) as mean from win group by all", "k j n")
def window_stats(spark, sf):
    return windows(spark, sf).groupBy(*KJ).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))


@query(
    "q_window_percentiles",
    f"with {WIN} select k, j, quantile_cont(v, 0.05) as p5, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.95) as p95 from win "
    "group by all",
    "k j",
)
def window_percentiles(spark, sf):
    return windows(spark, sf).groupBy(*KJ).agg(*[R.quantile(F.col("v"), p).alias(f"p{int(p * 100)}") for p in (0.05, 0.5, 0.95)])


@query(
    "q_window_first_last_delta",
    f"with {WIN} select k, j, arg_min(v, u) as first, arg_max(v, u) as last, case when count(*) >= 2 then arg_max(v, u) - arg_min(v, "
    "u) end as delta from win group by all",
    "k j",
)
def window_first_last(spark, sf):
    return windows(spark, sf).groupBy(*KJ).agg(R.first_value(F.col("v"), F.col("u")).alias("first"), R.last_value(F.col("v"), F.col("u")).alias("last"), R.change(F.col("v"), F.col("u")).alias("delta"))


@query(
    "q_window_argextreme",
    f"with {WIN} select k, j, arg_min(u, {{'v': round(v / 50), 'u': u}}) as least_at, arg_min(u, "
    f"{{'v': -round(v / 50), 'u': u}}) as most_at from win group by all",
)
def window_argextreme(spark, sf):
    v = F.round(F.col("v") / 50)
    return windows(spark, sf).groupBy(*KJ).agg(R.when_least(v, F.col("u")).alias("least_at"), R.when_most(v, F.col("u")).alias("most_at"))


@query(
    "q_window_slope",
    f"with {WIN} select k, j, case when count(*) >= 3 and max(u) > min(u) then regr_slope(v, u / {HOUR}.0::double) end as slope "
    "from win group by all",
    "k j",
)
def window_slope(spark, sf):
    return windows(spark, sf).groupBy(*KJ).agg(R.slope(F.col("v"), F.col("u") / float(HOUR)).alias("slope"))


@query("q_window_std_pop", f"with {WIN} select k, j, stddev_pop(v) as spread from win group by all", "k j")
def window_std(spark, sf):
    return windows(spark, sf).groupBy(*KJ).agg(F.stddev_pop("v").alias("spread"))


@query(
    "q_exposure_severity",
    f"with {WIN} select k, j, count(*) filter (v < 100) * 0.05 as under, sum(greatest(100 - v, 0)) * 0.05 as severity, "
    "max((e = 'error')::int) as any_error, avg((v > 250)::int::double) as high_rate from win group by all",
    "k j any_error",
)
def exposure(spark, sf):
    v = F.col("v")
    return windows(spark, sf).groupBy(*KJ).agg(R.time_under(v, 100, 0.05).alias("under"), R.severity(v, 100, 0.05).alias("severity"), R.ever(F.col("e") == "error").alias("any_error"), R.rate(v > 250).alias("high_rate"))


@query(
    "q_transitions",
    f"with {WIN}, f as (select *, lag(v > 100) over (partition by k, j order by u) as p from win) "
    "select k, j, count(*) filter (p and not v > 100) as falls, count(*) filter (v > 100 and not coalesce(p, false)) as rises from f "
    "group by all",
)
def transitions(spark, sf):
    order = Window.partitionBy(*KJ).orderBy("u", "id")
    flag = F.col("v") > 100
    rows = windows(spark, sf).withColumn("fall", L.falling(flag, order)).withColumn("rise", L.rising(flag, order))
    return rows.groupBy(*KJ).agg(F.count_if("fall").alias("falls"), F.count_if("rise").alias("rises"))


@query(
    "q_longest_run",
    f"with {WIN}, f as (select *, (v > 100)::int as f, row_number() over (partition by k, j order by u) - row_number() over (partition by k, j, v > 100 order by u) as island from win), r as (select k, j, f, case when f = 1 then max(u) - min(u) else 0 end as span from f group by k, j, f, island) select k, j, max(span)::bigint as longest from r group by all",
)
def longest_run(spark, sf):
    return L.longest_run(windows(spark, sf), KJ, "u", "id", F.col("v") > 100)


RANKS = f"with {EV}, x as (select e, v, u, rank() over (partition by e order by v) + (count(*) over (partition by e, v) - 1) / 2.0::double as a, rank() over (partition by e order by u) + (count(*) over (partition by e, u) - 1) / 2.0::double as b from ev)"


@query("q_spearman", f"{RANKS} select e, count(*) as n, corr(a, b) as rho from x group by 1", "e n")
def spearman(spark, sf):
    return O.rank_correlation(events(spark, sf).select("e", "v", "u"), ["e"], "v", "u")


@query(
    "q_decile_rate",
    f"with {EV}, q as (select k % 7 as part, *, quantile_cont(v, 0.9) over (partition by k % 7) as cut from ev) "
    "select part, avg((e = 'error')::int::double) filter (v >= cut) as high, avg((e = 'error')::int::double) filter (v < cut) as rest "
    "from q group by 1",
    "part",
)
def decile_rate(spark, sf):
    rows = events(spark, sf).withColumn("part", F.col("k") % 7)
    cuts = rows.groupBy("part").agg(R.quantile(F.col("v"), 0.9).alias("cut"))
    hit = (F.col("e") == "error").cast("double")
    return rows.join(cuts, "part").groupBy("part").agg(F.avg(F.when(F.col("v") >= F.col("cut"), hit)).alias("high"), F.avg(F.when(F.col("v") < F.col("cut"), hit)).alias("rest"))


@query(
    "q_gate",
    f"{RANKS}, r as (select e, corr(a, b) as rho from x group by 1) "
    "select median(rho) as middle, avg((rho < 0)::int::double) as negative, (median(rho) < 0.5)::int as passed from r",
    "passed",
)
def gate(spark, sf):
    r = O.rank_correlation(events(spark, sf).select("e", "v", "u"), ["e"], "v", "u")
    return r.agg(F.median("rho").alias("middle"), R.rate(F.col("rho") < 0).alias("negative"), (F.median("rho") < 0.5).cast("int").alias("passed"))


@query(
    "q_native_rate",
    f"with {EV}, x as (select k, u - lag(u) over (partition by k order by u) as d from ev) "
    "select k, case when count(*) > 2 and median(d) > 0 then 1e9 / median(d) end as rate_mhz from x group by 1",
    "k",
)
def native_rate(spark, sf):
    return L.native_rate(events(spark, sf), "k", "u", "id").select("k", (F.col("rate_hz") * 1000).alias("rate_mhz"))


MEDIANS = f"with {EV}, m as (select *, quantile_cont(v, 0.5) over (partition by k order by u rows between 8 preceding and current row) as med from ev)"
ONSETS = f"{MEDIANS}, a as (select *, v > greatest(1.8 * med, 1) as above from m), o as (select *, above and not coalesce(lag(above) over (partition by k order by u), false) as onset from a)"


@query("q_rolling_median", f"{MEDIANS} select id, med from m", "id")
def rolling_median(spark, sf):
    order = Window.partitionBy("k").orderBy("u", "id")
    return events(spark, sf).select("id", L.rolling_median(F.col("v"), order, 8).alias("med"))


def with_onsets(spark, sf):
    return L.onsets(events(spark, sf), "k", "u", "id", "v", 8, 1.8, 1.0)


@query("q_onset", f"{ONSETS} select id, above::int as above, onset::int as onset from o")
def onset(spark, sf):
    return with_onsets(spark, sf).select("id", F.col("above").cast("int").alias("above"), F.col("onset").cast("int").alias("onset"))


@query(
    "q_time_since_onset",
    f"{ONSETS}, s as (select k, j, j * {STRIDE}::bigint as s from (select distinct k "
    f"from ev), (select unnest(range({FIRST}, {LAST + 1})) as j)) "
    f"select s.k, s.j, coalesce(s.s - max(o.u), s.s + {10 * HOUR}::bigint)::bigint as since from s left "
    "join o on o.k = s.k and o.onset and o.u <= s.s group by s.k, s.j, s.s",
)
def time_since_onset(spark, sf):
    rows = with_onsets(spark, sf)
    s = L.scaffold(rows.select("k").distinct(), FIRST, LAST).withColumn("g", F.col("j") * STRIDE).withColumnRenamed("j", "i")
    hit = rows.where("onset").withColumn("at", F.col("u").cast("double"))
    last = L.as_of(hit, s, "k", "u", F.col("at"), "id")
    return last.select("k", F.col("i").alias("j"), F.coalesce(F.col("g") - F.col("value").cast("long"), F.col("g") + 10 * HOUR).alias("since"))


@query(
    "q_recent_onset",
    f"{ONSETS}, d as (select unnest(range({FIRST}, {LAST + 1})) as j) "
    f"select k, j, count(*) filter (onset) as onsets, max((onset and u >= j * {STRIDE}::bigint - {12 * HOUR}::bigint)::int) as recent "
    f"from o join d on u between j * {STRIDE}::bigint - {WIDTH} and j * {STRIDE}::bigint group by all",
)
def recent_onset(spark, sf):
    rows = L.sliding(with_onsets(spark, sf), "u", WIDTH, STRIDE, FIRST, LAST)
    return rows.groupBy(*KJ).agg(F.count_if("onset").alias("onsets"), R.ever(F.col("onset") & (F.col("u") >= F.col("j") * STRIDE - 12 * HOUR)).alias("recent"))


def hat_values(rows: list[list[int]]) -> str:
    return ", ".join(f"({len(rows)}, {i}, {c}, {x})" for i, r in enumerate(rows) for c, x in enumerate(r))


#: Smoothing as a join of the numbered rows with the coefficients.
SMOOTH = f"""h as (select * from (values {hat_values(L.SMOOTH_7)}, {hat_values(L.SMOOTH_5)}) as h(w, r, c, x)),
    n as (select k, j, u, v, row_number() over (partition by k, j order by u) - 1 as i, count(*) over (partition by k, j) as n from win),
    p as (select *, case when n >= 7 then 7 when n >= 5 then 5 end as w from n), q as (select *, greatest(0, least(i - w // 2, n - w)) as st from p),
    sm as (select q.k, q.j, q.u, q.i, q.n, case when any_value(q.w) is null then any_value(q.v) else sum(h.x * b.v) / any_value(case q.w when 7 then 42 else 35 end) end as s
        from q left join h on h.w = q.w and h.r = q.i - q.st left join q b on b.k = q.k and b.j = q.j and b.i = q.st + h.c group by q.k, q.j, q.u, q.i, q.n)"""


def smoothed_windows(spark, sf):
    a = windows(spark, sf).groupBy(*KJ).agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("a"))
    return a.select(*KJ, F.transform("a", lambda x: x["u"]).alias("u"), L.smoothed(F.transform("a", lambda x: x["v"])).alias("s"))


@query("q_savgol", f"with {WIN}, {SMOOTH} select k, j, u, s from sm", "k j u")
def savgol(spark, sf):
    return smoothed_windows(spark, sf).select(*KJ, F.explode(F.arrays_zip("u", "s")).alias("z")).select(*KJ, F.col("z.u").alias("u"), F.col("z.s").alias("s"))


@query(
    "q_derivative_peak",
    f"with {WIN}, {SMOOTH}, r as (select k, j, n, abs(lead(s) over (partition by k, j order by i) - s) / 0.05 as x from sm) "
    "select k, j, max(x) as top, quantile_cont(x, 0.95) as p95 from r where n >= 5 group by all",
    "k j",
)
def derivative_peak(spark, sf):
    rows = smoothed_windows(spark, sf).select(*KJ, F.explode(L.step_rates(F.col("s"), 0.05)).alias("x"))
    return rows.groupBy(*KJ).agg(F.max("x").alias("top"), R.quantile(F.col("x"), 0.95).alias("p95"))


@query(
    "q_sustained_switch",
    f"with {EV}, f as (select *, (v > 150)::int as f from ev), x as (select *, lag(f) over (partition by k "
    "order by u) as p, avg(f) over (partition by k order by u rows between 1 following and 3 following) as nx from f) "
    "select k, min(u) filter (p = 1 and f = 0 and nx < 0.5) as switch from x group by 1",
)
def sustained_switch(spark, sf):
    return L.sustained_switch(events(spark, sf), "k", "u", "id", F.col("v") > 150, 3, 0.5)


@query(
    "q_pre_post_rate",
    f"with {EV} select k, avg((e = 'view')::int::double) filter (u < {300 * HOUR}::bigint) as pre, "
    f"avg((e = 'view')::int::double) filter (u > {400 * HOUR}::bigint) as post, avg((v > 100)::int::double) * 100 as percent from ev "
    "group by 1",
    "k",
)
def pre_post(spark, sf):
    hit = (F.col("e") == "view").cast("double")
    return events(spark, sf).groupBy("k").agg(F.avg(F.when(F.col("u") < 300 * HOUR, hit)).alias("pre"), F.avg(F.when(F.col("u") > 400 * HOUR, hit)).alias("post"), (R.rate(F.col("v") > 100) * 100).alias("percent"))


@query(
    "q_episodes",
    f"""with {EV}, r as (select k, u, row_number() over w as i, v > 100 as f, coalesce(lag(v > 100) over w, false) as was, max(u) over (partition by k) as last from ev window w as (partition by k order by u, id)),
    e as (select *, lag(u) over (partition by k order by i) as before from r where f <> was),
    n as (select *, sum(case when f and (before is null or u - before >= {6 * HOUR}) then 1 else 0 end) over (partition by k order by i rows unbounded preceding) as nth from e),
    g as (select k, nth, min(u) as a, max(u) as z, arg_max(f, i) as still_on, any_value(last) as last from n group by 1, 2),
    h as (select k, a, case when still_on then last else z end as b, still_on, last from g),
    w as (select *, coalesce(lead(a) over (partition by k order by a), last) as following from h)
    select k, a as start, b as end, b - a as on_span, following - b as off_span, not still_on and b - a >= {24 * HOUR} and following - b >= {24 * HOUR} as switch from w""",
)
def episodes(spark, sf):
    """Stretches of high values; breaks of under six hours don't end one, a day on and a day off make a switch."""
    return L.episodes(events(spark, sf), "k", "u", "id", F.col("v") > 100, 6 * HOUR, 24 * HOUR, 24 * HOUR)


@query(
    "q_rolling_median_by_rate",
    f"""with {EV}, s as (select *, u - lag(u) over w as step, row_number() over w as i, array_agg(v) over (partition by k order by u, id rows between unbounded preceding and unbounded following) as vs from ev window w as (partition by k order by u, id)),
    p as (select k, median(step) as m from s group by 1),
    l as (select s.*, case when m > 0 then greatest(1, round_even({48 * HOUR}::double / m, 0)::bigint) else 1 end as look from s join p on s.k is not distinct from p.k)
    select id, list_median(list_slice(vs, greatest(i - look, 1), i)) as med from l""",
    "id",
)
def rolling_median_by_rate(spark, sf):
    """Two days' trailing median, in rows of each key's own pace."""
    return L.rolling_medians_by_rate(events(spark, sf), "k", "u", "id", "v", 48 * HOUR).select("id", F.col("median").alias("med"))


@query(
    "q_isolated_blocks",
    f"""with {EV}, g as (select k, regr_slope(v, u / {HOUR}.0) as slope, arg_min(e, [u, id]) as first, count(*) as n from ev group by k)
    select k, case when first <> 'error' and n > 1 then slope end as slope, case when first = 'error' then 'ValueError: begins with an error' when n < 2 then 'ValueError: too few rows' end as error from g""",
    "k error",
    6,
)
def isolated_blocks(spark, sf):
    """A block that can't be worked out for some keys: those have the reason, the others their slope."""
    import numpy as np

    def block(rows):
        rows = rows.sort_by([("u", "ascending"), ("id", "ascending")])
        if rows.column("e")[0].as_py() == "error":
            raise ValueError("begins with an error")
        if rows.num_rows < 2:
            raise ValueError("too few rows")
        x, y = rows.column("u").to_numpy() / HOUR, rows.column("v").to_numpy()
        x = x - x.mean()
        return {"slope": float(np.dot(x, y - y.mean()) / np.dot(x, x))}

    return I.by_key(events(spark, sf), ["k"], block, "slope double")


HOT = f"{EV}, g as (select i, (i * {STEP}::bigint)::bigint as g from (select unnest(range(0, {POINTS})) as i)), a as (select i, g, (select arg_max(v, [u, id]) from ev where u <= g) as v0, (select max(u) from ev where u <= g) as u0, (select arg_min(v, [u, id]) from ev where u >= g) as v1, (select min(u) from ev where u >= g) as u1 from g)"


@query("q_asof_hot_key", f"with {HOT} select i, coalesce(v0, v1) as value from a", "i")
def asof_hot_key(spark, sf):
    """All rows are one key's: worked on by slices of a day."""
    one = L.grid(spark.range(1).select(F.lit(1).alias("k")), POINTS, STEP)
    return L.as_of(events(spark, sf).withColumn("k", F.lit(1)), one, "k", "u", F.col("v"), "id", backfill=True, width=24 * HOUR).select("i", "value")


@query(
    "q_interp_hot_key",
    f"with {HOT} select i, case when u0 is null or u1 is null then null when u0 = u1 then v0 else v0 + (v1 - v0) * ((g - u0)::double / (u1 - u0)::double) end as value from a",
    "i",
)
def interp_hot_key(spark, sf):
    one = L.grid(spark.range(1).select(F.lit(1).alias("k")), POINTS, STEP)
    return L.interpolate(events(spark, sf).withColumn("k", F.lit(1)), one, "k", "u", F.col("v"), "id", width=24 * HOUR).select("i", "value")
