"""Frames and their detections, decision times, small projections, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import scalars as S
from evenkeel.operators import frames as R
from evenkeel.operators import timeline as L

from .base import EV, events, query, table

#: Four made-up boxes of a frame: corners from neighbouring components, a class from the id; the image is 4 by 4.
BOXES = [(1, 2), (5, 3), (9, 5), (13, 7)]
BOX_SQL = ", ".join(
    f"struct_pack(cls := (vec_id * {m} + {k}) % 12, conf := 0.5::double, x1 := least(e[{k}], e[{k + 2}]) + 2, y1 := least(e[{k + 1}], e[{k + 3}]) + 2, x2 := greatest(e[{k}], e[{k + 2}]) + 2, y2 := greatest(e[{k + 1}], e[{k + 3}]) + 2)"
    for k, m in BOXES
)
FRAMES = f"f as (select label, vec_id, [{BOX_SQL}] as b from (select label, vec_id, embedding::double[] as e from embeddings))"
VEHICLES = "list_filter(b, lambda x: x.cls in (2, 3, 5, 7))"


def detections(spark, sf):
    e = lambda k: F.get("embedding", F.lit(k - 1)).cast("double")

    def box(k, m):
        low, high = (lambda a, b: F.least(e(a), e(b)) + 2), (lambda a, b: F.greatest(e(a), e(b)) + 2)
        cls = ((F.col("vec_id") * m + k) % 12).alias("cls")
        return F.struct(cls, F.lit(0.5).alias("conf"), low(k, k + 2).alias("x1"), low(k + 1, k + 3).alias("y1"), high(k, k + 2).alias("x2"), high(k + 1, k + 3).alias("y2"))

    return table(spark, sf, "embeddings").select("label", "vec_id", F.array(*[box(k, m) for k, m in BOXES]).alias("b"))


def count_sql(name: str) -> str:
    return f"len(list_filter(b, lambda x: x.cls in ({', '.join(map(str, R.CLASSES[name]))})))"


def cell_sql(cell: int) -> str:
    r, c = divmod(cell, 3)
    third = lambda at, k: f"(case when {at} / 4 < 1.0::double / 3 then 0 when {at} / 4 < 2.0::double / 3 then 1 else 2 end) = {k}"
    return f"list_filter(b, lambda x: x.cls in (2, 3, 5, 7) and {third('((x.x1 + x.x2) / 2)', c)} and {third('((x.y1 + x.y2) / 2)', r)})"


FRAME_INTS = ["label", "vec_id", *R.CLASSES, "corridor", *[f"n_{divmod(k, 3)[0]}{k % 3}" for k in range(9)]]


@query(
    "q_frame_counts",
    f"""with {FRAMES} select label, vec_id, {", ".join(f"{count_sql(n)} as {n}" for n in R.CLASSES)},
    len(list_filter(b, lambda x: x.cls in (2, 3, 5, 7) and (x.x1 + x.x2) / 2 between 1 and 3 and x.y2 >= 1.2::double)) as corridor,
    {", ".join(f"len({cell_sql(k)}) as n_{k // 3}{k % 3}, coalesce(list_sum(list_transform({cell_sql(k)}, lambda x: (x.x2 - x.x1) * (x.y2 - x.y1))), 0) / 16 as a_{k // 3}{k % 3}" for k in range(9))} from f""",
    " ".join(FRAME_INTS),
)
def frame_counts(spark, sf):
    side = F.lit(4.0)
    return detections(spark, sf).select("label", "vec_id", *[c.cast("long").alias(n) if n in FRAME_INTS else c.alias(n) for n, c in R.frame_columns(F.col("b"), side, side).items()])


@query(
    "q_light_state",
    """with x as (select event_id, event_id % 37 as coloured, event_id % 11 as red, event_id % 7 as amber, event_id % 9 as green, value as ry, 490 - value as gy from events),
    b as (select *, greatest(red, amber, green) as best from x)
    select event_id, case when coloured < 4 or best < greatest(3, 0.25 * coloured) then 'unknown' when red = green and red > 0 then case when ry <= gy then 'red' else 'green' end
      when red = best then 'red' when green = best then 'green' else 'amber' end as state from b""",
)
def light_state(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", R.light_state(k % 37, k % 11, k % 7, k % 9, F.col("value"), F.lit(490) - F.col("value")).alias("state"))


@query("q_frame_change", f"with {EV} select id, abs(v - lag(v) over (partition by k order by u, id)) as change from ev", "id")
def frame_change(spark, sf):
    rows = events(spark, sf).withColumn("at", F.struct("u", "id"))
    return rows.select("id", R.change(F.col("v"), "k", "at").alias("change"))


@query("q_engaged_share", f"with {EV} select k, 100 * avg((e in ('view', 'click'))::int::double) as engaged_percent from ev group by 1", "k")
def engaged_share(spark, sf):
    on = S.engaged(F.when(F.col("e") == "view", 1.0), F.when(F.col("e") == "click", 1.0))
    return events(spark, sf).groupBy("k").agg((F.avg(on.cast("double")) * 100).alias("engaged_percent"))


@query("q_decision_times", "select i, -6.5 + 0.5 * i as decision_t_s, 6.5 - 0.5 * i as lead_s from (select unnest(range(14)) as i)", "i")
def decision_times(spark, sf):
    times = L.decision_times(3.5, 0.5)
    rows = spark.createDataFrame(list(enumerate(times)), "i long, decision_t_s double")
    return rows.withColumn("lead_s", -F.col("decision_t_s") + F.lit(0.0))


@query(
    "q_build_windows",
    f"""with {EV}, x as (select id, v, (u / 3600000000.0::double) / 72 - 10 as t from ev), d as (select -8.0 + i as s from (select unnest(range(9)) as i))
    select s::double as decision_t_s, count(*) as n, sum(v) as total, 2.0::double as window_s from x join d on t between s - 2 - 1e-9 and s + 1e-9 group by 1""",
    "n",
    6,
)
def build_windows(spark, sf):
    rows = events(spark, sf).withColumn("t", F.col("u") / 3600000000.0 / 72 - 10)
    out = L.build_windows(rows, "t", L.decision_times(2.0, 1.0), 2.0)
    return out.groupBy("decision_t_s", "window_s").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(
    "q_first_off",
    f"with {EV}, n as (select *, row_number() over (partition by k order by u, id) - 1 as i from ev) "
    "select k, min(i) filter (v < 100) as first_off, max((v is not null)::int) as has_values, count(*) as n from n group by 1",
)
def first_off(spark, sf):
    """For each key the first place of a series under a bound (null: none), and whether the series has a value at all."""
    series = events(spark, sf).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("u", "id", "v"))).alias("a"))
    off = F.array_position(F.transform("a", lambda x: F.coalesce(x["v"] < 100, F.lit(False))), True)
    return series.select("k", F.when(off > 0, off - 1).alias("first_off"), F.exists("a", lambda x: x["v"].isNotNull()).cast("int").alias("has_values"), F.size("a").cast("long").alias("n"))


@query(
    "q_intersect",
    "select o_custkey from orders where o_orderpriority = '1-URGENT' intersect select o_custkey from orders where o_orderstatus = 'F'",
)
def intersect(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderpriority = '1-URGENT'").select("o_custkey").intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query(
    "q_superseded_columns",
    "select o_orderkey, 3.5::double as window_s, -0.0::double + 0.0::double as lead_s, o_totalprice / 2 as o_totalprice from orders",
    "o_orderkey",
)
def superseded_columns(spark, sf):
    """Columns worked out anew take the place of old ones; constants go along with every row."""
    old = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("old_totalprice"))
    new = old.withColumn("o_totalprice", F.col("old_totalprice") / 2).withColumns({"window_s": F.lit(3.5), "lead_s": -F.lit(0.0) + F.lit(0.0)})
    return new.drop("old_totalprice")


@query(
    "q_failures",
    "select user_id % 10 as part, count(*) filter (event_type = 'error') as failed, count(*) filter (event_type <> 'error') as kept, "
    "min(event_id) filter (event_type = 'error') as first_failed from events group by 1",
)
def failures(spark, sf):
    """What can't be read is told apart and counted, and the rest goes on."""
    rows = table(spark, sf, "events").withColumn("number", F.when(F.col("event_type") == "error", F.lit("none")).otherwise(F.col("value").cast("string")))
    bad = S.to_number(F.col("number")).isNull()
    return rows.groupBy((F.col("user_id") % 10).alias("part")).agg(F.count_if(bad).alias("failed"), F.count_if(~bad).alias("kept"), F.min(F.when(bad, F.col("event_id"))).alias("first_failed"))


@query("q_flow_scalars")
def flow_scalars(spark, sf):
    """Motion scalars of 8 x 8 fields: a vector's components across, and those of its mirror image down; tests hold them against loops."""
    from evenkeel.operators import flow

    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x * 4).alias("u"), F.reverse(F.transform("embedding", lambda x: x * 4)).alias("v"))
    rules = flow.Rules(border=0, hood=0.0, step=1, least_points=20)
    return flow.flow_scalars(e, "u", "v", 8, 8, rules).drop("u", "v")
