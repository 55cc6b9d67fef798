"""Scans, projections, filters, joins, set operations, reshaping, profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evenkeel.functions import scalars as S
from evenkeel.operators import evaluation as V
from evenkeel.operators import frames
from evenkeel.operators import relational as O

from .base import EV, events, query, table


@query("q_scan_project", "select o_orderkey as order_id, o_custkey as customer, o_totalprice as price from orders")
def scan_project(spark, sf):
    return O.present(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderkey", "absent"]).toDF("order_id", "customer", "price")


@query("q_filter_params", "select p_partkey, p_brand, p_size from part where p_type = 'ECONOMY' and p_size > 10")
def filter_params(spark, sf):
    page, _ = O.search(table(spark, sf, "part"), limit=1 << 30, p_type="ECONOMY", p_brand=None)
    return page.where("p_size > 10").select("p_partkey", "p_brand", "p_size")


@query("q_filter_regex", "select p_partkey, p_name from part where coalesce(regexp_matches(p_name, '(?i)RED|w.dget'), false)")
def filter_regex(spark, sf):
    return table(spark, sf, "part").where(S.matches(F.col("p_name"), "RED|w.dget")).select("p_partkey", "p_name")


@query("q_filter_exclude", "select c_custkey, c_nationkey from customer where c_nationkey <> 3 and c_mktsegment in ('BUILDING', 'MACHINERY')")
def filter_exclude(spark, sf):
    return table(spark, sf, "customer").where((F.col("c_nationkey") != 3) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_nationkey")


@query("q_filter_interval_closed", f"with {EV} select id, u from ev where u between 36000000000 and 360000000000")
def filter_interval(spark, sf):
    return events(spark, sf).where(F.col("u").between(36000000000, 360000000000)).select("id", "u")


@query(
    "q_clean_cast",
    "select doc_id, try_cast(regexp_extract(source, '[0-9]+') as double) as source_no, try_cast(lang as double) as lang_no "
    "from documents",
)
def clean_cast(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.to_number(F.regexp_extract("source", "[0-9]+", 0)).alias("source_no"), S.to_number(F.col("lang")).alias("lang_no"))


@query(
    "q_bool_parse",
    "select doc_id, (lower(trim(lang)) in ('true', '1', '1.0', 'yes'))::double as lang_flag, "
    "(lower(trim((doc_id % 3)::varchar)) in ('true', '1', '1.0', 'yes'))::double as id_flag from documents",
)
def bool_parse(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.to_flag(F.col("lang")).alias("lang_flag"), S.to_flag(F.col("doc_id") % 3).alias("id_flag"))


@query("q_null_category", "select d.doc_id, coalesce(l.quality::varchar, '<NA>') as quality from documents d left join labels l using (doc_id)")
def null_category(spark, sf):
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.select("doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", S.category(F.col("quality")).alias("quality"))


@query("q_json_extract", "select event_id, json_extract_string(props, '$.k')::int as prop_k from events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("prop_k"))


@query("q_composite_key", "select o_orderkey, o_orderstatus || '/' || o_custkey::varchar || '/' || o_orderpriority as key from orders")
def composite_key(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.composite_key(F.col("o_orderstatus"), F.col("o_custkey"), F.col("o_orderpriority")).alias("key"))


@query("q_path_parts", "select page_id, split_part(url, '/', 3) as host, split_part(url, '/', 4) as first_part from pages")
def path_parts(spark, sf):
    parts = F.split("url", "/")
    return table(spark, sf, "pages").select("page_id", F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("host"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("first_part"))


@query("q_left_join_complete", "select o_orderkey, c_name, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def left_join_complete(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return O.join_complete(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@query(
    "q_star_join",
    "select r_name, n_name, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders "
    "join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey "
    "group by all",
    "r_name n_name n_orders",
    2,
)
def star_join(spark, sf):
    o, c, n, r = (table(spark, sf, x) for x in ("orders", "customer", "nation", "region"))
    rows = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    rows = rows.join(c, rows.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return rows.groupBy("r_name", "n_name").agg(F.sum("n").alias("n_orders"), F.sum("s").alias("total"))


@query("q_semi_join", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def semi_join(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("q_anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def anti_join(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("q_one_to_one_join", "select d.doc_id, d.source, l.quality, l.toxic from documents d left join labels l using (doc_id)")
def one_to_one_join(spark, sf):
    return O.join_one_to_one(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").select("doc_id", "quality", "toxic"), ["doc_id"])


@query("q_map_join_split", "select c_custkey, case c_nationkey % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split from customer")
def map_join_split(spark, sf):
    parts = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("n_nationkey") % 3 + 1).alias("split"))
    return table(spark, sf, "customer").join(parts, "c_nationkey").select("c_custkey", "split")


@query(
    "q_fingerprint_match",
    "with m as (select c_custkey, s_suppkey, count(*) over (partition by c_custkey) as n from customer join supplier on c_nationkey = s_nationkey and abs(c_acctbal - s_acctbal) <= 50 and abs(c_custkey - s_suppkey) <= 100000) select c_custkey, s_suppkey from m where n = 1",
)
def fingerprint_match(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    return O.match_within(c, s, ["nation"], "c_custkey", [("c_acctbal", "s_acctbal", 50.0), ("c_custkey", "s_suppkey", 100000.0)]).select("c_custkey", "s_suppkey")


@query(
    "q_paired_delta",
    """with m as (select l_linestatus, l_returnflag, avg(l_quantity) as quantity, avg(l_extendedprice) as price from lineitem group by all),
    u as (select l_linestatus, l_returnflag, 'quantity' as metric, quantity as v from m union all select l_linestatus, l_returnflag, 'price', price from m)
    select o.l_linestatus, o.l_returnflag, o.metric, b.v as base, o.v as other, o.v - b.v as delta from u o join u b on o.l_linestatus = b.l_linestatus and o.metric = b.metric and b.l_returnflag = 'N' where o.l_returnflag <> 'N'""",
    "l_linestatus l_returnflag metric",
)
def paired_delta(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"))
    return O.paired_delta(m, ["l_linestatus"], "l_returnflag", "N", ["quantity", "price"])


@query("q_value_counts", "select event_type, count(*) as n from events where event_type is not null group by 1")
def value_counts(spark, sf):
    return O.value_counts(table(spark, sf, "events"), "event_type")


@query(
    "q_freq_encode",
    "with f as (select p_brand, count(*)::double / sum(count(*)) over () as freq from part where p_partkey % 2 = 0 group by 1) "
    "select p_partkey, coalesce(freq, 0) as freq from part left join f using (p_brand) where p_partkey % 2 = 1",
    "p_partkey",
)
def freq_encode(spark, sf):
    p = table(spark, sf, "part")
    f = V.frequencies(p.where("p_partkey % 2 = 0"), "p_brand")
    return p.where("p_partkey % 2 = 1").join(f, "p_brand", "left").select("p_partkey", F.coalesce("freq", F.lit(0.0)).alias("freq"))


@query("q_distinct_counts", "select event_type, count(distinct user_id) as users, count(distinct props) as kinds from events group by 1")
def distinct_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("props").alias("kinds"))


@query(
    "q_facets_grouping_sets",
    "select 'p_brand' as facet, p_brand as value, count(*) as n from part group by p_brand union all select 'p_type', p_type, count(*) "
    "from part group by p_type union all select 'p_size', p_size::varchar, count(*) from part group by p_size",
)
def facets(spark, sf):
    return O.facets(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@query(
    "q_describe",
    " union all ".join(f"select '{c}' as \"column\", count({c}) as n, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as min, quantile_cont({c}, 0.05) as p5, quantile_cont({c}, 0.25) as p25, quantile_cont({c}, 0.5) as p50, quantile_cont({c}, 0.75) as p75, quantile_cont({c}, 0.95) as p95, max({c}) as max from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "\"column\" n",
    3,
)
def describe(spark, sf):
    return O.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("q_topk", "select p_brand, count(*) as n from part group by 1 order by n desc, p_brand limit 10")
def topk(spark, sf):
    return O.value_counts(table(spark, sf, "part"), "p_brand").orderBy(F.desc("n"), "p_brand").limit(10)


@query(
    "q_limit_total",
    "select event_id, (select count(*) from events where event_type = 'error') as total from events where event_type = 'error' "
    "order by event_id limit 300",
)
def limit_total(spark, sf):
    e = table(spark, sf, "events")
    page, total = O.search(e.orderBy("event_id").select("event_id", "event_type"), event_type="error")
    return page.crossJoin(total).select("event_id", "total")


@query("q_top_groups", "select user_id, avg(value) as mean_value from events group by 1 order by mean_value desc, user_id limit 4", "user_id")
def top_groups(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("mean_value")).orderBy(F.desc("mean_value"), "user_id").limit(4)


@query("q_seeded_sample", "select event_id from events order by md5('7:' || event_id::varchar), event_id limit 100")
def seeded_sample(spark, sf):
    key = F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string")).cast("binary"))
    return table(spark, sf, "events").select("event_id").orderBy(key, "event_id").limit(100)


@query(
    "q_union_all",
    "select o_orderkey as id from orders where o_orderstatus = 'F' union all select o_orderkey from orders where o_totalprice > 400000",
)
def union_all(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")).unionByName(o.where("o_totalprice > 400000").select(F.col("o_orderkey").alias("id")))


@query("q_distinct_keys", "select distinct o_custkey, o_orderstatus from orders")
def distinct_keys(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderstatus").dropDuplicates()


@query("q_set_difference", "select c_custkey as id from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def set_difference(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("q_upsert", "select o_orderkey, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as status from orders")
def upsert(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return O.upsert(old, old.where("o_orderkey % 5 = 0").withColumn("status", F.lit("X")), ["o_orderkey"])


@query("q_duplicates", "select p_name, p_brand, count(*) as n from part group by all having count(*) > 1")
def duplicates(spark, sf):
    return O.duplicates(table(spark, sf, "part"), ["p_name", "p_brand"])


@query(
    "q_unpivot_metrics",
    "unpivot (select l_returnflag, avg(l_quantity) as quantity, avg(l_discount) as discount from lineitem "
    "group by 1) on quantity, discount into name metric value value",
    "l_returnflag metric",
)
def unpivot_metrics(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount")).unpivot("l_returnflag", ["quantity", "discount"], "metric", "value")


@query(
    "q_pivot_metrics",
    "select l_returnflag, avg(l_quantity) filter (l_linestatus = 'F') as \"F\", avg(l_quantity) filter (l_linestatus = 'O') as \"O\" "
    "from lineitem group by 1",
    "l_returnflag",
)
def pivot_metrics(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))


@query("q_flatten_nested", "select user_id, min(value) as low, max(value) as high, count(*) as n from events group by 1", "user_id n")
def flatten_nested(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")).alias("m"))
    return rows.select("user_id", "m.*")


@query("q_arrays_roundtrip", "select user_id, event_id, value from events", "user_id event_id")
def arrays_roundtrip(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("a"))
    rows = rows.select("user_id", F.transform("a", lambda x: x["event_id"]).alias("ids"), F.transform("a", lambda x: x["value"]).alias("values"))
    return rows.select("user_id", F.explode(F.arrays_zip("ids", "values")).alias("z")).select("user_id", F.col("z.ids").alias("event_id"), F.col("z.values").alias("value"))


@query(
    "q_decimate",
    "select l_orderkey, l_linenumber, l_suppkey from (select *, row_number() over (partition by l_suppkey "
    "order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as n from lineitem) where (n - 1) % 4 = 0",
)
def decimate(spark, sf):
    from evenkeel.operators.timeline import every_kth

    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return every_kth(table(spark, sf, "lineitem"), order, 4).select("l_orderkey", "l_linenumber", "l_suppkey")


#: Stand-ins for gap, relative speed and speed.
MARGINS = {"gap": "l_quantity", "rel": "l_discount * 100 - 7", "speed": "l_tax * 20"}


@query(
    "q_derived_margins",
    """with m as (select l_orderkey, l_linenumber, l_partkey, l_quantity as gap, l_discount * 100 - 7 as rel, l_tax * 20 as speed from lineitem), c as (select *, case when rel < -0.5 then -rel end as closing from m)
    select l_orderkey, l_linenumber, l_partkey, closing, least(greatest(case when gap > 5 and closing > 0 then gap / closing end, 0), 100) as ttc, case when speed > 0.5 then case when gap / speed > 0 then gap / speed end end as thw,
    case when gap > 5 then closing * closing / (2 * gap) end as drac, hypot(gap, rel) as far, atan2(rel, gap) as angle from (select * from c)""".replace("hypot(gap, rel)", "sqrt(gap * gap + rel * rel)").replace("least(greatest(case when gap > 5 and closing > 0 then gap / closing end, 0), 100)", "case when gap > 5 and closing > 0 then least(greatest(gap / closing, 0), 100) end"),
    "l_orderkey l_linenumber l_partkey",
)
def derived_margins(spark, sf):
    m = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.expr(x).alias(c) for c, x in MARGINS.items()])
    gap, rel = F.col("gap"), F.col("rel")
    c = S.closing_speed(rel)
    return m.select("l_orderkey", "l_linenumber", "l_partkey", c.alias("closing"), S.clipped(S.time_to_collision(gap, c), 0.0, 100.0).alias("ttc"), S.time_headway(gap, F.col("speed")).alias("thw"), S.required_deceleration(gap, c).alias("drac"), F.sqrt(gap * gap + rel * rel).alias("far"), F.atan2(rel, gap).alias("angle"))


@query(
    "q_quality_warnings",
    "select user_id, list_filter([case when count(*) < 64 then 'few rows (' || count(*) || ')' end, case when max(value) < 485 then 'no high value' end, case when count(distinct event_type) < 5 then 'kinds missing' end], lambda x: x is not null)::varchar as warnings from events group by 1",
)
def quality_warnings(spark, sf):
    n = F.count("*")
    w = S.warnings((n < 64, F.format_string("few rows (%d)", n)), (F.max("value") < 485, F.lit("no high value")), (F.countDistinct("event_type") < 5, F.lit("kinds missing")))
    rows = table(spark, sf, "events").groupBy("user_id").agg(w.alias("w"))
    return rows.select("user_id", F.concat(F.lit("["), F.array_join(F.transform("w", lambda x: F.when(x.rlike("[()]"), F.concat(F.lit("'"), x, F.lit("'"))).otherwise(x)), ", "), F.lit("]")).alias("warnings"))


BOXES = "select vec_id, least(embedding[1], embedding[3])::double as x1, least(embedding[2], embedding[4])::double as y1, greatest(embedding[1], embedding[3])::double as x2, greatest(embedding[2], embedding[4])::double as y2, embedding[5]::double as cx, embedding[6]::double as cy, label from embeddings"


def boxes(spark, sf):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", "label", F.struct(F.least(e(0), e(2)).alias("x1"), F.least(e(1), e(3)).alias("y1"), F.greatest(e(0), e(2)).alias("x2"), F.greatest(e(1), e(3)).alias("y2")).alias("box"), e(4).alias("cx"), e(5).alias("cy"))


@query(
    "q_box_grid",
    f"with b as ({BOXES}) select label, (case when cy < 1.0::double/3 then 0 when cy < 2.0::double/3 then 1 else 2 end) * 3 + (case "
    "when cx < 1.0::double/3 then 0 when cx < 2.0::double/3 then 1 else 2 end) as cell, count(*) as n, "
    "sum((x2 - x1) * (y2 - y1)) as area from b group by all",
    "label cell n",
)
def box_grid(spark, sf):
    return boxes(spark, sf).groupBy("label", S.grid_cell(F.col("cx"), F.col("cy")).alias("cell")).agg(F.count("*").alias("n"), F.sum(S.box_area(F.col("box"))).alias("area"))


@query(
    "q_iou",
    f"""with b as ({BOXES}), p as (select a.vec_id, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as i, (a.x2 - a.x1) * (a.y2 - a.y1) as s, (b.x2 - b.x1) * (b.y2 - b.y1) as t from b a join b on b.vec_id = a.vec_id + 1)
    select vec_id, case when s + t - i = 0 then 0 else i / (s + t - i) end as iou from p""",
    "vec_id",
)
def iou(spark, sf):
    b = boxes(spark, sf)
    return b.join(b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("box").alias("other")), "vec_id").select("vec_id", S.overlap_ratio(F.col("box"), F.col("other")).alias("iou"))


@query(
    "q_largest_box",
    f"with b as ({BOXES}) select label, arg_min(vec_id, {{'a': -((x2 - x1) * (y2 - y1)), 'b': vec_id}}) as vec_id from b group by 1",
)
def largest_box(spark, sf):
    b = boxes(spark, sf).groupBy("label").agg(F.min(F.struct((-S.box_area(F.col("box"))).alias("a"), F.col("vec_id").alias("v"))).alias("least"))
    return b.select("label", F.col("least.v").alias("vec_id"))


CORNERS = "struct_pack(x1 := least(e[{0}], e[{2}])::double, y1 := least(e[{1}], e[{3}])::double, x2 := greatest(e[{0}], e[{2}])::double, y2 := greatest(e[{1}], e[{3}])::double)"
AREA = "greatest({0}.x2 - {0}.x1, 0) * greatest({0}.y2 - {0}.y1, 0)"
MEET = "greatest(least(r.kept.x2, b.x2) - greatest(r.kept.x1, b.x1), 0) * greatest(least(r.kept.y2, b.y2) - greatest(r.kept.y1, b.y1), 0)"
LARGEST = f"list_aggregate(list_transform(d, lambda b: struct_pack(s := {AREA.format('b')}, b := b)), 'max').b"
RATIO = f"coalesce({MEET} / nullif({AREA.format('r.kept')} + {AREA.format('b')} - {MEET}, 0), 0)"


@query(
    "q_carried_lead",
    f"""with recursive f as (select label, vec_id, row_number() over (partition by label order by vec_id) as i, [{", ".join(CORNERS.format(*range(k, k + 4)) for k in (1, 5, 9))}] as d from (select label, vec_id, embedding as e from embeddings)),
    r as (select label, vec_id, i, {LARGEST} as kept from f where i = 1
      union all select f.label, f.vec_id, f.i, case when near.s >= 0.1 then near.b else {LARGEST} end from r join f on f.label = r.label and f.i = r.i + 1, lateral (select list_aggregate(list_transform(f.d, lambda b: struct_pack(s := {RATIO}, b := b)), 'max') as near))
    select vec_id, kept.x1 as x1, kept.y1 as y1, kept.x2 as x2, kept.y2 as y2 from r""",
    "vec_id",
)
def carried_lead(spark, sf):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    box = lambda k: F.struct(F.least(e(k), e(k + 2)).alias("x1"), F.least(e(k + 1), e(k + 3)).alias("y1"), F.greatest(e(k), e(k + 2)).alias("x2"), F.greatest(e(k + 1), e(k + 3)).alias("y2"))
    rows = table(spark, sf, "embeddings").select("label", "vec_id", F.array(box(0), box(4), box(8)).alias("boxes"))
    return frames.carried_leads(rows, "label", "vec_id", "boxes").select("vec_id", "lead.*")


@query(
    "q_label_order",
    "select label, row_number() over (order by case label when 'view' then 1 when 'click' then 2 else 3 end, label) as place "
    "from (select distinct event_type as label from events)",
)
def label_order(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("label")).distinct()
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*S.label_order(F.col("label"), ["view", "click"]))).cast("long"))


@query(
    "q_contract_violations",
    """select 'orders key' as rule, count(*) as n from (select o_orderkey from orders group by 1 having count(*) > 1) union all select 'customers of orders', count(*) from orders where o_custkey not in (select c_custkey from customer)
    union all select 'labels of documents', count(*) from labels where doc_id not in (select doc_id from documents)""",
)
def contract_violations(spark, sf):
    o, c, d, labels = (table(spark, sf, x) for x in ("orders", "customer", "documents", "labels"))
    parts = [("orders key", O.duplicates(o, ["o_orderkey"])), ("customers of orders", o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti")), ("labels of documents", labels.join(d, "doc_id", "left_anti"))]
    out = None
    for name, rows in parts:
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out
