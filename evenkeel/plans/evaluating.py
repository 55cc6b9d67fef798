"""Splits, encoding, models and metrics over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evenkeel.operators import evaluation as V
from evenkeel.operators import modelling as M

from .base import query, scratch_dir, table

GUESS = "case when d.n_chars > 1500 then 1 else 0 end"


def guesses(spark, sf):
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return labels.join(d.select("doc_id", "n_chars", "lang"), "doc_id").select("doc_id", "lang", F.col("quality").alias("truth"), (F.col("n_chars") > 1500).cast("int").alias("pred"))


G = f"g as (select l.doc_id, d.lang, l.quality as truth, {GUESS} as pred from labels l join documents d using (doc_id))"
CLASSES = "c as (select v.cls as class, count(*) filter (truth = v.cls and pred = v.cls) as h, count(*) filter (truth = v.cls) as s, count(*) filter (pred = v.cls) as p from g, (select distinct unnest([truth, pred]) as cls from g) v group by 1), m as (select class, case when p = 0 then 0 else h::double / p end as precision, case when s = 0 then 0 else h::double / s end as recall, case when s + p = 0 then 0 else 2.0::double * h / (s + p) end as f1, s as support, h from c)"


def greedy_sql(group: str, parts: dict[str, float], name: str) -> str:
    """The greedy split row by row: largest group first, each to the part that is least filled against its target."""
    cols = [f"p{k}" for k in range(len(parts))]
    ratio = [f"{c} / ({f!r}::double * total)" for c, f in zip(cols, parts.values())]
    pick = "case " + " ".join(f"when {' and '.join(f'{ratio[k]} <= {r}' for r in ratio)} then {k}" for k in range(len(parts) - 1)) + f" else {len(parts) - 1} end"
    add = ", ".join(f"{c} + case when w = {k} then n else 0 end" for k, c in enumerate(cols))
    label = "case w " + " ".join(f"when {k} then '{p}'" for k, p in enumerate(parts)) + " end"
    return (
        f"with recursive s as (select {group} as g, count(*) as n, row_number() over (order by count(*) desc, {group}::varchar) as i, sum(count(*)) over ()::bigint as total from orders group by 1), "
        f"r as (select 0::bigint as i, null::bigint as g, 0::bigint as n, null::int as w, {', '.join(f'0::bigint as {c}' for c in cols)} "
        f"union all select i, g, n, w, {add} from (select s.i, s.g, s.n, ({pick})::int as w, {', '.join(cols)} from r join s on s.i = r.i + 1)) "
        f"select g as {group}, {label if name == 'split' else 'w'} as {name}{', n as n_rows' if name == 'split' else ''} from r where i > 0"
    )


PARTS = {"train": 0.6, "val": 0.2, "test": 0.2}


@query("q_group_split", greedy_sql("o_custkey", PARTS, "split"))
def group_split(spark, sf):
    return V.assign_groups(table(spark, sf, "orders"), "o_custkey", PARTS)


@query("q_split_disjoint", "select 0::bigint as violations, count(distinct o_custkey) as n_groups, count(*) as n_rows from orders")
def split_disjoint(spark, sf):
    a = V.assign_groups(table(spark, sf, "orders"), "o_custkey", {"train": 0.6, "val": 0.2, "test": 0.2})
    bad = V.split_violations(a, "o_custkey").agg(F.count("*").alias("violations"))
    return bad.crossJoin(a.agg(F.count("*").alias("n_groups"), F.sum("n_rows").alias("n_rows")))


@query("q_group_kfold", greedy_sql("o_custkey", {str(k): 1.0 for k in range(5)}, "fold"))
def group_kfold(spark, sf):
    return V.group_folds(table(spark, sf, "orders"), "o_custkey", 5)


@query(
    "q_logo_folds",
    "select a.n_name as held_out, count(*) filter (b.n_name = a.n_name) as n_test, count(*) filter (b.n_name <> a.n_name) as n_train "
    "from nation a, (select n_name from customer join nation on c_nationkey = n_nationkey) b group by 1",
)
def logo_folds(spark, sf):
    n = table(spark, sf, "nation")
    sizes = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    rows = n.join(sizes, n.n_nationkey == sizes.c_nationkey, "left").select(F.col("n_name").alias("held_out"), F.coalesce("n", F.lit(0)).alias("n_test"))
    return rows.withColumn("n_train", F.sum("n_test").over(Window.partitionBy()) - F.col("n_test"))


@query("q_rare_collapse", "select p_partkey, case when count(*) over (partition by p_type) < 14 then 'other' else p_type end as label from part")
def rare_collapse(spark, sf):
    return V.collapse_rare(table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("label")), "label", 14)


@query(
    "q_one_hot",
    "select event_id, (event_type = 'click')::int::double as click, (event_type = 'error')::int::double as error, "
    "(event_type = 'view')::int::double as view from events",
    "event_id",
)
def one_hot(spark, sf):
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for c, n in zip(V.one_hot("event_type", ["click", "error", "view"]), ("click", "error", "view"))])


@query(
    "q_median_impute",
    "with m as (select median(value) as m from events where event_id % 3 = 0 and event_type <> 'error') "
    "select event_id, case when event_type = 'error' then (select m from m) else value end as value from events where event_id % 3 <> 0",
    "event_id",
)
def median_impute(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    _, test = V.encode(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), ["value"], [])
    return test.select("event_id", F.col("x0").alias("value"))


@query("q_confusion", f"with {G} select truth, pred, count(*) as n from g group by all")
def confusion(spark, sf):
    return V.confusion(guesses(spark, sf), "truth", "pred")


@query("q_per_class", f"with {G}, {CLASSES} select class, precision, recall, f1, support from m", "class support")
def per_class(spark, sf):
    return V.per_class(guesses(spark, sf), "truth", "pred")


@query(
    "q_cls_metrics",
    f"with {G}, {CLASSES} select avg(recall) filter (support > 0) as balanced_acc, avg(f1) as macro_f1, "
    "sum(h)::double / sum(support) as acc, sum(support)::bigint as n_test from m",
    "n_test",
)
def cls_metrics(spark, sf):
    return V.class_metrics(guesses(spark, sf), "truth", "pred")


REG = "r as (select o_orderstatus as fold, o_totalprice as y, avg(o_totalprice) over (partition by o_orderpriority) as p from orders)"


@query(
    "q_reg_metrics",
    f"with {REG} select fold, avg(abs(y - p)) as mae, 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) as r2 "
    "from r group by 1",
    "fold",
    4,
)
def reg_metrics(spark, sf):
    return regression(spark, sf).groupBy("fold").agg(*V.regression_metrics(F.col("y"), F.col("p")))


def regression(spark, sf):
    o = table(spark, sf, "orders")
    means = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("p"))
    return o.join(means, "o_orderpriority").select(F.col("o_orderstatus").alias("fold"), F.col("o_totalprice").alias("y"), "p")


@query(
    "q_fold_mean_vs_pooled",
    f"with {REG}, f as (select fold, avg(abs(y - p)) as mae from r group by 1) select (select avg(mae) "
    "from f) as fold_mean, avg(abs(y - p)) as pooled from r",
    "-",
    4,
)
def fold_mean(spark, sf):
    r = regression(spark, sf)
    mae = F.avg(F.abs(F.col("y") - F.col("p")))
    return r.groupBy("fold").agg(mae.alias("m")).agg(F.avg("m").alias("fold_mean")).crossJoin(r.agg(mae.alias("pooled")))


@query("q_stratum_metrics", f"with {G} select lang, avg((truth = pred)::int::double) as acc, count(*) as n from g group by 1", "lang n")
def stratum_metrics(spark, sf):
    return guesses(spark, sf).groupBy("lang").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("acc"), F.count("*").alias("n"))


def customer_features(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"))
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    return c.select("c_custkey", "n_orders", "mean_price", "c_acctbal", (F.col("c_nationkey") % 2).cast("double").alias("label"), (F.col("c_nationkey") % 3).alias("fold"))


CUSTOMERS = "f as (select c_custkey, count(*)::double as n_orders, avg(o_totalprice) as mean_price, any_value(c_acctbal)::double as c_acctbal, any_value(c_nationkey) % 3 as fold from customer join orders on o_custkey = c_custkey group by 1)"


@query(
    "q_cv_models",
    f"""with {CUSTOMERS}, w as (select k.fold, regr_slope(mean_price, n_orders) as b, regr_intercept(mean_price, n_orders) as a from f, (select distinct fold from f) k where f.fold <> k.fold group by 1),
    p as (select mean_price as y, w.a + w.b * n_orders as p from f join w using (fold))
    select avg(abs(y - p)) as mae, 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) as r2, count(*) as n_test from p""",
    "n_test",
    4,
)
def cv_models(spark, sf):
    """Out-of-fold predictions of a line, all folds pooled."""
    rows, features = customer_features(spark, sf), M.Features(("n_orders",), (), "fold")
    out = None
    for k in range(3):
        ready = M.prepare(rows, features, "mean_price")
        part, _ = M.fit_and_predict(ready.where(F.col("fold") != k), ready.where(F.col("fold") == k), features, "line")
        out = part if out is None else out.unionByName(part)
    return out.agg(*V.regression_metrics(F.col("label"), F.col("prediction")), F.count("*").alias("n_test"))


def ridge_sql(folds: str, train: str) -> str:
    """Ridge on n_orders and c_acctbal for mean_price, by the normal equations of standardised columns, for each fold of
    `folds`, from the rows of f that `train` lets in; the penalty by leave-one-out errors with each row's own weight."""
    return f"""t as (select k.fold as k, f.*, c_acctbal as u, n_orders as v, mean_price as y from f, {folds} k where {train}),
    m as (select k, count(*) as n, avg(v) as mv, avg(u) as mu, avg(y) as my, stddev_pop(v) as sv, stddev_pop(u) as su from t group by 1),
    z as (select t.k, (v - mv) / sv as a, (u - mu) / su as b, y - my as y, n from t join m on t.k = m.k),
    g as (select k, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as yb from z group by 1),
    p as (select g.*, alpha, (aa + alpha) * (bb + alpha) - ab * ab as det from g, (select unnest([0.1, 1.0, 10.0])::double as alpha)),
    s as (select k, alpha, det, aa + alpha as p, bb + alpha as q, ab, ((bb + alpha) * ay - ab * yb) / det as wa, ((aa + alpha) * yb - ab * ay) / det as wb from p),
    e as (select s.k, s.alpha, avg(power((y - a * wa - b * wb) / (1 - (1.0::double / n + (a * a * q - 2 * a * b * ab + b * b * p) / det)), 2)) as loo
        from z join s on z.k = s.k group by 1, 2),
    best as (select k, arg_min(alpha, loo) as alpha from e group by 1),
    w as (select s.k as k, s.alpha, wa / sv as wv, wb / su as wu, my - wa / sv * mv - wb / su * mu as w0 from s join best on s.k = best.k and s.alpha = best.alpha join m on s.k = m.k)"""


@query(
    "q_ridge_folds",
    f"""with {CUSTOMERS}, {ridge_sql("(select distinct fold from f)", "f.fold <> k.fold")},
    r as (select f.fold, alpha, mean_price as y, w0 + wv * n_orders + wu * c_acctbal as p from f join w on w.k = f.fold)
    select fold::bigint as fold, any_value(alpha) as alpha, avg(abs(y - p)) as mae, 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) as r2, count(*) as n_test from r group by 1""",
    "fold n_test",
    4,
)
def ridge_folds(spark, sf):
    """Each fold's ridge regression, its penalty chosen by leave-one-out error."""
    return M.evaluate_ridge(customer_features(spark, sf), ["n_orders", "c_acctbal"], "mean_price", "fold")


@query("q_batch_score", f"with {CUSTOMERS}, {ridge_sql('(select 0 as fold)', 'f.fold <> 0')} select c_custkey, w0 + wv * n_orders + wu * c_acctbal as prediction from f, w where f.fold = 0", "c_custkey", 4)
def batch_score(spark, sf):
    rows = customer_features(spark, sf)
    model = V.MODELS["ridge"](["n_orders", "c_acctbal"], "mean_price").fit(rows.where("fold <> 0"))
    return model.transform(rows.where("fold = 0")).select("c_custkey", "prediction")


KEPT = f"""{CUSTOMERS}, x as (select f.*, c_mktsegment as seg from f join customer using (c_custkey)),
    med as (select median(case when c_acctbal > 0 then c_acctbal end) as m from x where fold <> 0),
    q as (select c_custkey, fold, mean_price as y, coalesce(case when c_acctbal > 0 then c_acctbal end, m) as v from x, med),
    w as (select regr_slope(y, v) as b, regr_intercept(y, v) as a from q where fold <> 0)"""


@query("q_kept_score", f"with {KEPT} select c_custkey, a + b * v as prediction from q, w where fold = 0", "c_custkey", 4)
def kept_score(spark, sf):
    """A line with its encoder, fitted, written, loaded, and used on raw rows; the median of training stands for debts."""
    import uuid

    rows = customer_features(spark, sf).withColumn("balance", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    features = M.Features(("balance",), (), "fold")
    fitted = M.fit(M.prepare(rows, features, "mean_price").where("fold <> 0"), features, "line")
    path = f"{scratch_dir(spark)}/kept-{uuid.uuid4().hex}"
    M.keep_model(fitted, path=path)
    return M.predict(spark, path, rows.where("fold = 0").select("c_custkey", "balance")).select("c_custkey", "prediction")


@query("q_boosted_classes")
def boosted_classes(spark, sf):
    """The language of held-out documents by trees over shares of letters; no SQL grows trees, tests hold them against a rebuild."""
    d = table(spark, sf, "documents").where("text is not null and lang is not null")
    share = lambda letters: (F.length("text") - F.length(F.translate("text", letters, ""))) / F.greatest(F.length("text"), F.lit(1))
    d = d.select("doc_id", *[share(x).alias(n) for n, x in {"w": "wyk", "umlauts": "äöüß", "cedilla": "çèêà", "tilde": "ñóíá", "e": "e", "o": "o", "n": "n"}.items()], F.col("lang").alias("label"))
    features = M.Features(("w", "umlauts", "cedilla", "tilde", "e", "o", "n"))
    scored, _ = M.fit_and_predict(d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0"), features, "auto", "classification")
    return scored.select("doc_id", F.col("label").alias("lang"), "prediction")


LINE = "f as (select c.c_custkey, c.c_mktsegment as g, count(*)::double as x, avg(o.o_totalprice) as y from customer c join orders o on o.o_custkey = c.c_custkey group by 1, 2)"
FITS = f"{LINE}, k as (select g, dense_rank() over (order by g) - 1 as fold from (select distinct g from f)), w as (select k.fold, regr_slope(f.y, f.x) as b, regr_intercept(f.y, f.x) as a from f, k where f.g <> k.g group by 1)"


def segments(spark, sf):
    rows = customer_features(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return rows, M.Features(("n_orders", "absent"), (), "c_mktsegment")


@query(
    "q_leave_one_out",
    "select g as c_mktsegment, (dense_rank() over (order by g) - 1)::int as fold from (select distinct c_mktsegment as g from customer)",
)
def leave_one_out(spark, sf):
    return M.leave_one_out(table(spark, sf, "customer"), "c_mktsegment")


@query(
    "q_evaluate",
    f"""with {FITS}, p as (select k.fold, f.y, w.a + w.b * f.x as p from f join k using (g) join w using (fold)),
    m as (select fold, avg(abs(y - p)) as mae, 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) as r2, count(*)::double as n_test from p group by 1)
    select fold::int as fold, metric, value from m unpivot (value for metric in (mae, r2, n_test))""",
    "fold metric",
    4,
)
def evaluate(spark, sf):
    """A closed-form line for each left-out segment, and its errors."""
    rows, features = segments(spark, sf)
    found = M.evaluate(M.prepare(rows, features, "mean_price"), M.leave_one_out(rows, "c_mktsegment"), features.of(rows), "line", "regression")
    return found.rows(spark)


@query(
    "q_score_line",
    f"with {LINE}, w as (select regr_slope(y, x) as b, regr_intercept(y, x) as a from f where g <> 'BUILDING') "
    "select c_custkey, a + b * x as prediction from f, w where g = 'BUILDING'",
    "c_custkey",
    4,
)
def score_line(spark, sf):
    rows, features = segments(spark, sf)
    rows = M.prepare(rows, features, "mean_price", keep=("c_custkey",))
    scored, _ = M.fit_and_predict(rows.where("c_mktsegment <> 'BUILDING'"), rows.where("c_mktsegment = 'BUILDING'"), features.of(rows), "line")
    return scored.select("c_custkey", "prediction")


@query(
    "q_split_summary",
    f"""with r as ({greedy_sql("o_custkey", PARTS, "split")}), d as (select o.*, r.split from orders o join r using (o_custkey)),
    s as (select split, count(distinct o_custkey) as n_groups, count(*) as n_rows from d group by 1)
    select s.split, n_groups, n_rows, n_rows / (select count(*) from d) as row_share, o_orderstatus as class, count(*) as n, count(*) / n_rows as class_share
    from d join s using (split) group by s.split, n_groups, n_rows, o_orderstatus""",
    "split n_groups n_rows class n",
)
def split_summary(spark, sf):
    o = table(spark, sf, "orders")
    return M.split_summary(o, V.assign_groups(o, "o_custkey", PARTS), "o_custkey", "o_orderstatus")
