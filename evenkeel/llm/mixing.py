"""Operator 1: mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SEED = "mix-1"
#: Rows of a source that one task orders, and ranges at most into which a source's order is cut.
ROWS_A_BUCKET, BUCKETS = 200, 1 << 20
#: Ranges into which virtual time is cut, to find the one in which the budget is used up.
RANGES = 1 << 16


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    One row for each source is all that comes together here. Filled like vessels: a source whose
    limit of most * size is met early stops there, the rest share what is left by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    limit = F.col("source_size") * F.lit(float(most))
    # in the order in which limits are met: what stopped sources hold, and the weight of the others
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (
        w.withColumn("held", F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("source_size").over(every) * F.lit(share) - F.col("held"))
        .withColumn("stops", limit * F.col("open") <= F.col("left") * F.col("weight"))
    )
    met = F.col("stops").cast("int")
    w = w.withColumn("n_stops", F.sum(met).over(every)).withColumn("place", F.row_number().over(full))
    first = F.when(F.col("place") == F.col("n_stops") + 1, F.struct("left", "open"))
    w = w.withColumn("rest", F.max(first).over(every))
    # the same division for every open source, as the reference SQL has it
    return w.select(
        "source", "source_size", "weight",
        F.when(F.col("stops"), limit).otherwise(F.col("rest.left") * F.col("weight") / F.col("rest.open")).alias("target"),
    )


def mix(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, most: int = MOST, carry: tuple = ()) -> DataFrame:
    """Which documents a mix of share * all words takes, and in which order.

    Within its source a document's place is that of a seeded hash of its id and text. It is finished
    at the virtual time (words of its source up to its own end) / weight, and once more for each
    further pass over the source, `most` in all. The mix takes passes over documents in order of that
    time until the whole words of share * all words are used up; of the pass at the cut it takes
    what is left. So sources come near their targets, which say where the cut leaves them.

    Needs doc_id, text and source of docs, whose other columns are ignored. Null text: size 0,
    taken 0. Null source: a source of its own, the last. Rows with equal or null doc_id are
    separate documents. No rows: no rows. Returns doc_id, source, size, source_size, target,
    finish (of the first pass), taken, and the columns of docs named in carry.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    rows = docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("of"), size.alias("size"), key.alias("key"), *carry)
    rows = durable(rows)
    totals = durable(rows.groupBy("of", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    largest = totals.agg(F.max("n")).first()[0] or 0
    buckets = 1
    while buckets * ROWS_A_BUCKET < largest and buckets < BUCKETS:
        buckets *= 2
    # a source's order is cut into ranges of the hash, so that no task orders a whole source
    rows = rows.withColumn("bucket", F.expr(f"cast(conv(substr(key, 1, 5), 16, 10) as long) * {buckets} div {BUCKETS}"))
    ranges = rows.groupBy("of", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("of", "bucket", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("earlier"))
    targets = source_targets(totals.select("source", "source_size"), weights, share, most)
    targets = targets.withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    ranges = durable(ranges.join(targets, "of"))
    within = Window.partitionBy("of", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("size").over(within)).join(ranges, ["of", "bucket"])
    rows = durable(rows.withColumn("end", F.col("end") + F.col("earlier")).withColumn("finish", F.col("end") / F.col("weight")))

    names = ["time", "of", "key", "doc_id", "size", "pass"]
    passes = [((F.col("end") + F.lit(e) * F.col("source_size")) / F.col("weight")).alias("time") for e in range(most)]
    each = rows.where("size > 0").select("of", "key", "doc_id", "size", F.posexplode(F.array(*passes)).alias("pass", "time"))
    whole, size = totals.agg(F.floor(F.sum("source_size") * F.lit(share)), F.max("source_size")).first()
    taken = taken_upto(each, names, whole or 0, most * (size or 1) / min(weights) / RANGES)
    parts = []
    for e, passed in enumerate(passes):
        mine = F.struct(passed, "of", "key", "doc_id", "size", F.lit(e).alias("pass"))
        parts.append(taken(mine))
    return rows.select("doc_id", "source", "size", "source_size", "target", "finish", F.when(F.col("size") > 0, sum(parts[1:], parts[0])).otherwise(F.lit(0)).cast("long").alias("taken"), *carry)


def taken_upto(each: DataFrame, names: list[str], budget: int, width: float):
    """The words that a budget takes of a pass, given as a struct of `names`, in order of which it is used up.

    Sums over ranges of the first name say in which range the budget ends; only that range's passes are put in
    order one by one. The pass at the cut gives what is left.
    """
    each = each.withColumn("range", F.floor(F.col(names[0]) / F.lit(width)).cast("long"))
    upto = F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    summed = each.groupBy("range").agg(F.sum("size").alias("words")).withColumn("upto", upto)
    cut = summed.where(F.col("upto") >= budget).orderBy("range").first() if budget else None
    if cut is None:
        return lambda mine: mine["size"] if budget else F.lit(0)
    left = budget - cut.upto + cut.words
    begun = F.coalesce(F.sum("size").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = each.where(F.col("range") == cut.range).withColumn("begun", begun).where(F.col("begun") < left)
    end = last.orderBy(*[F.desc(c) for c in names]).first()
    kinds = dict(each.dtypes)
    theirs = F.struct(*[F.lit(end[c]).cast(kinds[c]).alias(c) for c in names])
    part = min(end.size, left - end.begun)
    return lambda mine: F.when(mine < theirs, mine["size"]).when(mine == theirs, F.lit(part)).otherwise(F.lit(0))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "finish", "taken")


def mixed_documents(docs: DataFrame, **kinds) -> DataFrame:
    """The mix itself, in its order: columns of mix() for documents of which some words are taken, with the number of passes."""
    found = mix(docs, **kinds).where("taken > 0").withColumn("passes", F.ceil(F.col("taken") / F.col("size")).cast("int"))
    return found.orderBy("finish", "doc_id")


def mixed_texts(docs: DataFrame, **kinds) -> DataFrame:
    """mixed_documents() with each document's text, in the order of the mix.

    taken adds up to the budget. The text is whole; of the last pass
    the mix has its first taken - (passes - 1) * size words.
    """
    named = docs.select("doc_id", "source", "text").withColumn("text_hash", F.xxhash64("text"))
    mixed = durable(mixed_documents(named, carry=("text_hash",), **kinds))
    texts = named.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "text").dropDuplicates(["id", "h"])
    out = mixed.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h")))
    return out.drop("id", "h", "text_hash").orderBy("finish", "doc_id")


SQL = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
        md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as key from documents),
t as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from t),
h as (select *, coalesce(sum(2.0::double * source_size) over f, 0) as held, sum(weight) over () - coalesce(sum(weight) over f, 0) as open,
        sum(source_size) over () * 1.5::double as budget
    from w window f as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
s as (select *, 2.0::double * source_size * open <= (budget - held) * weight as stops,
        row_number() over (order by source_size / weight, source nulls last) as place from h),
r as (select (budget - held) as lft, open as opn from s where place = (select count(*) filter (stops) + 1 from s)),
g as (select source, source_size, weight, case when stops then 2.0::double * source_size else (select lft from r) * weight / (select opn from r) end as target from s),
e as (select d.*, g.source_size, g.target, g.weight, sum(size) over (partition by d.source order by key, doc_id, size rows unbounded preceding) as ends
    from d join g on d.source is not distinct from g.source),
p as (select *, (ends + pass * source_size) / weight as t from e, (values (0), (1)) as x(pass) where size > 0),
b as (select *, coalesce(sum(size) over (order by t, source nulls first, key, doc_id nulls first, size, pass rows between unbounded preceding and 1 preceding), 0) as begun,
        floor((select sum(source_size) from t) * 1.5::double) as budget from p),
k as (select doc_id, key, source, sum(least(size, greatest(budget - begun, 0))) as taken from b group by all)
select e.doc_id, size, source_size, target, ends / weight as finish, coalesce(taken, 0)::bigint as taken
from e left join k on e.doc_id is not distinct from k.doc_id and e.key = k.key and e.source is not distinct from k.source
"""
