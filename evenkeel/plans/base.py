"""What the catalogue's modules share: a registry, tables, the events as signals, rounding on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR = 3_600_000_000
#: Grid of 6 hours over 30 days; windows of 84 hours that end every 12 hours.
STEP, POINTS = 6 * HOUR, 120
WIDTH, STRIDE, FIRST, LAST = 84 * HOUR, 12 * HOUR, 7, 60

EV = "ev as (select user_id as k, (epoch_us(ts) - epoch_us(timestamp '2024-01-01'))::bigint as u, value as v, event_type as e, event_id as id from events)"
#: Rows of every window that holds them.
WIN = f"{EV}, d as (select j from (select unnest(range({FIRST}, {LAST + 1})) as j)), win as (select k, j, u, v, e, id from ev join d on u between j * {STRIDE}::bigint - {WIDTH} and j * {STRIDE}::bigint)"
#: Made-up sensor signals of an event.
SIGNALS = {
    "t": f"u / {HOUR}.0D", "speed": "v / 20", "accel": "(v - 245) / 60", "steer_angle": "v - 245", "steer_torque": "v * 1.5D", "cruise": "v / 10", "curvature": "v / 1000", "desired_curvature": "-v / 900",
    "lead_status": "case when e in ('view', 'click', 'purchase') then 1.0D else 0.0D end", "d_rel": "v / 8", "v_rel": "cast(id % 9 - 6 as double)",
    "left_prob": "case when e <> 'error' then v / 500 end", "right_prob": "case when e <> 'signup' then v / 600 end", "fcw": "case when e = 'error' then 1.0D else 0.0D end",
}


def in_duckdb(expression: str) -> str:
    return expression.replace("0D", "0::double").replace("5D", "5::double")


def query(name: str, sql: str | None = None, keep: str = "", digits: int = 9):
    """Registers a query; of both results, doubles are rounded. keep: the SQL's columns that aren't doubles, `-` for none."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(f"`{c.name}`"), digits) + F.lit(0.0)).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(f"`{c.name}`") for c in df.schema])

        QUERIES[name] = run
        if sql and keep:
            kept = [c for c in keep.split() if c != "-"]
            others = f"* exclude ({', '.join(kept)})" if kept else "*"
            SQL[name] = f"with result as ({sql}) select {''.join(f'{c}, ' for c in kept)}round(columns({others})::double, {digits}) + 0.0::double from result"
        elif sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, u, v, e, id): key, ticks since 2024-01-01, value, kind, id."""
    u = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), u.alias("u"), F.col("value").alias("v"), F.col("event_type").alias("e"), F.col("event_id").alias("id"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evenkeel.operators.timeline import sliding

    return sliding(events(spark, sf_dir), "u", WIDTH, STRIDE, FIRST, LAST)


def with_signals(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.expr(x).alias(c) for c, x in SIGNALS.items()])


def scratch_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: that of spark.checkpoint.dir, or the warehouse where it is unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    return (at or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
