"""Readers. All work through Spark, so any file system that Spark knows will do."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.scalars import finite, to_flag, to_number

#: Optional fields of a recording's side-car file (names of the file format).
META = "log_kind string, log_hz double, vid_kind string, camera_fps double, clip_dur_s double, clip_start_s double, video_time_s double, event_mono long"
#: Continuous and boolean columns of each topic (names of the file format).
TOPICS = {
    "carState": (["vEgo", "aEgo", "steeringAngleDeg", "steeringTorque", "cruiseState.speed"], ["steeringPressed", "brakePressed", "gasPressed", "cruiseState.enabled", "standstill"]),
    "controlsState": (["curvature", "desiredCurvature", "vCruise"], ["enabled", "active"]),
    "carControl": (["actuators.accel", "actuators.torque", "actuators.curvature"], ["latActive", "longActive"]),
    "radarState": (["leadOne.dRel", "leadOne.vRel", "leadOne.vLead", "leadOne.aLeadK", "leadTwo.dRel", "leadTwo.vRel"], ["leadOne.status", "leadTwo.status"]),
    "longitudinalPlan": (["aTarget"], ["hasLead", "fcw", "shouldStop"]),
    "drivingModelData": (["laneLineMeta.leftProb", "laneLineMeta.rightProb", "action.desiredCurvature", "action.desiredAcceleration"], []),
}
KEY = ["car_model", "driver", "route", "clip_id_pub"]


def with_key(df: DataFrame, depth_from_end: int = 2) -> DataFrame:
    """Adds the key that a file's folders spell out: .../car_model/driver/route/clip/file."""
    parts = F.split(F.input_file_name(), "/")
    part = lambda k: F.url_decode(F.element_at(parts, F.lit(-k)))
    return df.withColumns({"car_model": part(depth_from_end + 3), "driver": part(depth_from_end + 2), "route": part(depth_from_end + 1), "clip_id_pub": part(depth_from_end).try_cast("long")})


#: What stands before a path, with one slash or three for local files.
SCHEME = "^[A-Za-z0-9+.-]+:/+"


def below(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(value, path): files of a name four folders below root, each as one text; an empty root gives none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = re.sub(SCHEME, "", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()).rstrip("/")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True)
    files = reader.text(root, wholetext=True).withColumn("path", F.input_file_name())
    return files.where(F.size(F.split(F.regexp_replace("path", SCHEME, ""), "/")) == len(whole.split("/")) + 5)


def split_fields(line):
    """The fields of a line of CSV: commas and doubled quotes inside quotes belong to a field; blanks around it don't."""
    quoted = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')

    def plain(field):
        field = F.trim(field)
        inner = F.regexp_replace(F.substring(field, F.lit(2), F.greatest(F.length(field) - 2, F.lit(0))), '""', '"')
        return F.trim(F.when(field.startswith('"') & field.endswith('"') & (F.length(field) > 1), inner).otherwise(field))

    return F.when(F.contains(line, F.lit('"')), F.transform(quoted, plain)).otherwise(F.transform(F.split(line, ","), lambda x: F.trim(x)))


def clip_index(spark: SparkSession, root: str) -> DataFrame:
    """A row for each side-car file four folders down; one that can't be read gives nulls."""
    rows = with_key(below(spark, root, "meta.json")).withColumn("meta", F.from_json("value", T.StructType.fromDDL(META), {"mode": "PERMISSIVE"}))
    return rows.where("clip_id_pub is not null").select(*KEY, "meta.*")


def topic_lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(key, path, header, line): the lines of one topic's files, each with its own file's header.

    A file is a recording's stretch of some seconds, and is read whole. Files that can't be read are
    left out; there may be none.
    """
    files = with_key(below(spark, root, f"{name}.csv")).withColumn("lines", F.split(F.regexp_replace("value", "^\ufeff", ""), "\r?\n"))
    rows = files.select(*KEY, "path", split_fields(F.get("lines", F.lit(0))).alias("header"), F.explode_outer(F.slice("lines", 2, 2**31 - 2)).alias("line"))
    return rows.withColumn("line", F.when(F.trim("line") != "", split_fields(F.col("line"))))


def topic(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of one topic of all recordings: key, time_s, continuous columns as numbers and flags as 0/1.

    Columns are found by each file's own header: files may have others, or have them in another
    order. Dots become underscores, columns that a file hasn't are null, rows without a time are left out;
    no file of the topic: no rows.
    """
    numbers, flags = TOPICS[name]
    rows = topic_lines(spark, root, name).where("line is not null")

    def value(c: str):
        at = F.array_position("header", c)
        return F.when(at > 0, F.get("line", (at - 1).cast("int")))

    has = lambda c: F.array_contains("header", c)
    out = [F.col(c) for c in KEY] + [to_number(value("time_s")).alias("time_s")]
    out += [to_number(value(c)).alias(c.replace(".", "_")) for c in numbers]
    out += [F.when(has(c), to_flag(value(c))).alias(c.replace(".", "_")) for c in flags]
    return rows.select(*out).where("time_s is not null")


def topic_report(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(key, path, n_lines, n_rows, readable): of each file, how many lines have a time; readable if there is a time column."""
    rows = topic_lines(spark, root, name)
    at = F.array_position("header", "time_s")
    timed = (at > 0) & to_number(F.get("line", (at - 1).cast("int"))).isNotNull()
    return rows.groupBy(*KEY, "path").agg(F.count("line").alias("n_lines"), F.count_if(timed).alias("n_rows"), F.max(F.array_contains("header", "time_s")).alias("readable"))


def lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def json_record(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A pretty-printed JSON file; corrupt ones give a row of nulls if there is a schema."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def retained_frames(df: DataFrame, fps: str, target: float, first: float = -10.0, last: float = 10.0) -> DataFrame:
    """The frames that decoding to a target rate keeps: every k-th, within the closed range of relative times."""
    rate = F.coalesce(F.when(finite(F.col(fps)) > 0, F.col(fps)), F.lit(20.0))
    step = F.greatest(F.lit(1), F.round(rate / target).cast("int"))
    rows = df.withColumn("t_rel", F.col("frame_idx") / rate - 10.0)
    return rows.where((F.col("frame_idx") % step == 0) & F.col("t_rel").between(first, last))
