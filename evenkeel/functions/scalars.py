"""Row-wise expressions. Null is the one marker of a missing value; NaN and infinities become null at the door."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as true, after trimming and lower-casing.
TRUE_TEXTS = ("true", "1", "1.0", "yes")
#: How a missing category is named.
MISSING = "<NA>"


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def to_number(c: Column) -> Column:
    """Text to double; null where it is none."""
    return finite(c.try_cast("double"))


def to_flag(c: Column) -> Column:
    """1.0 for a true text, 0.0 for any other and for null."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_TEXTS), F.lit(False)).cast("double")


def category(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive regular expression search; a null text doesn't match."""
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def composite_key(*parts: Column) -> Column:
    """Parts joined by '/'; null if any part is."""
    joined = [parts[0].cast("string")]
    for p in parts[1:]:
        joined += [F.lit("/"), p.cast("string")]
    return F.concat(*joined)


def clipped(c: Column, low: float, high: float) -> Column:
    """Within [low, high]; null stays null (least and greatest skip nulls)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def closing_speed(relative: Column) -> Column:
    return F.when(relative < -0.5, -relative)


def time_to_collision(gap: Column, closing: Column) -> Column:
    return positive(F.when((gap > 5) & (closing > 0), F.try_divide(gap, closing)))


def time_headway(gap: Column, speed: Column) -> Column:
    return positive(F.when(speed > 0.5, F.try_divide(gap, speed)))


def required_deceleration(gap: Column, closing: Column) -> Column:
    return F.when(gap > 5, F.try_divide(closing * closing, gap * 2))


def engaged(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit(0.0)) > 0.5) | (F.coalesce(b, F.lit(0.0)) > 0.5)


def plain_zero(c: Column) -> Column:
    """Without the sign of a negative zero."""
    return c + F.lit(0.0)


def warnings(*cases: tuple[Column, Column]) -> Column:
    """The messages whose condition holds, in order."""
    return F.filter(F.array(*[F.when(cond, text) for cond, text in cases]), lambda x: x.isNotNull())


def box_area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 when neither has an area."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    return F.coalesce(F.try_divide(w * h, box_area(a) + box_area(b) - w * h), F.lit(0.0))


def grid_cell(x: Column, y: Column) -> Column:
    """3 x 3 cell of a point in the unit square, strict upper edges: row * 3 + column."""
    third = lambda c: F.when(c < 1 / 3, 0).when(c < 2 / 3, 1).otherwise(2)
    return third(y) * 3 + third(x)


def finite_values(values: Column) -> Column:
    """Non-finite elements of an array of doubles as null."""
    return F.transform(values, finite)


def label_order(label: Column, first: list[str]) -> list[Column]:
    """Sort keys: the given labels in their order, then the others alphabetically."""
    at = F.array_position(F.array(*map(F.lit, first)), label)
    return [F.when(at > 0, at).otherwise(len(first) + 1), label]


def carried_boxes(frames: Column, least: float = 0.1) -> Column:
    """For an array of frames (arrays of boxes) in order, the leading box of each frame.

    That is the box that overlaps the frame before's leading box most, if their intersection over
    union is `least` or more; else the largest. A frame without boxes has none, and ends the chain.
    """
    box = "struct<x1:double,y1:double,x2:double,y2:double>"

    def step(state: Column, boxes: Column) -> Column:
        before = state["box"]
        nearest = F.array_max(F.transform(boxes, lambda b: F.struct(overlap_ratio(before, b).alias("s"), b.alias("b"))))
        largest = F.array_max(F.transform(boxes, lambda b: F.struct(box_area(b).alias("s"), b.alias("b"))))
        chosen = F.when(before.isNotNull() & (nearest["s"] >= least), nearest["b"]).otherwise(largest["b"])
        return F.struct(chosen.cast(box).alias("box"), F.concat(state["all"], F.array(chosen.cast(box))).alias("all"))

    start = F.struct(F.lit(None).cast(box).alias("box"), F.array().cast(f"array<{box}>").alias("all"))
    return F.aggregate(frames, start, step)["all"]
