"""Detections of a frame: class counts, the corridor, the grid, the state of a light, and the lead that is carried from frame to frame."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions import scalars as S

#: Detector classes by meaning, the corridor's bounds as shares of the image, the least overlap of a carried lead (fixed values).
CLASSES = {"vehicles": (2, 3, 5, 7), "person": (0,), "bicycle": (1,), "light": (9,), "stop": (11,)}
CORRIDOR, NEAR, CONTINUES = (0.25, 0.75), 0.30, 0.1
#: Least coloured pixels of a light's box that say something, least pixels and share of them of one colour (fixed values).
LEAST_COLOURED, LEAST_PIXELS, LEAST_SHARE = 4, 3, 0.25


def of_class(boxes: Column, name: str) -> Column:
    """The boxes (cls, conf, x1, y1, x2, y2) of a class."""
    return F.filter(boxes, lambda b: b["cls"].isin(*CLASSES[name]))


def class_count(boxes: Column, name: str) -> Column:
    return F.coalesce(F.size(of_class(boxes, name)), F.lit(0))


def in_corridor(box: Column, width: Column) -> Column:
    """Whether a box's centre is in the middle half of the image, ends included."""
    return ((box["x1"] + box["x2"]) / 2).between(width * CORRIDOR[0], width * CORRIDOR[1])


def corridor_count(boxes: Column, width: Column, height: Column) -> Column:
    """Vehicles in the corridor that aren't far up in the image."""
    near = F.filter(of_class(boxes, "vehicles"), lambda b: in_corridor(b, width) & (b["y2"] >= height * NEAR))
    return F.coalesce(F.size(near), F.lit(0))


def grid_columns(boxes: Column, width: Column, height: Column) -> dict[str, Column]:
    """n_<r><c> and a_<r><c>: vehicles whose centre is in a cell of a 3 x 3 grid, and the share of the image that they cover."""
    out = {}
    for cell in range(9):
        r, c = divmod(cell, 3)
        here = _in_cell(boxes, width, height, cell)
        out[f"n_{r}{c}"] = F.coalesce(F.size(here), F.lit(0))
        out[f"a_{r}{c}"] = F.coalesce(F.aggregate(here, F.lit(0.0), lambda s, b: s + S.box_area(b)) / (width * height), F.lit(0.0))
    return out


def _in_cell(boxes: Column, width: Column, height: Column, cell: int) -> Column:
    def here(b):
        return S.grid_cell((b["x1"] + b["x2"]) / 2 / width, (b["y1"] + b["y2"]) / 2 / height) == cell

    return F.filter(of_class(boxes, "vehicles"), here)


def light_state(coloured: Column, red: Column, amber: Column, green: Column, red_y: Column, green_y: Column) -> Column:
    """red, amber, green or unknown, from how many coloured pixels of a light's box have each hue, and the mean height of two of them.

    Few coloured pixels, or no hue with a fair share of them: unknown. Red and green alike: the upper one.
    """
    best = F.greatest(red, amber, green)
    state = F.when((red == green) & (red > 0), F.when(red_y <= green_y, "red").otherwise("green")).when(red == best, "red").when(green == best, "green").otherwise("amber")
    return F.when((coloured < LEAST_COLOURED) | (best < F.greatest(F.lit(float(LEAST_PIXELS)), coloured * LEAST_SHARE)), "unknown").otherwise(state)


def frame_columns(boxes: Column, width: Column, height: Column, states: Column | None = None) -> dict[str, Column]:
    """Counts of a frame's boxes by class, in the corridor and by cell; with `states` (of its lights) also lights by state."""
    out = {name: class_count(boxes, name) for name in CLASSES} | {"corridor": corridor_count(boxes, width, height)} | grid_columns(boxes, width, height)
    for state in ("red", "amber", "green", "unknown") if states is not None else ():
        out[state] = F.coalesce(F.size(_equal(states, state)), F.lit(0))
    return out


def _equal(states: Column, state: str) -> Column:
    return F.filter(states, lambda x: x == state)


def lead_columns(lead: Column, width: Column, height: Column) -> dict[str, Column]:
    """What the lead's box says of a frame; nulls without one."""
    return {
        "lead": lead.isNotNull(), "conf": lead["conf"], "area": F.when(lead.isNotNull(), S.box_area(lead) / (width * height)),
        "cx": ((lead["x1"] + lead["x2"]) / 2 - width / 2) / width, "y2": lead["y2"] / height,
    }


def candidates(boxes: Column, width: Column) -> Column:
    """The vehicles that a frame's lead is chosen from."""
    return F.filter(of_class(boxes, "vehicles"), lambda b: in_corridor(b, width))


def carried_leads(df: DataFrame, key: str, order: str, boxes: str, lead: str = "lead") -> DataFrame:
    """Adds each row's leading box: the one that overlaps the lead of the row before most, if that is CONTINUES or more, else the largest.

    A row without boxes has no lead and ends the chain. Of boxes that are as good the greatest (by
    x1, y1, x2, y2) leads. Rows of a key are gone through in order in one task; what it holds is a batch and one box.
    """
    kind = df.schema[boxes].dataType.elementType.simpleString()
    names = df.columns
    sides = ("x1", "y1", "x2", "y2")

    def choose(found, before):
        area = lambda b: max(b["x2"] - b["x1"], 0.0) * max(b["y2"] - b["y1"], 0.0)
        corners = lambda b: tuple(b[s] for s in sides)

        def ratio(b):
            w = max(min(b["x2"], before["x2"]) - max(b["x1"], before["x1"]), 0.0)
            h = max(min(b["y2"], before["y2"]) - max(b["y1"], before["y1"]), 0.0)
            whole = area(b) + area(before) - w * h
            return w * h / whole if whole else 0.0

        if not found:
            return None
        if before is not None:
            near = max((ratio(b), corners(b), k) for k, b in enumerate(found))
            if near[0] >= CONTINUES:
                return found[near[2]]
        return found[max((area(b), corners(b), k) for k, b in enumerate(found))[2]]

    def run(batches):
        last, before = None, None
        for batch in batches:
            keys, all_boxes = batch.column(names.index(key)).to_pylist(), batch.column(names.index(boxes))
            leads = []
            for k, found in zip(keys, all_boxes.to_pylist()):
                before = choose([b for b in found or () if b], before if k == last else None)
                last = k
                leads.append(before)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leads, all_boxes.type.value_type)], names=[*names, lead])

    rows = df.repartition(key).sortWithinPartitions(key, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(run, f"{schema}, {lead} {kind}")


def change(value: Column, key: str, order: str) -> Column:
    """Absolute difference to the frame before; null for the first."""
    return F.abs(value - F.lag(value).over(Window.partitionBy(key).orderBy(order)))
