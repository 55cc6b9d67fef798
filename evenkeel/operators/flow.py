"""Scalars of a frame's motion field: the camera's own motion, what is left of the field without it, and what moves by itself."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of the scalars (fixed names of the feature table).
SCALARS = [
    "flow_valid", "flow_ransac_inlier_frac",
    "flow_global_tx", "flow_global_ty", "flow_global_scale", "flow_global_rot",
    "flow_res_valid_frac",
    "flow_res_mag_mean", "flow_res_mag_p95", "flow_res_mag_max",
    "flow_res_max_x_frac", "flow_res_max_y_frac",
    "flow_res_corridor_mag_mean", "flow_res_corridor_mag_p95",
    "flow_res_lat_mean", "flow_res_long_mean",
    "flow_div_max", "flow_div_corridor_mean",
    "flow_imo_count", "flow_imo_area_frac", "flow_imo_corridor_count",
    "flow_imo_max_area_frac", "flow_imo_mean_area_frac",
]


@dataclass(frozen=True)
class Rules:
    """Which pixels count, and from when on something moves (the defaults are fixed values of the feature table)."""

    border: int = 4
    hood: float = 0.15
    left: float = 0.25
    right: float = 0.75
    step: int = 8
    least_points: int = 50
    tolerance: float = 3.0
    least_area: float = 0.001
    least_motion: float = 1.5
    times_median: float = 3.0
    #: Pairs of points that a camera motion is guessed from; all pairs if there are no more.
    guesses: int = 500
    seed: int = 0


class Field:
    """What the rules say about fields of one size, worked out once for all frames of that size."""

    def __init__(self, height: int, width: int, rules: Rules):
        self.rules, self.shape = rules, (height, width)
        rows, columns = np.indices(self.shape)
        b = rules.border
        self.valid = (rows >= b) & (rows < height - b) & (columns >= b) & (columns < width - b) & (rows < height - int(round(rules.hood * height)))
        self.corridor = self.valid & (columns >= rules.left * width) & (columns < rules.right * width)
        self.place = columns + 1j * rows
        grid = self.valid & (rows % rules.step == b % rules.step) & (columns % rules.step == b % rules.step)
        self.points = np.flatnonzero(grid)

    def camera(self, motion: np.ndarray) -> tuple[complex, complex, float] | None:
        """(turn and zoom, shift, share of inliers): the similarity z -> turn * z + shift of most points, then the best one for those.

        Points are complex numbers, so two of them give a similarity by one division.
        """
        at = self.points[np.isfinite(motion.ravel()[self.points])]
        n = len(at)
        if n < max(self.rules.least_points, 2):
            return None
        z = self.place.ravel()[at]
        w = z + motion.ravel()[at]
        if n * (n - 1) // 2 <= self.rules.guesses:
            i, j = np.array(list(combinations(range(n), 2))).T
        else:
            rng = np.random.default_rng(self.rules.seed)
            i, j = rng.integers(0, n, self.rules.guesses), rng.integers(1, n, self.rules.guesses)
            j = (i + j) % n
        turn = (w[j] - w[i]) / (z[j] - z[i])
        shift = w[i] - turn * z[i]
        close = np.abs(turn[:, None] * z + shift[:, None] - w) <= self.rules.tolerance
        best = close[close.sum(axis=1).argmax()]
        zc, wc = z[best] - z[best].mean(), w[best] - w[best].mean()
        turn = (zc.conj() * wc).sum() / (np.abs(zc) ** 2).sum()
        return turn, w[best].mean() - turn * z[best].mean(), best.mean()

    def moving(self, mask: np.ndarray) -> list[tuple[int, float]]:
        """(area, centre's column) of each set of touching pixels, corners included, that is large enough."""
        height, width = self.shape
        labels = np.where(mask, np.arange(mask.size).reshape(self.shape), mask.size)
        while True:
            around = np.pad(labels, 1, constant_values=mask.size)
            least = np.min([around[r : r + height, c : c + width] for r in range(3) for c in range(3)], axis=0)
            least = np.where(mask, least, mask.size)
            # a label's own label is as good, which halves the way to go each time
            least = np.where(mask, np.append(least.ravel(), mask.size)[least], mask.size)
            if (least == labels).all():
                break
            labels = least
        ids, back = np.unique(labels[mask], return_inverse=True)
        areas = np.bincount(back, minlength=len(ids))
        centres = np.bincount(back, np.nonzero(mask)[1], len(ids)) / np.maximum(areas, 1)
        return [(int(a), float(c)) for a, c in zip(areas, centres) if a >= self.rules.least_area * mask.size]

    def scalars(self, u: np.ndarray, v: np.ndarray) -> dict[str, float]:
        out = dict.fromkeys(SCALARS, 0.0)
        motion = (u + 1j * v).reshape(self.shape)
        found = self.camera(motion)
        if found is None:
            return out
        turn, shift, share = found
        rest = motion - (turn * self.place + shift - self.place)
        size = np.abs(rest)
        seen = self.valid & np.isfinite(size)
        height, width = self.shape
        out |= {"flow_valid": 1.0, "flow_ransac_inlier_frac": share, "flow_global_tx": shift.real, "flow_global_ty": shift.imag}
        out |= {"flow_global_scale": abs(turn), "flow_global_rot": np.angle(turn), "flow_res_valid_frac": seen.mean()}
        if not seen.any():
            return out
        row, column = np.unravel_index(np.where(seen, size, -np.inf).argmax(), self.shape)
        out |= {"flow_res_mag_mean": size[seen].mean(), "flow_res_mag_p95": np.percentile(size[seen], 95), "flow_res_mag_max": size[seen].max()}
        out |= {"flow_res_max_x_frac": column / max(1, width - 1), "flow_res_max_y_frac": row / max(1, height - 1)}
        out |= {"flow_res_lat_mean": rest[seen].real.mean(), "flow_res_long_mean": rest[seen].imag.mean()}
        inner = self.corridor & np.isfinite(size)
        if inner.any():
            out |= {"flow_res_corridor_mag_mean": size[inner].mean(), "flow_res_corridor_mag_p95": np.percentile(size[inner], 95)}
        if min(self.shape) > 1:
            spread = np.gradient(rest.real, axis=1) + np.gradient(rest.imag, axis=0)
            for name, where, of in (("flow_div_max", seen, np.max), ("flow_div_corridor_mean", inner, np.mean)):
                if (where & np.isfinite(spread)).any():
                    out[name] = of(spread[where & np.isfinite(spread)])
        moves = self.moving(seen & (size > max(self.rules.least_motion, self.rules.times_median * np.median(size[seen]))))
        if moves:
            areas = np.array([a for a, _ in moves]) / self.valid.size
            in_corridor = sum(self.rules.left * width <= c <= self.rules.right * width for _, c in moves)
            out |= {"flow_imo_count": len(moves), "flow_imo_area_frac": areas.sum(), "flow_imo_corridor_count": in_corridor}
            out |= {"flow_imo_max_area_frac": areas.max(), "flow_imo_mean_area_frac": areas.mean()}
        return out


def flow_scalars(df: DataFrame, u: str, v: str, height: int, width: int, rules: Rules = Rules()) -> DataFrame:
    """df with SCALARS of each row's motion field, given row by row of pixels as two arrays of height * width numbers.

    A field that is null, of another length or with too few finite points has zeros only, `flow_valid`
    among them: nothing was found. Null and non-finite pixels are left out. No shuffle; the same for any
    partitions, as guesses are seeded frame by frame. Columns of df named like a scalar are an error.
    """
    clash = {c.lower() for c in df.columns} & set(SCALARS)
    if clash:
        raise ValueError(f"columns named like scalars: {sorted(clash)}")
    places = {c.lower(): k for k, c in enumerate(df.columns)}
    at_u, at_v = places[u.lower()], places[v.lower()]
    # names without dots and doubles, which a function over batches can't have
    names = [f"c{k}" for k in range(len(df.columns))]

    def pixels(x: list | None) -> np.ndarray | None:
        return None if x is None or len(x) != height * width else np.array([np.nan if p is None else p for p in x], float)

    def run(batches):
        field = Field(height, width, rules)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                some = batch.slice(start, 100)
                found = []
                for a, b in zip(some.column(at_u).to_pylist(), some.column(at_v).to_pylist()):
                    a, b = pixels(a), pixels(b)
                    found.append(dict.fromkeys(SCALARS, 0.0) if a is None or b is None else field.scalars(a, b))
                columns = [pa.array([float(f[c]) for f in found], pa.float64()) for c in SCALARS]
                yield pa.record_batch([*some.columns, *columns], names=[*names, *SCALARS])

    rows = df.toDF(*names)
    out = rows.mapInArrow(run, rows.select("*", *[F.lit(None).cast("double").alias(c) for c in SCALARS]).schema)
    return out.toDF(*df.columns, *SCALARS)
