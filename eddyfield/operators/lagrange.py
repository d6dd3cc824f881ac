"""Particles carried by the velocity field, and the stretching of their paths.

All particles of all start frames move together. A frame of velocities is one row, as large as the
sensor. A Runge-Kutta step of the particles of one start frame needs two frames only, and n steps need n + 1: as
many steps as fit ``FRAMES_HELD`` bytes of frames are one co-group by start frame, in which particles and frames are
shuffled once, and the stages are array operations in one task per start frame.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyfield.model import BLEND, FRAME_TIME, VOXEL
from eddyfield.operators.select import roi_coords
from eddyfield.operators.stats import linear_flow_tensor
from eddyfield.operators.stencil import Tile, beside, line_along, with_rims
from eddyfield.session import discard, settle

PARTICLE = ["case_id", "start_t", "y", "x"]
FRAMES_HELD = 1 << 27  # bytes of the frames that a task holds beside those of the step it takes


def geometry(axis: DataFrame) -> DataFrame:
    """Origin, signed pitch, size and farthest point of the even axes of every case."""
    parts = []
    for dim in ("x", "y"):
        by_index = axis.filter(F.col("dim") == dim).groupBy("case_id").agg(
            F.min_by("mm", "idx").alias(f"{dim}0"),
            ((F.max_by("mm", "idx") - F.min_by("mm", "idx")) / F.max("idx")).alias(f"{dim}_pitch"),
            (F.max("idx") + 1).alias(f"n{dim}"),
            F.max(F.abs("mm")).alias(f"{dim}_far"),
        )
        parts.append(by_index)
    return settle(parts[0].join(parts[1], "case_id"), "geometry")


def velocity_frames(voxel: DataFrame, axis: DataFrame) -> DataFrame:
    """One row per frame: u and v as bytes of doubles, row by row, with the linear flow of the frame
    and the geometry of its case. Absent and missing samples are NaN."""

    def pack(pdf):
        shape = int(pdf["ny"].iloc[0]), int(pdf["nx"].iloc[0])
        out = pdf.head(1)[["case_id", "t"]].copy()
        for k in ("u", "v"):
            values = np.full(shape, np.nan)
            values[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[k].to_numpy(dtype="float64")
            out[k] = [values.tobytes()]
        return out

    flow = voxel.select(*VOXEL, "u", "v")
    tensor = settle(linear_flow_tensor(roi_coords(flow, axis)), "tensor")
    grid = geometry(axis)
    packed = flow.join(grid.select("case_id", "ny", "nx"), "case_id").groupBy("case_id", "t").applyInPandas(
        pack, "case_id string, t int, u binary, v binary"
    )
    return settle(packed.join(tensor, ["case_id", "t"]).join(grid, "case_id"), "frames")


def spline_slopes(f: np.ndarray) -> np.ndarray:
    """Slopes at even nodes, along the first axis, of the cubic not-a-knot spline through ``f``.

    m[i-1] + 4 m[i] + m[i+1] = 3 (f[i+1] - f[i-1]); at the ends the third derivative runs on
    through the second node. The system has three diagonals: one sweep down and one up solve it
    for all columns at once.
    """
    n = len(f)
    if n < 4:
        raise ValueError("a cubic spline needs four rows and four columns")
    right = np.empty_like(f)
    right[1:-1] = 3 * (f[2:] - f[:-2])
    right[0] = -2.5 * f[0] + 2 * f[1] + 0.5 * f[2]
    right[-1] = 2.5 * f[-1] - 2 * f[-2] - 0.5 * f[-3]
    below = np.array([0.0] + [1.0] * (n - 2) + [2.0])
    middle = np.array([1.0] + [4.0] * (n - 2) + [1.0])
    above = np.array([2.0] + [1.0] * (n - 2) + [0.0])
    for i in range(1, n):
        factor = below[i] / middle[i - 1]
        middle[i] -= factor * above[i - 1]
        right[i] -= factor * right[i - 1]
    right[-1] /= middle[-1]
    for i in range(n - 2, -1, -1):
        right[i] = (right[i] - above[i] * right[i + 1]) / middle[i]
    return right


class _Frame:
    """Velocity at any place of one frame."""

    def __init__(self, row, method: str, blend: float):
        self.row, self.method, self.blend = row, method, blend
        shape = int(row["ny"]), int(row["nx"])
        self.nodes = {}
        for k in ("u", "v"):
            f = np.frombuffer(row[k]).reshape(shape)
            if method == "linear":
                self.nodes[k] = [f]
            elif np.isnan(f).any():  # a frame with a missing value has no spline
                self.nodes[k] = [np.full(shape, np.nan)] * 4
            else:
                f_x = spline_slopes(f.T.copy()).T
                self.nodes[k] = [f, f_x, spline_slopes(f), spline_slopes(f_x)]

    def _inside(self, k: str, cy, cx, sy, sx):
        """Interpolation within cells at the fractions of their height and width."""
        if self.method == "linear":
            weights = {0: (1 - sy, 1 - sx), 1: (sy, sx)}
            (f,) = self.nodes[k]
            return sum(weights[i][0] * weights[j][1] * f[cy + i, cx + j] for i in (0, 1) for j in (0, 1))

        def value(s, end):
            return (3 - 2 * s) * s * s if end else 1 - (3 - 2 * s) * s * s

        def slope(s, end):
            return (s - 1) * s * s if end else ((s - 2) * s + 1) * s

        total = 0.0
        for f, down, along in zip(self.nodes[k], (value, value, slope, slope), (value, slope, value, slope)):
            total = total + sum(down(sy, i) * along(sx, j) * f[cy + i, cx + j] for i in (0, 1) for j in (0, 1))
        return total

    def velocity(self, px, py):
        """Interpolated inside, the linear flow of the frame outside, a smooth step between."""
        r, weight, cell, share = self.row, 1.0, {}, {}
        for d, p in (("x", px), ("y", py)):
            place = (p - r[f"{d}0"]) / r[f"{d}_pitch"]
            known = np.nan_to_num(place)
            cell[d] = np.clip(np.floor(known), 0, r[f"n{d}"] - 2).astype(int)
            share[d] = place - cell[d]
            fade = np.clip((r[f"{d}_far"] - np.abs(p)) / self.blend, 0, 1)
            weight = weight * fade * fade * (3 - 2 * fade)
        out = {"u": r["g_xx"] * px + r["g_xy"] * py + r["u_mean"], "v": r["g_yx"] * px + r["g_yy"] * py + r["v_mean"]}
        inside = {k: self._inside(k, cell["y"], cell["x"], share["y"], share["x"]) for k in ("u", "v")}
        return [np.where(weight == 0, out[k], np.where(weight == 1, inside[k], out[k] + (inside[k] - out[k]) * weight)) for k in ("u", "v")]


def steps_at_once(frames: DataFrame, held: int = FRAMES_HELD) -> int:
    """How many steps one co-group takes: with one more frame than that, u and v as doubles, within ``held`` bytes."""
    pixels = frames.agg(F.max(F.col("ny").cast("long") * F.col("nx"))).first()[0] or 1
    return max(1, held // (16 * pixels) - 1)


def particle_advect(
    voxel: DataFrame,
    axis: DataFrame,
    n_steps: int,
    *,
    dt: float = FRAME_TIME,
    direction: int = 1,
    method: str = "cubic",
    blend: float = BLEND,
    held: int = FRAMES_HELD,
) -> DataFrame:
    """Positions after ``n_steps`` Runge-Kutta steps of particles that start on every pixel in
    every frame: ``(case_id, start_t, y, x, px, py)`` in the unit of the axes.

    ``method`` is the interpolation in space: "cubic" (not-a-knot spline) or "linear".
    The velocity of a time between two frames is that of the frame at or before it. A particle
    whose time leaves the recording, or that meets a missing velocity, has no position. The positions after every
    co-group of steps are stored, and those before it removed; jobs run while this is called.
    """
    if direction not in (1, -1):
        raise ValueError("direction is 1 (forward) or -1 (backward)")
    if method not in ("cubic", "linear"):
        raise ValueError(f"unknown method {method}")
    frames = velocity_frames(voxel, axis)
    start = roi_coords(voxel.select("case_id", F.col("t").alias("start_t"), "y", "x"), axis)
    state = start.select(*PARTICLE, F.col("x_mm").alias("px"), F.col("y_mm").alias("py"))
    step = direction * dt
    together = steps_at_once(frames, held)
    for begin in range(0, n_steps, together):
        steps = range(begin, min(begin + together, n_steps))

        def advance(key, particles, several):
            rows = {int(row["t"]): row for row in several.to_dict("records")}
            px, py = particles["px"].to_numpy(dtype="float64"), particles["py"].to_numpy(dtype="float64")
            known: dict[int, _Frame] = {}
            for n in steps:
                now = key[1] + direction * n
                end = now + direction
                if now not in rows or end not in rows:
                    return particles.assign(px=np.nan, py=np.nan)
                known = {t: known[t] if t in known else _Frame(rows[t], method, blend) for t in (now, end)}
                first, between, last = known[now], known[min(now, end)], known[end]
                u1, v1 = first.velocity(px, py)
                u2, v2 = between.velocity(px + step / 2 * u1, py + step / 2 * v1)
                u3, v3 = between.velocity(px + step / 2 * u2, py + step / 2 * v2)
                u4, v4 = last.velocity(px + step * u3, py + step * v3)
                px, py = px + step / 6 * (u1 + 2 * u2 + 2 * u3 + u4), py + step / 6 * (v1 + 2 * v2 + 2 * v3 + v4)
            return particles.assign(px=px, py=py)

        needed = [F.col("t") - direction * n for n in (*steps, steps[-1] + 1)]
        used = frames.withColumn("start_t", F.explode(F.array(*needed)))
        moved = state.groupBy("case_id", "start_t").cogroup(used.groupBy("case_id", "start_t")).applyInPandas(
            advance, "case_id string, start_t int, y int, x int, px double, py double"
        )
        before, state = state, settle(moved, "particles")
        if begin:
            discard(before)
    return state


def ftle_field(positions: DataFrame, dx: float, dy: float, duration: float, tile: Tile = Tile()) -> DataFrame:
    """Finite-time Lyapunov exponent from the final positions of a particle grid whose columns lie
    ``dx`` and rows ``dy`` apart: ln of the largest stretching over the duration; 0 on the border,
    missing where it is not defined."""
    tiled = with_rims(positions.withColumnRenamed("start_t", "t"), {"y": 1, "x": 1}, tile)
    for dim, step in (("x", dx), ("y", dy)):
        line = line_along(tiled, dim)
        for p in ("px", "py"):
            tiled = tiled.withColumn(f"{p}_{dim}", (beside(p, dim, line, 1) - beside(p, dim, line, -1)) / F.lit(2 * step))
        tiled = tiled.withColumn(f"_mid_{dim}", F.lead(dim).over(line).isNotNull() & F.lag(dim).over(line).isNotNull())
    a, b, c, d = F.col("px_x"), F.col("px_y"), F.col("py_x"), F.col("py_y")
    # symmetric tensor J'J and its larger eigenvalue
    xx, xy, yy = a * a + c * c, a * b + c * d, b * b + d * d
    largest = (xx + yy) / 2 + F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    exponent = F.when(largest > 0, F.log(F.sqrt(largest)) / F.lit(abs(duration)))
    return tiled.filter("_own").select(
        "case_id",
        F.col("t").alias("start_t"),
        "y",
        "x",
        F.when(F.col("_mid_x") & F.col("_mid_y"), exponent).otherwise(F.lit(0.0)).alias("ftle"),
    )
