"""Frames of different sizes over the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyfield.operators import native, regrid, select
from eddyfield.plans.fixture import _once, axis, voxel
from eddyfield.plans.ingest_queries import F32
from eddyfield.plans.regrid_queries import TARGET_SQL, cells_sql, regrid_sql, target_axes
from eddyfield.plans.registry import query, r, rounded
from eddyfield.plans.select_queries import AXES
from eddyfield.session import new_path, settle
from eddyfield.sources import tables

# every frame is cut to a size of its own and lies a little further along; case0 and case1 are the heads A and B
RAGGED_SQL = f"""
ragged AS MATERIALIZED (
  SELECT p.case_id, t, y, x, b.mm + 0.11::DOUBLE * (t % 4) AS y_mm, a.mm - 0.07::DOUBLE * (t % 5) AS x_mm, u, c
  FROM voxel p {AXES} WHERE y < 10 - t % 3 AND x < 20 - t % 4
), pairs AS (
  SELECT least(max(t) FILTER (case_id = 'case0'), max(t) FILTER (case_id = 'case1')) + 1 AS n FROM voxel
), turns AS MATERIALIZED (
  SELECT 'case0' AS case_id, 2 * t + CASE case_id WHEN 'case0' THEN 0 ELSE 1 END AS t, y, x, y_mm, x_mm, u, c FROM ragged, pairs WHERE t < n
)"""


def numbered_sql(name: str, bounds: str, offset: int = 0) -> str:
    """Pixels within the bounds; every frame numbers its rows and columns anew."""
    return f"""
{name} AS MATERIALIZED (
  SELECT case_id, t - {offset} AS t, CAST(dense_rank() OVER (PARTITION BY t ORDER BY y) - 1 AS INTEGER) AS y, CAST(dense_rank() OVER (PARTITION BY t ORDER BY x) - 1 AS INTEGER) AS x,
         y_mm, x_mm, u, c FROM turns WHERE t >= {offset} AND {bounds}
)"""


def heads(spark, sf_dir):
    """The two heads as native frames."""

    def build():
        placed = select.roi_coords(voxel(spark, sf_dir), axis(spark, sf_dir))
        t = F.col("t")
        cut = placed.filter((F.col("y") < 10 - t % 3) & (F.col("x") < 20 - t % 4)).withColumns(
            {"y_mm": F.col("y_mm") + F.lit(0.11) * (t % 4), "x_mm": F.col("x_mm") - F.lit(0.07) * (t % 5)}
        )
        return settle(native.from_voxels(cut, "u", "c"), "native")

    frames = _once(spark, sf_dir, "native_heads", build)
    return [frames.filter(F.col("case_id") == case).withColumn("case_id", F.lit("case0")) for case in ("case0", "case1")]


SHOWN = ["u", "c", "y_mm", "x_mm"]
SHOWN_SQL = "SELECT case_id, t, y, x, " + ", ".join(r(v, v) for v in SHOWN) + " FROM native"


@query("interleave_native", SHOWN_SQL, RAGGED_SQL, numbered_sql("native", "x_mm BETWEEN -4 - 1 AND 3 + 1 AND y_mm BETWEEN 0.5 - 1 AND 3 + 1"))
def interleave_native(spark, sf_dir):
    """Heads in turn, cropped to fixed bounds and a margin of 1 mm; frames differ in size and place."""
    frames = native.interleave_native(*heads(spark, sf_dir), x_mm=(-4, 3), y_mm=(3, 0.5))
    return rounded(native.voxels_of(frames), 6, *SHOWN)


COMMON = ("x_mm BETWEEN (SELECT max(low) FROM spans) - 0.25 AND (SELECT min(high) FROM spans) + 0.25 AND y_mm BETWEEN (SELECT max(ylow) FROM spans) - 0.25 AND (SELECT min(yhigh) FROM spans) + 0.25")
SPANS_SQL = "spans AS MATERIALIZED (SELECT t, min(x_mm) AS low, max(x_mm) AS high, min(y_mm) AS ylow, max(y_mm) AS yhigh FROM turns WHERE t >= 1 GROUP BY t)"


@query("interleave_native_common", f"SELECT case_id, t, y, x, {F32.format('u')}, {F32.format('c')}, {r('y_mm', 'y_mm', 4)}, {r('x_mm', 'x_mm', 4)} FROM native", RAGGED_SQL, SPANS_SQL, numbered_sql("native", COMMON, 1))
def interleave_native_common(spark, sf_dir):
    """Cropped to what all frames cover, after the first frame; written as lists of frames and of axes and read back."""
    frames = native.interleave_native(*heads(spark, sf_dir), margin=0.25, offset=1)
    root = new_path(spark, "native_lists")
    tables.write_arrays(native.lists_of(frames), root, "npz").count()
    lists = {k: tables.scan_frame_list(spark, f"{root}/{k}/case0", case_id="case0", component=k) for k in ("u", "c", "xgrid", "ygrid")}
    back = native.voxels_of(native.from_lists({k: lists[k] for k in ("u", "c")}, lists["xgrid"], lists["ygrid"]))
    wide = back.withColumns({v: F.col(v).cast("double") for v in SHOWN})  # the files hold single precision
    return rounded(wide, 4, "y_mm", "x_mm")


@query("interleave_native_regrid", regrid_sql("u, c", "NULL", "case_id, t", "native"), RAGGED_SQL, numbered_sql("native", "x_mm BETWEEN -5 AND 4 AND y_mm BETWEEN -0.5 AND 4"), TARGET_SQL,
       "native_axis AS MATERIALIZED (SELECT DISTINCT case_id, t, 'x' AS dim, x AS idx, x_mm AS mm FROM native UNION ALL SELECT DISTINCT case_id, t, 'y', y, y_mm FROM native)",
       cells_sql("cy", "y", "native_axis", "case_id, t"), cells_sql("cx", "x", "native_axis", "case_id, t"))
def interleave_native_regrid(spark, sf_dir):
    """The cropped frames, each with its own axes, on one grid."""
    frames = settle(native.interleave_native(*heads(spark, sf_dir), x_mm=(-4, 3), y_mm=(0.5, 3)), "native")
    out = regrid.regrid(native.voxels_of(frames), native.axes_of(frames), target_axes(spark, sf_dir), ["u", "c"])
    return rounded(out, 6, "u", "c")
