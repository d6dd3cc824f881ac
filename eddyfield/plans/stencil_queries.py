"""Neighbour differences and filters over the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyfield.model import PIXEL, VOXEL, shape_of
from eddyfield.operators import align, stencil
from eddyfield.plans.fixture import voxel
from eddyfield.plans.registry import query, r, rounded
from eddyfield.plans.stats_queries import DX, FLUCT_SQL, MEAN_SQL, STRAIN_SQL, slope_sql

SLOPES_SQL = f"""
slopes AS MATERIALIZED (
  SELECT case_id, t, y, x, c, {slope_sql('c', 'x', '0.5::DOUBLE')} AS gx, {slope_sql('c', 'y', '0.5::DOUBLE')} AS gy,
         {slope_sql('c', 't', '0.05::DOUBLE')} AS gt FROM voxel
)"""


@query("spatial_gradient", f"SELECT case_id, t, y, x, c, {r('gx', 'd_dx')}, {r('gy', 'd_dy')} FROM slopes", SLOPES_SQL)
def spatial_gradient(spark, sf_dir):
    return rounded(stencil.spatial_gradient(voxel(spark, sf_dir)), 6, "d_dx", "d_dy")


@query("temporal_gradient", f"SELECT case_id, t, y, x, c, {r('gt', 'd_dt')} FROM slopes", SLOPES_SQL)
def temporal_gradient(spark, sf_dir):
    return rounded(stencil.temporal_gradient(voxel(spark, sf_dir)), 6, "d_dt")


MEANS = ["dx_mean", "dy_mean", "dt_mean", "dx_dt_mean", "dy_dt_mean"]


@query("gradient_means", f"SELECT case_id, y, x, {r('avg(gx)', 'dx_mean')}, {r('avg(gy)', 'dy_mean')}, {r('avg(gt)', 'dt_mean')}, "
       f"{r('avg(-gx * gt)', 'dx_dt_mean')}, {r('avg(-gy * gt)', 'dy_dt_mean')} FROM slopes GROUP BY ALL", SLOPES_SQL)
def gradient_means(spark, sf_dir):
    return rounded(stencil.gradient_means(voxel(spark, sf_dir)), 6, *MEANS)


@query("strain_rates", f"SELECT case_id, t, y, x, {r('du', 'du')}, {r('dv', 'dv')}, {r('dw', 'dw')} FROM strain", MEAN_SQL, FLUCT_SQL, STRAIN_SQL)
def strain_rates(spark, sf_dir):
    out = stencil.strain_rates(align.reynolds(voxel(spark, sf_dir)), DX)
    return rounded(out.select(*VOXEL, "du", "dv", "dw"), 6, "du", "dv", "dw")


def correlator_sql(first: int) -> str:
    return f"""
a AS MATERIALIZED (SELECT p.case_id, t, y, x, CASE WHEN p.c >= 0.02 THEN p.c - m.c END AS a FROM voxel p JOIN mean_field m USING (case_id, y, x)),
pairs AS (
  SELECT p.case_id, p.y, p.x, p.t, p1.a * qx.a - p.a * qx1.a AS hx, p1.a * qy.a - p.a * qy1.a AS hy
  FROM a p JOIN a p1 ON p1.case_id = p.case_id AND p1.y = p.y AND p1.x = p.x AND p1.t = p.t + 1
  JOIN a qx ON qx.case_id = p.case_id AND qx.y = p.y AND qx.x = p.x - 1 AND qx.t = p.t
  JOIN a qx1 ON qx1.case_id = p.case_id AND qx1.y = p.y AND qx1.x = p.x - 1 AND qx1.t = p.t + 1
  JOIN a qy ON qy.case_id = p.case_id AND qy.y = p.y - 1 AND qy.x = p.x AND qy.t = p.t
  JOIN a qy1 ON qy1.case_id = p.case_id AND qy1.y = p.y - 1 AND qy1.x = p.x AND qy1.t = p.t + 1
  WHERE p.t >= {first}
),
grid AS (SELECT DISTINCT case_id, y, x FROM voxel WHERE y >= 1 AND x >= 1)"""


CORRELATOR = f"SELECT case_id, y, x, {r('avg(hx)', 'corr_x')}, {r('avg(hy)', 'corr_y')} FROM grid LEFT JOIN pairs USING (case_id, y, x) GROUP BY ALL"


@query("motion_correlator", CORRELATOR, MEAN_SQL, correlator_sql(1))
def motion_correlator(spark, sf_dir):
    return rounded(stencil.motion_correlator(voxel(spark, sf_dir), c_min=0.02), 6, "corr_x", "corr_y")


@query("motion_correlator_all_pairs", CORRELATOR, MEAN_SQL, correlator_sql(0))
def motion_correlator_all_pairs(spark, sf_dir):
    return rounded(stencil.motion_correlator(voxel(spark, sf_dir), c_min=0.02, all_pairs=True), 6, "corr_x", "corr_y")


@query("correlator_frame", f"SELECT p1.case_id, p1.y, p1.x, {r('p1.c * q.c - p.c * q1.c', 'corr')} FROM voxel p1 JOIN voxel p ON p.case_id = p1.case_id AND p.y = p1.y AND p.x = p1.x AND p.t = 0 "
       "JOIN voxel q ON q.case_id = p1.case_id AND q.y = p1.y AND q.x = p1.x - 1 AND q.t = 0 JOIN voxel q1 ON q1.case_id = p1.case_id AND q1.y = p1.y AND q1.x = p1.x - 1 AND q1.t = 1 WHERE p1.t = 1")
def correlator_frame(spark, sf_dir):
    return rounded(stencil.correlator_frame(voxel(spark, sf_dir), 1), 6, "corr")


def shift_sql(along: str) -> str:
    across, top, sites, bands = ("y", 20, 9, 4) if along == "x" else ("x", 10, 4, 9)
    return f"""
SELECT '{along}' AS along, case_id, CAST(2 * {'band' if across == 'y' else 'site'} AS INTEGER) AS y, CAST(2 * {'site' if across == 'y' else 'band'} AS INTEGER) AS x,
  {r('avg(shift)', 'shift')}, {r('avg(shift) * 10', 'velocity')}, count(*) AS pairs FROM (
  SELECT case_id, t, band, site, arg_max(d, (cov, -d)) AS shift FROM (
    SELECT p.case_id, p.t, p.band, (p.at + 1) // 2 AS site, d, sum(p.a * q.a) / 2 AS cov FROM line{along} p, range(-2, 2) g(d), line{along} q
    WHERE q.case_id = p.case_id AND q.t = p.t + 1 AND q.band = p.band AND q.at = p.at + d AND p.a IS NOT NULL AND q.a IS NOT NULL
    GROUP BY ALL HAVING count(*) = 2 AND sum(p.a * q.a) > 0)
  WHERE band BETWEEN 2 AND {bands - 1} AND site BETWEEN 2 AND {sites - 1} GROUP BY ALL)
WHERE shift > -2 GROUP BY ALL"""


def line_sql(along: str) -> str:
    across = "y" if along == "x" else "x"
    return f"""
line{along} AS MATERIALIZED (SELECT case_id, t, (p.{across} + 1) // 2 AS band, p.{along} AS at, CASE WHEN count(a) = 2 THEN avg(a) END AS a FROM
  (SELECT p.case_id, p.t, p.y, p.x, CASE WHEN p.c >= 0.02 THEN p.c - m.c END AS a FROM voxel p JOIN mean_field m ON m.case_id = p.case_id AND m.y = p.y AND m.x = p.x) p GROUP BY ALL)"""


@query("peak_shift_velocity", shift_sql("x") + " UNION ALL " + shift_sql("y"), MEAN_SQL, line_sql("x"), line_sql("y"))
def peak_shift_velocity(spark, sf_dir):
    """Sites two pixels apart, along both directions."""
    table = voxel(spark, sf_dir)
    shape = shape_of(table)
    parts = [
        stencil.peak_shift_velocity(table, shape, along, 2, c_min=0.02, mm_per_px=0.5, frames_per_s=20).select(F.lit(along).alias("along"), "*")
        for along in ("x", "y")
    ]
    return rounded(parts[0].unionByName(parts[1]), 6, "shift", "velocity")


def median_sql(table: str, frame: str) -> str:
    return (
        f"SELECT {frame}p.case_id, p.y, p.x, {r('median(q.c)', 'c')} FROM {table} p, range(-1, 2) j(dy), range(-1, 2) k(dx), {table} q "
        f"WHERE q.case_id = p.case_id {'AND q.t = p.t ' if frame else ''}AND q.y = greatest(0, least(9, p.y + dy)) AND q.x = greatest(0, least(19, p.x + dx)) GROUP BY ALL"
    )


@query("median_filter", median_sql("voxel", "p.t, "))
def median_filter(spark, sf_dir):
    """3 x 3 median of every frame."""
    table = voxel(spark, sf_dir)
    return rounded(stencil.median_filter(table, "c", 3, shape_of(table)), 6, "c")


@query("median_filter_field", median_sql("mean_field", ""), MEAN_SQL)
def median_filter_field(spark, sf_dir):
    """3 x 3 median of a mean field."""
    table = voxel(spark, sf_dir)
    field = align.mean_field(table, "c")
    return rounded(stencil.median_filter(field.select(*PIXEL, "c"), "c", 3, shape_of(table)), 6, "c")
