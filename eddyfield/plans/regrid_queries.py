"""Interpolation and gap filling over the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyfield.model import PIXEL
from eddyfield.operators import align, regrid, select, triangles
from eddyfield.plans.fixture import axis, voxel
from eddyfield.plans.registry import query, r, rounded
from eddyfield.plans.stats_queries import MEAN_SQL

# a target axis that leaves the source on both sides and hits some of its points
TARGET_SQL = """
targets AS MATERIALIZED (
  SELECT DISTINCT case_id, 'x' AS dim, x AS idx, -7.35::DOUBLE + 0.77::DOUBLE * x AS mm FROM voxel
  UNION ALL SELECT DISTINCT case_id, 'y' AS dim, y AS idx, -1.63::DOUBLE + 0.71::DOUBLE * y AS mm FROM voxel
)"""


def target_axes(spark, sf_dir):
    pixels = voxel(spark, sf_dir).select("case_id", "y", "x").distinct()
    columns = pixels.select("case_id", F.lit("x").alias("dim"), F.col("x").alias("idx"), (F.lit(-7.35) + F.lit(0.77) * F.col("x")).alias("mm"))
    rows = pixels.select("case_id", F.lit("y").alias("dim"), F.col("y").alias("idx"), (F.lit(-1.63) + F.lit(0.71) * F.col("y")).alias("mm"))
    return columns.unionByName(rows).distinct()


def cells_sql(name: str, dim: str, source: str, keys: str, shift: str = "0") -> str:
    """Cell and weight of every target coordinate, by pairs of targets and cells."""
    on = " AND ".join(f"c.{k} = q.{k}" for k in keys.split(", "))
    by = ", ".join(f"c.{k}" for k in keys.split(", "))
    return f"""
{name} AS MATERIALIZED (
  SELECT {by}, q.idx AS to_idx, c.idx AS lo, c.nidx AS hi, (q.mm - c.mm) / (c.nmm - c.mm) AS s FROM
  (SELECT {keys}, idx, mm + {shift} AS mm, lead(idx) OVER w AS nidx, lead(mm) OVER w + {shift} AS nmm FROM {source} WHERE dim = '{dim}' WINDOW w AS (PARTITION BY {keys} ORDER BY mm)) c
  JOIN targets q ON q.case_id = c.case_id AND q.dim = '{dim}' AND q.mm >= c.mm AND q.mm <= c.nmm
  QUALIFY row_number() OVER (PARTITION BY {by}, q.idx ORDER BY c.mm DESC) = 1
)"""


def regrid_sql(values: str, fill: str, keys: str = "case_id", table: str = "voxel") -> str:
    """Four corners of every target point. Targets outside either axis get the fill value."""
    on = lambda t: " AND ".join(f"{t}.{k} = f.{k}" for k in keys.split(", "))
    out = ", ".join(
        r(f"CASE WHEN cy.to_idx IS NULL OR cx.to_idx IS NULL THEN {fill} ELSE "
          f"(1 - cy.s) * (1 - cx.s) * a.{v} + (1 - cy.s) * cx.s * b.{v} + cy.s * (1 - cx.s) * c.{v} + cy.s * cx.s * d.{v} END", v)
        for v in values.split(", "))
    corner = lambda t, y, x: f"LEFT JOIN {table} {t} ON {t}.case_id = f.case_id AND {t}.t = f.t AND {t}.y = cy.{y} AND {t}.x = cx.{x}"
    return (
        f"SELECT f.case_id, f.t, ty.idx AS y, tx.idx AS x, {out} FROM (SELECT DISTINCT case_id, t FROM {table}) f "
        f"JOIN targets ty ON ty.case_id = f.case_id AND ty.dim = 'y' JOIN targets tx ON tx.case_id = f.case_id AND tx.dim = 'x' "
        f"LEFT JOIN cy ON {on('cy')} AND cy.to_idx = ty.idx LEFT JOIN cx ON {on('cx')} AND cx.to_idx = tx.idx "
        + " ".join([corner("a", "lo", "lo"), corner("b", "lo", "hi"), corner("c", "hi", "lo"), corner("d", "hi", "hi")])
    )


@query("regrid_linear", regrid_sql("c, u", "NULL"), TARGET_SQL, cells_sql("cy", "y", "axis", "case_id"), cells_sql("cx", "x", "axis", "case_id"))
def regrid_linear(spark, sf_dir):
    out = regrid.regrid(voxel(spark, sf_dir), axis(spark, sf_dir), target_axes(spark, sf_dir), ["c", "u"])
    return rounded(out, 6, "c", "u")


@query("regrid_nearest", f"SELECT f.case_id, f.t, ty.idx AS y, tx.idx AS x, {r('CASE WHEN cy.to_idx IS NULL OR cx.to_idx IS NULL THEN -1 ELSE p.c END', 'c')} "
       "FROM (SELECT DISTINCT case_id, t FROM voxel) f JOIN targets ty ON ty.case_id = f.case_id AND ty.dim = 'y' JOIN targets tx ON tx.case_id = f.case_id AND tx.dim = 'x' "
       "LEFT JOIN cy ON cy.case_id = f.case_id AND cy.to_idx = ty.idx LEFT JOIN cx ON cx.case_id = f.case_id AND cx.to_idx = tx.idx LEFT JOIN voxel p ON p.case_id = f.case_id AND p.t = f.t "
       "AND p.y = CASE WHEN cy.s <= 0.5 THEN cy.lo ELSE cy.hi END AND p.x = CASE WHEN cx.s <= 0.5 THEN cx.lo ELSE cx.hi END",
       TARGET_SQL, cells_sql("cy", "y", "axis", "case_id"), cells_sql("cx", "x", "axis", "case_id"))
def regrid_nearest(spark, sf_dir):
    """Nearest source value, with a fill value outside."""
    out = regrid.regrid(voxel(spark, sf_dir), axis(spark, sf_dir), target_axes(spark, sf_dir), ["c"], method="nearest", fill=-1.0)
    return rounded(out, 6, "c")


FRAME_AXIS_SQL = """
frame_axis AS MATERIALIZED (
  SELECT DISTINCT a.case_id, t, dim, idx, mm + CASE dim WHEN 'x' THEN 0.013::DOUBLE * t ELSE -150 - 0.017::DOUBLE * t END AS mm
  FROM axis a JOIN (SELECT DISTINCT case_id, t FROM voxel) USING (case_id)
)"""


@query("regrid_batch", regrid_sql("u, v, w", "NULL", "case_id, t"), TARGET_SQL, FRAME_AXIS_SQL,
       cells_sql("cy", "y", "frame_axis", "case_id, t", "150"), cells_sql("cx", "x", "frame_axis", "case_id, t"))
def regrid_batch(spark, sf_dir):
    """Every frame has its own axes, and the rows are shifted by 150 mm."""
    table = voxel(spark, sf_dir)
    drift = F.when(F.col("dim") == "x", F.lit(0.013) * F.col("t")).otherwise(F.lit(-150) - F.lit(0.017) * F.col("t"))
    frame_axis = axis(spark, sf_dir).join(table.select("case_id", "t").distinct(), "case_id").select(
        "case_id", "t", "dim", "idx", (F.col("mm") + drift).alias("mm")
    )
    out = regrid.regrid(table, frame_axis, target_axes(spark, sf_dir), ["u", "v", "w"], y_shift=150.0)
    return rounded(out, 6, "u", "v", "w")


SCATTER_SQL = """
scatter AS MATERIALIZED (
  SELECT p.case_id, t, a.mm + 0.05::DOUBLE * p.y AS px, b.mm + 0.03::DOUBLE * p.x AS py, c
  FROM voxel p JOIN axis a ON a.case_id = p.case_id AND a.dim = 'x' AND a.idx = p.x JOIN axis b ON b.case_id = p.case_id AND b.dim = 'y' AND b.idx = p.y
)"""


@query("regrid_curvilinear", "SELECT case_id, t, y, x, c FROM (SELECT s.case_id, s.t, ty.idx AS y, tx.idx AS x, s.c, row_number() OVER (PARTITION BY s.case_id, s.t, ty.idx, tx.idx "
       "ORDER BY (px - tx.mm) * (px - tx.mm) + (py - ty.mm) * (py - ty.mm), c) AS k FROM scatter s JOIN targets ty ON ty.case_id = s.case_id AND ty.dim = 'y' "
       "JOIN targets tx ON tx.case_id = s.case_id AND tx.dim = 'x' WHERE s.c IS NOT NULL) WHERE k = 1", TARGET_SQL, SCATTER_SQL)
def regrid_curvilinear(spark, sf_dir):
    """A sheared source mesh; some targets lie far outside it."""
    table = voxel(spark, sf_dir)
    placed = select.roi_coords(table, axis(spark, sf_dir))
    points = placed.select("case_id", "t", (F.col("x_mm") + F.lit(0.05) * F.col("y")).alias("x_mm"), (F.col("y_mm") + F.lit(0.03) * F.col("x")).alias("y_mm"), "c")
    targets = select.mesh(target_axes(spark, sf_dir)).join(table.select("case_id", "t").distinct(), "case_id")
    return regrid.regrid_curvilinear(points, targets, "c", cell=0.8)


@query("fill_nearest", "SELECT m.case_id, m.y, m.x, " + r("coalesce(m.wc, q.wc)", "wc") + " FROM gaps m LEFT JOIN (SELECT a.case_id, a.y, a.x, b.wc, row_number() OVER (PARTITION BY a.case_id, a.y, a.x "
       "ORDER BY (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x), b.y, b.x) AS k FROM gaps a JOIN gaps b ON a.case_id = b.case_id WHERE a.wc IS NULL AND b.wc IS NOT NULL) q "
       "ON q.case_id = m.case_id AND q.y = m.y AND q.x = m.x AND q.k = 1",
       MEAN_SQL, "gaps AS MATERIALIZED (SELECT case_id, y, x, CASE WHEN c >= 0.2 THEN w * c END AS wc FROM mean_field)")
def fill_nearest(spark, sf_dir):
    """About half of the pixels are missing."""
    field = align.mean_field(voxel(spark, sf_dir), "w", "c").select(
        *PIXEL, F.when(F.col("c") >= 0.2, F.col("w") * F.col("c")).alias("wc")
    )
    return rounded(regrid.fill_nearest(field, "wc"), 6, "wc")


# the lattice of the sheared mesh: a cell is cut along its shorter diagonal, from (1, 0) to (0, 1)
LATTICE_SQL = """
placed AS (
  SELECT f.case_id, f.t, ty.idx AS y, tx.idx AS x,
         ((tx.mm - (-6.65::DOUBLE + CAST(substr(f.case_id, 5) AS DOUBLE) * 0.1)) * -0.6 - 0.05 * (ty.mm - 4.2)) / -0.4215 AS i,
         (0.7 * (ty.mm - 4.2) - 0.03 * (tx.mm - (-6.65::DOUBLE + CAST(substr(f.case_id, 5) AS DOUBLE) * 0.1))) / -0.4215 AS j
  FROM (SELECT DISTINCT case_id, t FROM voxel) f JOIN targets ty ON ty.case_id = f.case_id AND ty.dim = 'y' JOIN targets tx ON tx.case_id = f.case_id AND tx.dim = 'x'
), cornered AS (
  SELECT *, i BETWEEN 0 AND 19 AND j BETWEEN 0 AND 9 AS inside, CAST(least(greatest(floor(i), 0), 18) AS INTEGER) AS ci, CAST(least(greatest(floor(j), 0), 8) AS INTEGER) AS cj FROM placed
)"""


@query("regrid_triangles", "SELECT p.case_id, p.t, p.y, p.x, " + r(
    "CASE WHEN NOT inside THEN -1 WHEN i - ci + j - cj <= 1 THEN a.u + (i - ci) * (b.u - a.u) + (j - cj) * (c.u - a.u) "
    "ELSE d.u + (1 - (i - ci)) * (c.u - d.u) + (1 - (j - cj)) * (b.u - d.u) END", "u")
    + " FROM cornered p " + " ".join(f"JOIN voxel {n} ON {n}.case_id = p.case_id AND {n}.t = p.t AND {n}.y = cj + {dj} AND {n}.x = ci + {di}" for n, dj, di in [("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1)]),
    TARGET_SQL, LATTICE_SQL)
def regrid_triangles(spark, sf_dir):
    """The sheared mesh cut into triangles, tile by tile."""
    table = voxel(spark, sf_dir)
    placed = select.roi_coords(table, axis(spark, sf_dir))
    points = placed.select("case_id", "t", (F.col("x_mm") + F.lit(0.05) * F.col("y")).alias("x_mm"), (F.col("y_mm") + F.lit(0.03) * F.col("x")).alias("y_mm"), "u")
    targets = select.mesh(target_axes(spark, sf_dir)).join(table.select("case_id", "t").distinct(), "case_id")
    return rounded(triangles.regrid_triangles(points, targets, "u", fill=-1.0, tile=40, whole=100), 6, "u")
