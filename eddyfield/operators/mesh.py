"""Meshes given by the coordinates of every point: ``grid(case_id, y, x, x_mm, y_mm)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eddyfield.operators.triangles import containing, housed, twice_area
from eddyfield.session import settle

# How far coordinates of a straight mesh may differ, relative and absolute.
RELATIVE, ABSOLUTE = 1e-5, 1e-8


def mesh_kind(grid: DataFrame) -> DataFrame:
    """``(case_id, ny, nx, straight)``: a mesh is straight when all rows have the column coordinates of the first row, and all
    columns the row coordinates of the first column; missing ones only where the first is missing too. Only
    straight meshes are two axes."""
    top = grid.filter("y = 0").select("case_id", "x", F.col("x_mm").alias("x0"))
    side = grid.filter("x = 0").select("case_id", "y", F.col("y_mm").alias("y0"))
    both = grid.join(top, ["case_id", "x"], "left").join(side, ["case_id", "y"], "left")

    def same(value: str, first: str):
        close = F.abs(F.col(value) - F.col(first)) <= F.lit(ABSOLUTE) + F.lit(RELATIVE) * F.abs(F.col(first))
        return F.coalesce(close, F.col(value).isNull() & F.col(first).isNull())

    return both.groupBy("case_id").agg(
        (F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"), F.bool_and(same("x_mm", "x0") & same("y_mm", "y0")).alias("straight")
    )


def axes_of_mesh(grid: DataFrame) -> DataFrame:
    """The axes of straight meshes: ``axis(case_id, dim, idx, mm)``. A curvilinear one is refused."""
    bent = mesh_kind(grid).filter(~F.col("straight")).orderBy("case_id").first()
    if bent is not None:
        raise ValueError(f"the mesh of {bent['case_id']} is curvilinear and has no axes")
    columns = grid.filter("y = 0").select("case_id", F.lit("x").alias("dim"), F.col("x").alias("idx"), F.col("x_mm").alias("mm"))
    rows = grid.filter("x = 0").select("case_id", F.lit("y").alias("dim"), F.col("y").alias("idx"), F.col("y_mm").alias("mm"))
    return columns.unionByName(rows)


def check_mesh(grid: DataFrame, field: DataFrame) -> DataFrame:
    """The kinds of the meshes of all cases of a field; a mesh that is absent or of another size than its field is refused."""
    sizes = field.groupBy("case_id").agg((F.max("y") + 1).alias("fy"), (F.max("x") + 1).alias("fx"))
    kinds = settle(sizes.join(mesh_kind(grid), "case_id", "left"), "kinds")
    wrong = kinds.filter(F.col("ny").isNull() | (F.col("ny") != F.col("fy")) | (F.col("nx") != F.col("fx"))).orderBy("case_id").first()
    if wrong is not None:
        raise ValueError(f"the mesh of {wrong['case_id']} has {wrong['ny']} x {wrong['nx']} points, its field {wrong['fy']} x {wrong['fx']}")
    return kinds.select("case_id", "ny", "nx", "straight")


def locate_in_mesh(grid: DataFrame, points: DataFrame) -> DataFrame:
    """The cell of a mesh, straight or curvilinear, that holds each of ``points(case_id, point, x_mm, y_mm)``:
    ``(case_id, point, y, x, inside)``, where ``y`` and ``x`` count the corner of the cell with the smallest numbers. A cell is cut
    along the diagonal from (y, x + 1) to (y + 1, x). Points outside every cell have no numbers. Of cells that share
    the point the one with the larger numbers is taken."""
    line = Window.partitionBy("case_id", "y").orderBy("x")
    here = F.struct("x_mm", "y_mm")
    pairs = grid.select("case_id", "y", "x", here.alias("p"), F.when(F.lead("x").over(line) == F.col("x") + 1, F.lead(here).over(line)).alias("q"))
    below = pairs.select("case_id", (F.col("y") - 1).alias("y"), "x", F.col("p").alias("r"), F.col("q").alias("s"))
    cells = pairs.join(below, ["case_id", "y", "x"]).filter("q IS NOT NULL AND s IS NOT NULL")
    halves = F.array(*[F.struct(*[F.col(c).alias(n) for n, c in zip("abc", corners)]) for corners in (("p", "q", "r"), ("s", "r", "q"))])
    cut = cells.select("case_id", "y", "x", F.explode(halves).alias("h"))
    shaped = cut.select("case_id", F.col("y").alias("row"), F.col("x").alias("column"), *[F.col(f"h.{n}.{d}_mm").alias(f"{n}{d}") for n in "abc" for d in "xy"])
    shaped = shaped.dropna().withColumn("double", twice_area()).filter("double <> 0")
    housing = housed(shaped, ["case_id"], ["row", "column"])
    wanted = settle(points.select("case_id", "point", "x_mm", "y_mm"), "points")
    held = containing(wanted, housing, ["case_id"], ["case_id", "point"], ["row", "column"])
    return wanted.join(held, ["case_id", "point"], "left").select(
        "case_id", "point", F.col("row").alias("y"), F.col("column").alias("x"), F.col("row").isNotNull().alias("inside")
    )
