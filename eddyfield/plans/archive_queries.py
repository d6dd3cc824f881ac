"""Archives by naming convention, meshes, manifests and splits over the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyfield.model import PIXEL, VOXEL
from eddyfield.operators import align, mesh, select
from eddyfield.plans.fixture import axis, voxel
from eddyfield.plans.ingest_queries import F32, stack_files
from eddyfield.plans.regrid_queries import LATTICE_SQL, TARGET_SQL, target_axes
from eddyfield.plans.registry import query, r, rounded
from eddyfield.plans.select_queries import AXES
from eddyfield.plans.stats_queries import MEAN_SQL
from eddyfield.session import new_path
from eddyfield.sources import tables


@query("scan_components_named", f"SELECT case_id, t, y, x, {F32.format('u')}, {F32.format('c')} FROM voxel WHERE case_id = 'case1' AND t BETWEEN 1 AND 17 AND y >= 2 AND x BETWEEN 5 AND 14")
def scan_components_named(spark, sf_dir):
    """The stacks of a case by the names of their files, with ranges of frames, rows and columns."""
    root = stack_files(spark, sf_dir).first()["root"]
    rows = tables.scan_components(spark, root, "case1", components=("u", "c"), name="{component}/{case}", t=(1, 18), y=(2, None), x=(5, 15))
    return rows.withColumns({k: F.col(k).cast("double") for k in ("u", "c")})


@query("scan_mean_fields", f"SELECT case_id, y, x, {r('u', 'u')}, {r('v', 'v')}, {r('c', 'c')} FROM mean_field", MEAN_SQL)
def scan_mean_fields(spark, sf_dir):
    """Mean fields written as 2-D arrays and read by the names of their files."""
    root = new_path(spark, "means")
    tables.write_field_arrays(align.mean_field(voxel(spark, sf_dir), "u", "v", "c"), root).count()
    both = [tables.scan_mean_fields(spark, root, case, components=("u", "v", "c")) for case in ("case0", "case1")]
    return rounded(both[0].unionByName(both[1]), 6, "u", "v", "c")


# case0 keeps its straight mesh; that of case1 is sheared by 0.05 mm a row and 0.03 mm a column
BENT_SQL = f"""
bent AS MATERIALIZED (
  SELECT p.case_id, p.y, p.x, a.mm + CASE p.case_id WHEN 'case1' THEN 0.05 * p.y ELSE 0 END AS x_mm, b.mm + CASE p.case_id WHEN 'case1' THEN 0.03 * p.x ELSE 0 END AS y_mm
  FROM (SELECT DISTINCT case_id, y, x FROM voxel) p {AXES}
)"""


def bent_meshes(spark, sf_dir):
    """Both meshes, written as 2-D arrays of coordinates and read back."""
    straight = select.mesh(axis(spark, sf_dir))
    bend = F.when(F.col("case_id") == "case1", 1.0).otherwise(0.0)
    bent = straight.withColumns({"x_mm": F.col("x_mm") + bend * 0.05 * F.col("y"), "y_mm": F.col("y_mm") + bend * 0.03 * F.col("x")})
    root = new_path(spark, "meshes")
    tables.write_field_arrays(bent.select(*PIXEL, "x_mm", "y_mm"), root, "{case}_{component}.npy").count()
    both = [tables.scan_grid(spark, f"{root}/{case}_x_mm.npy", f"{root}/{case}_y_mm.npy", case_id=case) for case in ("case0", "case1")]
    return both[0].unionByName(both[1])


@query("scan_grid_mesh", f"SELECT case_id, y, x, {r('x_mm', 'x_mm')}, {r('y_mm', 'y_mm')}, case_id = 'case0' AS straight FROM bent", BENT_SQL)
def scan_grid_mesh(spark, sf_dir):
    """2-D meshes with their kind, checked against the size of the fields."""
    grid = bent_meshes(spark, sf_dir)
    kinds = mesh.check_mesh(grid, voxel(spark, sf_dir))
    return rounded(grid.join(kinds.select("case_id", "straight"), "case_id"), 6, "x_mm", "y_mm")


@query("locate_in_mesh", "SELECT case_id, y * 100 + x AS point, CASE WHEN inside THEN cj END AS y, CASE WHEN inside THEN ci END AS x, inside FROM cornered WHERE t = 0 AND case_id = 'case1' "
       "UNION ALL SELECT q.case_id, q.point, j, i, i IS NOT NULL AS inside FROM (SELECT ty.case_id, ty.idx * 100 + tx.idx AS point, tx.mm AS xm, ty.mm AS ym FROM targets ty JOIN targets tx USING (case_id) WHERE ty.dim = 'y' AND tx.dim = 'x' AND case_id = 'case0') q "
       "LEFT JOIN (SELECT x AS i, x_mm AS lo, lead(x_mm) OVER (ORDER BY x) AS hi FROM bent WHERE case_id = 'case0' AND y = 0) c ON q.xm >= lo AND q.xm < hi AND q.ym BETWEEN 4.2 - 0.6 * 9 AND 4.2 "
       "LEFT JOIN (SELECT y AS j, y_mm AS top, lead(y_mm) OVER (ORDER BY y) AS bottom FROM bent WHERE case_id = 'case0' AND x = 0) d ON q.ym <= top AND q.ym > bottom AND i IS NOT NULL",
       TARGET_SQL, LATTICE_SQL, BENT_SQL)
def locate_in_mesh(spark, sf_dir):
    """The cell of each target in a straight and in a curvilinear mesh."""
    grid = bent_meshes(spark, sf_dir)
    targets = select.mesh(target_axes(spark, sf_dir)).withColumn("point", F.col("y") * 100 + F.col("x"))
    return mesh.locate_in_mesh(grid, targets)


@query("train_test_tables", "SELECT part, case_id, dim, idx, " + r("mm", "mm") + ", n FROM axis, (SELECT unnest(['train', 'test']) AS part) JOIN (SELECT CASE WHEN t < 2 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM voxel GROUP BY ALL) USING (part)")
def train_test_tables(spark, sf_dir):
    """A recording split by frames, with its axes in both parts and the number of voxels of the part."""
    root = new_path(spark, "split")
    tables.write_split({"voxel": voxel(spark, sf_dir).select(*VOXEL, "c"), "axis": axis(spark, sf_dir)}, "voxel", 2, root)
    parts = []
    for name in ("train", "test"):
        frames = spark.read.parquet(f"{root}/{name}/voxel").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        parts.append(spark.read.parquet(f"{root}/{name}/axis").withColumn("part", F.lit(name)).join(frames, "part"))
    return rounded(parts[0].unionByName(parts[1]), 6, "mm")


@query("manifest_missing", "SELECT DISTINCT 'absent_' || y || '.npy' AS name FROM voxel WHERE y % 2 = 1")
def manifest_missing(spark, sf_dir):
    """Pairs of files of which some are not there."""
    files = stack_files(spark, sf_dir)
    there = files.agg(F.min("path")).first()[0]
    path = new_path(spark, "pairs")
    rows = voxel(spark, sf_dir).select("y").distinct()
    absent = F.when(F.col("y") % 2 == 1, F.concat(F.lit(there), F.lit(".absent_"), "y", F.lit(".npy"))).otherwise(F.lit(there))
    rows.select(F.concat(F.lit(there), F.lit(" | "), absent).alias("value")).write.text(path)
    missing = tables.missing_inputs(tables.scan_manifest(spark, path))
    return missing.select(F.regexp_extract("path", r"(absent_.*)$", 1).alias("name"))


@query("sink_frames", f"SELECT case_id, t, component, y, x, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM (SELECT case_id, t, y, x, 'u' AS component, u AS value FROM voxel UNION ALL SELECT case_id, t, y, x, 'c', c FROM voxel) "
       "WHERE component = 'c' OR t < 3")
def sink_frames(spark, sf_dir):
    """Frames written to archives in two commits; of one component all are read back, of the other a range."""
    table, path = voxel(spark, sf_dir), new_path(spark, "frames")
    frames = tables.frames_of(table, "u").unionByName(tables.frames_of(table, "c"))
    tables.sink_frames(frames.filter("t < 4"), path)
    tables.sink_frames(frames.filter("t >= 4"), path)
    wanted = tables.scan_frames(spark, path, components=["c"]).unionByName(tables.scan_frames(spark, path, components=["u"], t=(None, 3)))
    return tables.voxels_of(wanted).withColumn("value", F.col("value").cast("double"))
