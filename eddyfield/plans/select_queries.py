"""Crops, masks, coordinates, vectors and joins over the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyfield.functions.scalar import case_from_path, speed
from eddyfield.model import PIXEL, VOXEL
from eddyfield.operators import align, select, stats
from eddyfield.plans.fixture import axis, voxel
from eddyfield.plans.registry import query, r, rounded
from eddyfield.plans.stats_queries import FLUCT_SQL, MEAN_SQL

AXES = "JOIN axis a ON a.case_id = p.case_id AND a.dim = 'x' AND a.idx = p.x JOIN axis b ON b.case_id = p.case_id AND b.dim = 'y' AND b.idx = p.y"


@query("scan_components", "SELECT case_id, t, y, x, u, v, w FROM voxel WHERE case_id = 'case1' AND y BETWEEN 2 AND 7 AND x BETWEEN 5 AND 14")
def scan_components(spark, sf_dir):
    """Velocity of one case, cropped: partitions and row groups prune."""
    one = voxel(spark, sf_dir).filter(F.col("case_id") == "case1")
    return select.roi_index(one, y=(2, 8), x=(5, 15)).select(*VOXEL, "u", "v", "w")


@query("roi_index", "SELECT case_id, t, y, x, c FROM voxel WHERE t >= 1 AND t < 20 AND y >= 1 AND y < 9 AND x >= 3 AND x < 18")
def roi_index(spark, sf_dir):
    return select.roi_index(voxel(spark, sf_dir), t=(1, 20), y=(1, 9), x=(3, 18)).select(*VOXEL, "c")


@query("roi_coords", f"SELECT p.case_id, t, y, x, c, {r('a.mm', 'x_mm')}, {r('b.mm', 'y_mm')} FROM voxel p {AXES} "
       "WHERE a.mm BETWEEN -4.01 AND 3.01 AND b.mm BETWEEN 0.01 AND 3.01")
def roi_coords(spark, sf_dir):
    """Bounds in either order, inclusive."""
    cropped = select.roi_coords(voxel(spark, sf_dir), axis(spark, sf_dir), x_mm=(3.01, -4.01), y_mm=(0.01, 3.01))
    return rounded(cropped.select(*VOXEL, "c", "x_mm", "y_mm"), 6, "x_mm", "y_mm")


@query("roi_bands", f"SELECT p.case_id, t, y, x, c, 0 AS band FROM voxel p {AXES} WHERE a.mm BETWEEN -6.61 AND -2.01 AND b.mm BETWEEN -0.01 AND 9.01 "
       f"UNION ALL SELECT p.case_id, t, y, x, c, 1 FROM voxel p {AXES} WHERE a.mm BETWEEN -3.01 AND 6.01 AND b.mm BETWEEN -0.01 AND 9.01")
def roi_bands(spark, sf_dir):
    """Two overlapping bands: samples in both count twice."""
    bands = select.roi_bands(voxel(spark, sf_dir), axis(spark, sf_dir), [(-6.61, -2.01), (-3.01, 6.01)], (-0.01, 9.01))
    return bands.select(*VOXEL, "c", "band")


@query("union_bands", f"SELECT case_id, band, count(*) AS n, count(c) AS present FROM (SELECT p.case_id, 0 AS band, c FROM voxel p {AXES} WHERE a.mm BETWEEN -6.61 AND -2.01 "
       f"UNION ALL SELECT p.case_id, 1, c FROM voxel p {AXES} WHERE a.mm BETWEEN 2.01 AND 6.01) GROUP BY ALL")
def union_bands(spark, sf_dir):
    bands = select.roi_bands(voxel(spark, sf_dir), axis(spark, sf_dir), [(-6.61, -2.01), (2.01, 6.01)], (-100.0, 100.0))
    return bands.groupBy("case_id", "band").agg(F.count("*").alias("n"), F.count("c").alias("present"))


@query("frame_pick", "SELECT case_id, y, x, u, v, w, c FROM voxel WHERE t = 1")
def frame_pick(spark, sf_dir):
    return select.frame_pick(voxel(spark, sf_dir), 1).select(*PIXEL, "u", "v", "w", "c")


@query("pixel_series", "SELECT case_id, t, c FROM voxel WHERE y = 4 AND x = 7")
def pixel_series(spark, sf_dir):
    return select.pixel_series(voxel(spark, sf_dir), 4, 7)


@query("mask_below", "SELECT case_id, t, y, x, CASE WHEN c >= 0.1 THEN c END AS c, CASE WHEN abs(u) >= 0.2 THEN u END AS u FROM voxel")
def mask_below(spark, sf_dir):
    masked = select.mask_below(voxel(spark, sf_dir), "c", 0.1)
    return select.mask_below(masked, "u", 0.2, magnitude=True).select(*VOXEL, "c", "u")


@query("clamp_low", "SELECT case_id, t, y, x, CASE WHEN v IS NOT NULL THEN greatest(v, -0.1) END AS v, CASE WHEN w IS NOT NULL THEN greatest(w, low) END AS w "
       "FROM voxel JOIN (SELECT case_id, min(w) AS low FROM voxel GROUP BY ALL) USING (case_id)")
def clamp_low(spark, sf_dir):
    return select.clamp_low(select.clamp_low(voxel(spark, sf_dir), "v", -0.1), "w").select(*VOXEL, "v", "w")


@query("point_patch", f"SELECT case_id, y, x, {r('CASE WHEN w = min(w) OVER (PARTITION BY case_id) THEN 0 ELSE w END', 'w')} FROM mean_field", MEAN_SQL)
def point_patch(spark, sf_dir):
    """The pixels of the smallest mean w of each case are set to zero."""
    from eddyfield.session import settle

    field = settle(align.mean_field(voxel(spark, sf_dir), "w"), "mean")
    lowest = field.groupBy("case_id").agg(F.min("w").alias("w"))
    patch = field.join(lowest, ["case_id", "w"]).select(*PIXEL, F.lit(0.0).alias("new_value"))
    return rounded(select.point_patch(field, patch, "w").select(*PIXEL, "w"), 6, "w")


@query("affine_coords", f"SELECT DISTINCT case_id, x, {r('-150 + 0.317::DOUBLE * 6 * x', 'x_mm')}, {r('(-150 + 0.317::DOUBLE * 6 * x) / 1000', 'x_m')}, "
       f"y, {r('(12 - 0.317::DOUBLE * y) + 150', 'y_mm')}, {r('0 - 0.317::DOUBLE * y', 'y_down')} FROM voxel")
def affine_coords(spark, sf_dir):
    """Offset + slope * stride * index; in metres; shifted; and the downward variant."""
    pixels = voxel(spark, sf_dir).select("case_id", "y", "x").distinct()
    out = select.affine_coords(pixels, "x", -150.0, 0.317, stride=6, out="x_mm")
    out = select.affine_coords(out, "x", -150.0, 0.317, stride=6, unit=1e-3, out="x_m")
    out = select.affine_coords(out, "y", 12.0, -0.317, shift=150.0, out="y_mm")
    out = select.affine_coords(out, "y", 0.0, -0.317, out="y_down")
    return rounded(out, 6, "x_mm", "x_m", "y_mm", "y_down")


GRID_SQL = """
bounds AS (SELECT case_id, dim, least(min(mm), 0) AS lo, max(mm) AS hi FROM axis GROUP BY ALL),
targets AS (
  SELECT case_id, dim, i AS idx, CASE WHEN i = n - 1 THEN hi ELSE lo + i * ((hi - lo) / (n - 1)) END AS mm
  FROM (SELECT *, CASE dim WHEN 'x' THEN 27 ELSE 16 END AS n FROM bounds), range(27) g(i) WHERE i < n
)"""


@query("make_target_grid", f"SELECT a.case_id, CAST(b.idx AS INTEGER) AS y, CAST(a.idx AS INTEGER) AS x, {r('a.mm', 'x_mm')}, {r('b.mm', 'y_mm')} FROM targets a JOIN targets b "
       "ON a.case_id = b.case_id AND a.dim = 'x' AND b.dim = 'y'", GRID_SQL)
def make_target_grid(spark, sf_dir):
    return rounded(select.make_target_grid(axis(spark, sf_dir), nx=27, ny=16), 6, "x_mm", "y_mm")


@query("make_step_grid", f"SELECT case_id, dim, CAST(i AS INTEGER) AS idx, {r('i * 0.5::DOUBLE', 'mm')} FROM (SELECT case_id, dim, "
       "CASE WHEN dim = 'x' THEN 14.0 ELSE 6.0 END AS size FROM axis GROUP BY ALL), range(40) g(i) WHERE i < ceil(floor(round(size, 6)) / 0.5)")
def make_step_grid(spark, sf_dir):
    """Half-millimetre points below the whole part of the extent."""
    table = axis(spark, sf_dir).withColumn("mm", F.round("mm", 6))
    return rounded(select.step_axis(table, "x", 0.5).unionByName(select.step_axis(table, "y", 0.5)), 6, "mm")


@query("scan_grid", f"SELECT p.case_id, y, x, {r('a.mm', 'x_mm')}, {r('b.mm', 'y_mm')} FROM (SELECT DISTINCT case_id, y, x FROM voxel) p {AXES}")
def scan_grid(spark, sf_dir):
    """1-D axes become a mesh."""
    return rounded(select.mesh(axis(spark, sf_dir)), 6, "x_mm", "y_mm")


@query("axis_ascending", f"SELECT case_id, dim, idx AS old_idx, CAST(row_number() OVER (PARTITION BY case_id, dim ORDER BY mm) - 1 AS INTEGER) AS idx, {r('mm', 'mm')} FROM axis")
def axis_ascending(spark, sf_dir):
    return rounded(select.ascending(axis(spark, sf_dir)), 6, "mm")


@query("speed", f"SELECT case_id, t, y, x, {r('sqrt(u * u + v * v)', 'speed2')}, {r('sqrt(u * u + v * v + w * w)', 'speed3')} FROM voxel")
def speed_query(spark, sf_dir):
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    out = voxel(spark, sf_dir).select(*VOXEL, speed(u, v).alias("speed2"), speed(u, v, w).alias("speed3"))
    return rounded(out, 6, "speed2", "speed3")


@query("direction", f"SELECT case_id, y, x, {r('CASE WHEN m >= 0.05 THEN u / greatest(m, 1e-12) END', 'u_dir')}, {r('CASE WHEN m >= 0.05 THEN v / greatest(m, 1e-12) END', 'v_dir')}, "
       "CASE WHEN abs(u) >= 0.05 THEN CAST(sign(u) AS DOUBLE) END AS sign FROM (SELECT *, sqrt(u * u + v * v) AS m FROM mean_field)", MEAN_SQL)
def direction(spark, sf_dir):
    field = align.mean_field(voxel(spark, sf_dir), "u", "v")
    out = select.sign_direction(select.direction(field, "u", "v", 0.05), "u", 0.05)
    return rounded(out.select(*PIXEL, "u_dir", "v_dir", "sign"), 6, "u_dir", "v_dir")


@query("log_scaled_vectors", f"SELECT case_id, y, x, {r('lm', 'log_magnitude')}, {r('u / m * len', 'u_arrow')}, {r('v / m * len', 'v_arrow')} FROM ("
       "SELECT *, 0.5 + 0.5 * (lm - min(lm) OVER (PARTITION BY case_id)) / (max(lm) OVER (PARTITION BY case_id) - min(lm) OVER (PARTITION BY case_id)) AS len FROM ("
       "SELECT *, log10(greatest(m, 1e-12)) AS lm FROM (SELECT *, CASE WHEN sqrt(u * u + v * v) >= 0.05 THEN sqrt(u * u + v * v) END AS m FROM mean_field) WHERE m IS NOT NULL) "
       "UNION ALL SELECT *, NULL, NULL FROM (SELECT *, CASE WHEN sqrt(u * u + v * v) >= 0.05 THEN sqrt(u * u + v * v) END AS m FROM mean_field) WHERE m IS NULL)", MEAN_SQL)
def log_scaled_vectors(spark, sf_dir):
    field = align.mean_field(voxel(spark, sf_dir), "u", "v")
    out = select.log_scaled_vectors(field, "u", "v", threshold=0.05)
    return rounded(out.select(*PIXEL, "log_magnitude", "u_arrow", "v_arrow"), 6, "log_magnitude", "u_arrow", "v_arrow")


@query("decimate", "SELECT case_id, t, y, x, u, v FROM voxel WHERE y % 3 = 0 AND x % 4 = 0 AND u IS NOT NULL AND v IS NOT NULL")
def decimate(spark, sf_dir):
    return select.decimate(voxel(spark, sf_dir), 3, 4).select(*VOXEL, "u", "v")


@query("fluctuation_snapshot", f"SELECT p.case_id, p.y, p.x, {r('p.w - m.w', 'w_fluct')}, {r('p.c - m.c', 'c_fluct')}, {r('(p.w - m.w) * (p.c - m.c)', 'wc_fluct')} "
       "FROM voxel p JOIN mean_field m ON p.case_id = m.case_id AND p.y = m.y AND p.x = m.x WHERE t = 1", MEAN_SQL)
def fluctuation_snapshot(spark, sf_dir):
    return rounded(select.fluctuation_snapshot(voxel(spark, sf_dir), 1), 6, "w_fluct", "c_fluct", "wc_fluct")


@query("box_region", f"SELECT p.case_id, y, x, {r('sqrt(u * u + v * v)', 'speed')}, (a.mm >= xl + 0.21 * xs AND a.mm <= xl + 0.74 * xs AND b.mm >= yl + 0.13 * ys AND b.mm <= yl + 0.62 * ys) AS in_box "
       f"FROM mean_field p {AXES} JOIN (SELECT case_id, min(mm) FILTER (dim = 'x') AS xl, max(mm) FILTER (dim = 'x') - min(mm) FILTER (dim = 'x') AS xs, "
       "min(mm) FILTER (dim = 'y') AS yl, max(mm) FILTER (dim = 'y') - min(mm) FILTER (dim = 'y') AS ys FROM axis GROUP BY ALL) s ON s.case_id = p.case_id", MEAN_SQL)
def box_region(spark, sf_dir):
    field = align.mean_field(voxel(spark, sf_dir), "u", "v")
    out = select.box_region(field, axis(spark, sf_dir), (0.21, 0.74, 0.13, 0.62))
    return rounded(out.select(*PIXEL, "speed", "in_box"), 6, "speed")


@query("normalise_max", f"SELECT case_id, t, y, x, {r('c / top - m / top', 'c', 8)} FROM voxel JOIN (SELECT case_id, max(c) AS top FROM voxel GROUP BY ALL) USING (case_id) "
       "JOIN (SELECT case_id, y, x, avg(c) AS m FROM voxel GROUP BY ALL) USING (case_id, y, x)")
def normalise_max(spark, sf_dir):
    return rounded(select.normalise_max(voxel(spark, sf_dir)).select(*VOXEL, "c"), 8, "c")


@query("zscore_field", "SELECT case_id, y, x, " + ", ".join(r(f"CASE WHEN stddev_pop({k}) OVER (PARTITION BY case_id) < 1e-12 THEN 0 ELSE "
       f"({k} - avg({k}) OVER (PARTITION BY case_id)) / stddev_pop({k}) OVER (PARTITION BY case_id) END", k) for k in ("u", "c")) + " FROM mean_field", MEAN_SQL)
def zscore_field(spark, sf_dir):
    field = align.mean_field(voxel(spark, sf_dir), "u", "c")
    return rounded(select.zscore_field(field, "u", "c").select(*PIXEL, "u", "c"), 6, "u", "c")


@query("join_fields", "SELECT case_id, t, y, x, u, v, w, c FROM voxel WHERE y BETWEEN 3 AND 8")
def join_fields(spark, sf_dir):
    """Velocity trimmed to six rows and renumbered, beside the full scalar."""
    table = voxel(spark, sf_dir)
    trimmed = table.filter((F.col("y") >= 3) & (F.col("y") < 9)).select("case_id", "t", (F.col("y") - 3).alias("y"), "x", "u", "v", "w")
    return align.join_fields(trimmed, table.select(*VOXEL, "c"), y_offset=3, n_rows=6)


@query("join_fields_trimmed", "SELECT case_id, t, y, x, u, v, w, c FROM voxel WHERE x < 17 AND t < (SELECT max(t) FROM voxel WHERE case_id = 'case0')")
def join_fields_trimmed(spark, sf_dir):
    """The velocity misses the last columns, the scalar the last frame: both are cut to what they share."""
    table = voxel(spark, sf_dir)
    last = table.filter("case_id = 'case0'").agg(F.max("t")).first()[0]
    velocity = table.filter("x < 17").select(*VOXEL, "u", "v", "w")
    return align.join_fields(velocity, table.filter(F.col("t") < last).select(*VOXEL, "c"), trim=("t", "x"))


@query("join_mean", f"SELECT p.case_id, p.t, p.y, p.x, p.c, {r('m.c', 'c_mean')} FROM voxel p JOIN mean_field m ON p.case_id = m.case_id AND p.y = m.y AND p.x = m.x", MEAN_SQL)
def join_mean(spark, sf_dir):
    table = voxel(spark, sf_dir)
    means = align.mean_field(table, "c").withColumnRenamed("c", "c_mean")
    return rounded(align.join_mean(table.select(*VOXEL, "c"), means), 6, "c_mean")


@query("reynolds", f"SELECT case_id, t, y, x, {r('u', 'u')}, {r('v', 'v')}, {r('w', 'w')} FROM fluct", MEAN_SQL, FLUCT_SQL)
def reynolds(spark, sf_dir):
    return rounded(align.reynolds(voxel(spark, sf_dir)).select(*VOXEL, "u", "v", "w"), 6, "u", "v", "w")


@query("refresh_fluctuation", f"SELECT p.case_id, p.t, p.y - 2 AS y, p.x, {r('p.w - m.w', 'w')} FROM voxel p JOIN mean_field m ON p.case_id = m.case_id AND p.y = m.y AND p.x = m.x "
       "WHERE p.y BETWEEN 2 AND 6", MEAN_SQL)
def refresh_fluctuation(spark, sf_dir):
    table = voxel(spark, sf_dir)
    return rounded(align.refresh_fluctuation(table, align.mean_field(table, "w"), (2, 7)), 6, "w")


@query("join_envelope", "SELECT case_id, inside, count(*) AS samples, count(c) AS present FROM voxel JOIN "
       "(SELECT case_id, y, x, coalesce(count_if(c > 0.25)::DOUBLE / nullif(count(c), 0), 0) >= 0.25 AS inside FROM voxel GROUP BY ALL) USING (case_id, y, x) GROUP BY ALL")
def join_envelope(spark, sf_dir):
    """Samples inside and outside the plume."""
    table = voxel(spark, sf_dir)
    tagged = align.join_envelope(table, stats.intermittency(table, 0.25), cutoff=0.25)
    return tagged.groupBy("case_id", "inside").agg(F.count("*").alias("samples"), F.count("c").alias("present"))


@query("nearest_coord", f"SELECT case_id, dim, target, idx, {r('mm', 'mm')} FROM (SELECT a.case_id, a.dim, q.target, a.idx, a.mm, row_number() OVER "
       "(PARTITION BY a.case_id, a.dim, q.target ORDER BY abs(a.mm - q.target), a.idx) AS k FROM axis a JOIN (SELECT DISTINCT case_id, dim, idx * 0.83::DOUBLE - 7.1::DOUBLE AS target FROM axis) q "
       "ON a.case_id = q.case_id AND a.dim = q.dim) WHERE k = 1")
def nearest_coord(spark, sf_dir):
    """Closest pixel to each of a series of targets, some beyond both ends."""
    table = axis(spark, sf_dir)
    targets = table.select("case_id", "dim", (F.col("idx") * F.lit(0.83) - F.lit(7.1)).alias("target"))
    return rounded(align.nearest_coord(table, targets), 6, "mm")


@query("frame_count_check", "SELECT k AS source, case_id, count(DISTINCT t) AS frames FROM voxel, (VALUES ('u'), ('v'), ('c')) s(k) GROUP BY ALL")
def frame_count_check(spark, sf_dir):
    table = voxel(spark, sf_dir)
    return align.frame_count_check({k: table.select("case_id", "t", k) for k in ("u", "v", "c")})


@query("skip_missing_case", "SELECT case_id, count(*) AS samples FROM voxel WHERE case_id IN ('case1', 'absent') GROUP BY ALL")
def skip_missing_case(spark, sf_dir):
    """Two wanted cases, one without data."""
    table = voxel(spark, sf_dir)
    wanted = table.groupBy("case_id").agg(F.count("*").alias("n")).select(
        F.when(F.col("case_id") == "case0", F.lit("absent")).otherwise(F.col("case_id")).alias("case_id")
    )
    return align.skip_missing_case(wanted, table).groupBy("case_id").agg(F.count("*").alias("samples"))


@query("missing_cases", "SELECT w AS case_id, w IN (SELECT case_id FROM voxel) AS has_data FROM (VALUES ('absent'), ('case1')) k(w)")
def missing_cases(spark, sf_dir):
    """The report of which wanted cases have data."""
    table = voxel(spark, sf_dir)
    wanted = table.groupBy("case_id").agg(F.count("*").alias("n")).select(
        F.when(F.col("case_id") == "case0", F.lit("absent")).otherwise(F.col("case_id")).alias("case_id")
    )
    return align.available_cases(wanted, table)


@query("avg_components", f"SELECT case_id, y, x, {r('0.5 * (u + v)', 'scale')} FROM mean_field", MEAN_SQL)
def avg_components(spark, sf_dir):
    table = voxel(spark, sf_dir)
    return rounded(align.avg_columns(align.mean_field(table, "u", "v"), "u", "v", "scale"), 6, "scale")


@query("case_from_path", "SELECT DISTINCT 'E/means/mean_fields_' || case_id || '_' || x || '.npz' AS path, case_id || '_' || x AS case_name, NULL::VARCHAR AS flux_case FROM voxel "
       "UNION ALL SELECT DISTINCT 'w_flx_' || case_id || '_FINAL_AllTimeSteps_' || y || '.npy', NULL, case_id FROM voxel")
def case_from_path_query(spark, sf_dir):
    """Case names out of two naming conventions (fixed values: the two forms of file names)."""
    pixels = voxel(spark, sf_dir).select("case_id", "y", "x").distinct()
    means = pixels.select(F.concat(F.lit("E/means/mean_fields_"), "case_id", F.lit("_"), "x", F.lit(".npz")).alias("path"))
    fluxes = pixels.select(F.concat(F.lit("w_flx_"), "case_id", F.lit("_FINAL_AllTimeSteps_"), "y", F.lit(".npy")).alias("path"))
    paths = means.unionByName(fluxes).distinct()
    return paths.select(
        "path",
        case_from_path(F.col("path"), "mean_fields", r"\.npz$").alias("case_name"),
        case_from_path(F.col("path"), "w_flx", "_FINAL").alias("flux_case"),
    )
