"""Distributions, reports and profiles over the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyfield.model import PIXEL
from eddyfield.operators import align, distribution, profile, select, stats, turbulence
from eddyfield.plans.fixture import _once, axis, voxel
from eddyfield.plans.registry import query, r, rounded
from eddyfield.plans.select_queries import AXES
from eddyfield.plans.stats_queries import MEAN_SQL, TURBULENCE
from eddyfield.session import settle

CASE_PIXEL = ["case_id", "y", "x"]


def pdf_sql(keys: str, width: float) -> str:
    on = " AND ".join(f"p.{k} = e.{k}" for k in keys.split(", "))
    of = ", ".join(f"e.{k}" for k in keys.split(", "))
    w = f"{width}::DOUBLE"
    return f"""
edges AS (
  SELECT {keys}, CAST(i AS INTEGER) AS bin, i * {w} AS l, (i + 1) * {w} AS rt, n_bins
  FROM (SELECT {keys}, CAST(ceil((max(c) + {w}) / {w}) AS INTEGER) - 1 AS n_bins FROM voxel GROUP BY ALL HAVING count(c) > 0), range(200) g(i) WHERE i < n_bins
),
counted AS (
  SELECT {of}, e.bin, e.l, e.rt, count(p.c) AS n FROM edges e LEFT JOIN voxel p ON {on} AND p.c >= e.l AND (p.c < e.rt OR (e.bin = n_bins - 1 AND p.c <= e.rt)) GROUP BY ALL
)"""


PDF = "bin, {l}, {rt}, {center}, n, {pdf} FROM counted".format(
    l=r("l", "left"), rt=r("rt", "right"), center=r("0.5 * (l + rt)", "center"), pdf=r("n::DOUBLE / sum(n) OVER (PARTITION BY %s) / (rt - l)", "pdf")
)


@query("concentration_pdf", "SELECT case_id, y, x, " + PDF % "case_id, y, x", pdf_sql("case_id, y, x", 0.07))
def concentration_pdf(spark, sf_dir):
    """One density per pixel."""
    out = distribution.concentration_pdf(voxel(spark, sf_dir), CASE_PIXEL, 0.07)
    return rounded(out, 6, "left", "right", "center", "pdf")


@query("concentration_pdf_case", "SELECT case_id, " + PDF % "case_id", pdf_sql("case_id", 0.02))
def concentration_pdf_case(spark, sf_dir):
    """One density per case: a group holds half of all rows."""
    out = distribution.concentration_pdf(voxel(spark, sf_dir), ["case_id"], 0.02)
    return rounded(out, 6, "left", "right", "center", "pdf")


def bins_sql(keys: str, bins: int, low: str, high: str) -> str:
    """Counts per even bin by comparing every sample with every edge."""
    on = " AND ".join(f"p.{k} = e.{k}" for k in keys.split(", "))
    of = ", ".join(f"e.{k}" for k in keys.split(", "))
    w = f"((high - low) / {bins}.0::DOUBLE)"
    return f"""
edges AS (
  SELECT {keys}, CAST(i AS INTEGER) AS bin, low + i * {w} AS l, CASE WHEN i = {bins} - 1 THEN high ELSE low + (i + 1) * {w} END AS rt
  FROM (SELECT {keys}, {low} AS low, {high} AS high FROM voxel GROUP BY ALL), range({bins}) g(i)
),
counted AS (
  SELECT {of}, e.bin, e.l, e.rt, count(p.c) AS n FROM edges e LEFT JOIN voxel p ON {on} AND p.c >= e.l AND (p.c < e.rt OR (e.bin = {bins} - 1 AND p.c <= e.rt)) GROUP BY ALL
)"""


BINNED = PDF.replace("n::DOUBLE / sum(n) OVER (PARTITION BY %s)", "n::DOUBLE / nullif(sum(n) OVER (PARTITION BY %s), 0)")


@query("concentration_pdf_bins", "SELECT case_id, " + BINNED % "case_id", bins_sql("case_id", 40, "min(c)", "max(c)"))
def concentration_pdf_bins(spark, sf_dir):
    """Forty even bins from the smallest to the largest sample of each case."""
    out = distribution.pdf_by_bins(voxel(spark, sf_dir), ["case_id"], 40)
    return rounded(out, 6, "left", "right", "center", "pdf")


@query("concentration_pdf_range", "SELECT case_id, t, y, " + BINNED % "case_id, t, y", bins_sql("case_id, t, y", 3, "0.7::DOUBLE", "0.95::DOUBLE"))
def concentration_pdf_range(spark, sf_dir):
    """A fixed range; rows of a frame without a sample in it keep their bins."""
    out = distribution.pdf_by_bins(voxel(spark, sf_dir), ["case_id", "t", "y"], 3, (0.7, 0.95))
    return rounded(out, 6, "left", "right", "center", "pdf")


@query("gamma_fit", "SELECT case_id, y, x, CAST(point AS INTEGER) AS point, " + ", ".join([
    r("m", "mean", 9), r("s", "std", 9), r("i", "intensity", 9), r("k", "k", 9), r("v", "value", 9),
    r("exp(k * ln(k) - lgamma(k) + (k - 1) * ln(v / m) - k * v / m - ln(m))", "pdf", 9)])
    + " FROM (SELECT *, CASE WHEN i > 0 AND m > 0 THEN 1 / (i * i) END AS k FROM (SELECT *, s / nullif(m, 0) AS i FROM (SELECT case_id, y, x, avg(c) AS m, stddev_pop(c) AS s FROM voxel GROUP BY ALL))), "
      "(SELECT i AS point, 0.03::DOUBLE + i * (0.9::DOUBLE - 0.03::DOUBLE) / 9 AS v FROM range(10) g(i))")
def gamma_fit(spark, sf_dir):
    out = distribution.gamma_fit(voxel(spark, sf_dir), CASE_PIXEL, 10, 0.03, 0.9)
    return rounded(out, 9, "mean", "std", "intensity", "k", "value", "pdf")


def report_sql(metric: str, source: str, keys: str) -> str:
    names = ", ".join(r(f"quantile_cont({metric}, {q / 100.0})", f"p{q}", 4) for q in (0, 10, 25, 50, 75, 90, 100))
    group = f" GROUP BY {keys}"
    return (f"SELECT {keys}, '{metric}' AS metric, count({metric}) AS pixels, {r(f'avg({metric})', 'mean')}, "
            f"{r(f'quantile_cont({metric}, 0.5)', 'median', 4)}, {names} FROM {source}{group}")


def report_rounded(report):
    quantiles = [c for c in report.columns if c == "median" or (c[0] == "p" and c[1:].isdigit())]
    return rounded(rounded(report, 4, *quantiles), 6, "mean")


ENERGY_SQL = "energy AS MATERIALIZED (SELECT *, 0.5 * (u2 + v2 + w2) AS tke, sqrt((u2 + v2 + w2) / 3) / 0.30 AS intensity FROM squares)"


@query("field_report", report_sql("tke", "energy", "case_id") + " UNION ALL " + report_sql("intensity", "energy", "case_id"), *TURBULENCE, ENERGY_SQL)
def field_report(spark, sf_dir):
    energy = turbulence.energy_fields(turbulence.mean_squares(voxel(spark, sf_dir)))
    return report_rounded(distribution.field_report(energy, "tke", "intensity"))


ENVELOPE_SQL = ("envelope AS MATERIALIZED (SELECT case_id, y, x, coalesce(count_if(c > 0.25)::DOUBLE / nullif(count(c), 0), 0) >= 0.25 AS inside FROM voxel GROUP BY ALL),"
                "tagged AS MATERIALIZED (SELECT * FROM energy JOIN envelope USING (case_id, y, x))")


@query("region_report", "SELECT NULL AS inside, * FROM (" + report_sql("tke", "tagged", "case_id") + ") UNION ALL BY NAME " + report_sql("tke", "tagged", "case_id, inside"),
       *TURBULENCE, ENERGY_SQL, ENVELOPE_SQL)
def region_report(spark, sf_dir):
    """The whole field, inside and outside the plume."""
    # one aggregate gives the mean squares and the plume
    moments = voxel(spark, sf_dir).groupBy(*PIXEL).agg(*turbulence.square_terms(), stats.intermittency_term(0.25))
    squares = moments.select(*PIXEL, *turbulence.square_columns(), (F.col("intermittency") >= 0.25).alias("inside"))
    tagged = turbulence.tke(squares)
    return report_rounded(distribution.region_report(tagged, "tke"))


BANDS_SQL = (f"bands AS MATERIALIZED (SELECT p.case_id, {{v}} AS v FROM voxel p {AXES} WHERE a.mm BETWEEN -6.61 AND -2.01 AND b.mm BETWEEN -0.01 AND 9.01 "
             f"UNION ALL SELECT p.case_id, {{v}} FROM voxel p {AXES} WHERE a.mm BETWEEN -3.01 AND 6.01 AND b.mm BETWEEN -0.01 AND 9.01)")
NOISE = [0.1, 5, 25, 50, 90, 95, 99, 99.9, 100]


def noise_sql() -> str:
    quantiles = ", ".join(r(f"CASE WHEN ok THEN quantile_cont END[{i + 1}]", f"p{str(q).replace('.', '_')}", 4) for i, q in enumerate(NOISE))
    share = ", ".join(str(q / 100.0) for q in NOISE)
    return (f"SELECT case_id, {quantiles}, {r('CASE WHEN ok THEN rms END', 'rms')}, {r('CASE WHEN ok THEN mean END', 'mean')}, "
            f"{r('CASE WHEN ok THEN variance END', 'variance')}, {r('CASE WHEN ok THEN std END', 'std')} FROM (SELECT case_id, count(v) = count(*) AS ok, "
            f"quantile_cont(v, [{share}]) AS quantile_cont, sqrt(avg(v * v)) AS rms, avg(v) AS mean, var_pop(v) AS variance, stddev_pop(v) AS std FROM bands GROUP BY ALL)")


def bands_of(spark, sf_dir, value):
    banded = select.roi_bands(voxel(spark, sf_dir), axis(spark, sf_dir), [(-6.61, -2.01), (-3.01, 6.01)], (-0.01, 9.01))
    return banded.select("case_id", value.alias("v"))


@query("noise_report", noise_sql(), BANDS_SQL.format(v="u"))
def noise_report(spark, sf_dir):
    """Background of u, which has no gaps."""
    out = distribution.noise_report(bands_of(spark, sf_dir, F.col("u")), "v")
    return rounded(out, 6, "rms", "mean", "variance", "std")


@query("noise_report_gaps", noise_sql(), BANDS_SQL.format(v="c"))
def noise_report_gaps(spark, sf_dir):
    """Background of c: a missing sample makes the report missing."""
    out = distribution.noise_report(bands_of(spark, sf_dir, F.col("c")), "v")
    return rounded(out, 6, "rms", "mean", "variance", "std")


EDGES = [0.0, 0.005, 0.02, 0.05, 0.1, 0.101, 0.3, 0.75, 1.2]


@query("noise_histogram", "SELECT case_id, bin, l AS left, rt AS right, n, " + r("n::DOUBLE / sum(n) OVER (PARTITION BY case_id) / (rt - l)", "pdf") + " FROM (SELECT k.case_id, e.bin, e.l, e.rt, count(b.v) AS n "
       "FROM (SELECT DISTINCT case_id FROM bands) k CROSS JOIN (VALUES " + ", ".join(f"({i}, {EDGES[i]}::DOUBLE, {EDGES[i + 1]}::DOUBLE)" for i in range(len(EDGES) - 1)) + ") e(bin, l, rt) "
       f"LEFT JOIN bands b ON b.case_id = k.case_id AND b.v >= e.l AND (b.v < e.rt OR (e.bin = {len(EDGES) - 2} AND b.v <= e.rt)) GROUP BY ALL)", BANDS_SQL.format(v="c"))
def noise_histogram(spark, sf_dir):
    return rounded(distribution.histogram_density(bands_of(spark, sf_dir, F.col("c")), ["case_id"], EDGES, "v"), 6, "pdf")


@query("field_extent", f"SELECT case_id, {r('min(w)', 'min')}, {r('max(w)', 'max')}, {r('avg(w)', 'mean')}, {r('median(w)', 'median', 4)}, "
       "arg_min(y, w) AS min_y, arg_min(x, w) AS min_x FROM mean_field GROUP BY ALL", MEAN_SQL)
def field_extent(spark, sf_dir):
    out = distribution.field_extent(align.mean_field(voxel(spark, sf_dir), "w"), "w")
    return rounded(rounded(out, 6, "min", "max", "mean"), 4, "median")


@query("colour_limits", f"SELECT case_id, 'symmetric' AS scale, {r('-max(greatest(abs(u), abs(v)))', 'vmin', 4)}, {r('max(greatest(abs(u), abs(v)))', 'vmax', 4)} FROM mean_field GROUP BY ALL "
       f"UNION ALL SELECT case_id, 'positive', {r('quantile_cont(u, 0.01)', 'vmin', 4)}, {r('quantile_cont(u, 0.99)', 'vmax', 4)} FROM mean_field WHERE u > 0 GROUP BY ALL "
       f"UNION ALL SELECT case_id, 'values', {r('min(c)', 'vmin', 4)}, {r('max(c)', 'vmax', 4)} FROM mean_field GROUP BY ALL", MEAN_SQL)
def colour_limits(spark, sf_dir):
    field = settle(align.mean_field(voxel(spark, sf_dir)), "mean")
    parts = [
        (distribution.symmetric_limits(field, "u", "v"), "symmetric"),
        (distribution.positive_limits(field, "u"), "positive"),
        (distribution.value_limits(field, "c"), "values"),
    ]
    tagged = [part.select("case_id", F.lit(name).alias("scale"), "vmin", "vmax") for part, name in parts]
    return rounded(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]), 4, "vmin", "vmax")


ROWS_SQL = "rows_of AS MATERIALIZED (SELECT case_id, y AS pos, avg(c) AS value FROM mean_field GROUP BY ALL)"


@query("row_profile", f"SELECT case_id, (pos // 3) * 3 + 1.0::DOUBLE AS pos, {r('avg(value)', 'value')} FROM rows_of WHERE pos < 9 GROUP BY case_id, pos // 3", MEAN_SQL, ROWS_SQL)
def row_profile(spark, sf_dir):
    """Groups of three rows; the tenth row is dropped."""
    return rounded(profile.row_profile(align.mean_field(voxel(spark, sf_dir), "c"), "c", 3), 6, "value")


def smooth_sql(k: int) -> str:
    pad, points = k // 2, 10 + 2 * (k // 2) - k + 1
    return (f"smooth AS MATERIALIZED (SELECT k.case_id, CAST(j AS INTEGER) AS pos, avg(value) AS value FROM (SELECT DISTINCT case_id FROM rows_of) k, range({points}) g(j), range({k}) h(o), rows_of p "
            f"WHERE p.case_id = k.case_id AND p.pos = greatest(0, least(9, j + o - {pad})) GROUP BY ALL)")


@query("moving_average", f"SELECT case_id, pos, {r('value', 'value')} FROM smooth", MEAN_SQL, ROWS_SQL, smooth_sql(5))
def moving_average(spark, sf_dir):
    rows = profile.row_profile(align.mean_field(voxel(spark, sf_dir), "c"), "c")
    return rounded(profile.moving_average(rows, 5), 6, "value")


@query("moving_average_even", f"SELECT case_id, pos, {r('value', 'value')} FROM smooth", MEAN_SQL, ROWS_SQL, smooth_sql(4))
def moving_average_even(spark, sf_dir):
    """An even window gives one point more than the profile has."""
    rows = profile.row_profile(align.mean_field(voxel(spark, sf_dir), "c"), "c")
    return rounded(profile.moving_average(rows, 4), 6, "value")


@query("row_smooth_profile", f"SELECT case_id, pos, 9 - pos AS shown, {r('value', 'value')} FROM smooth WHERE pos >= 2", MEAN_SQL, ROWS_SQL, smooth_sql(3))
def row_smooth_profile(spark, sf_dir):
    return rounded(profile.row_smooth_profile(align.mean_field(voxel(spark, sf_dir), "c"), "c", 3, skip=2), 6, "value")


@query("even_sample", f"SELECT case_id, CAST(pos AS DOUBLE) AS pos, {r('value', 'value')} FROM rows_of WHERE pos IN (SELECT CAST(floor(i * 9 / 6.0) AS INTEGER) FROM range(7) g(i))", MEAN_SQL, ROWS_SQL)
def even_sample(spark, sf_dir):
    rows = profile.row_profile(align.mean_field(voxel(spark, sf_dir), "c"), "c")
    return rounded(profile.even_sample(rows, 7), 6, "value")


LATERAL_SQL = """
near AS (SELECT q.case_id, q.target, arg_min(a.idx, abs(a.mm - q.target)) AS idx, arg_min(a.mm, abs(a.mm - q.target)) AS nearest_mm
  FROM (SELECT case_id, mm - 0.13::DOUBLE AS target FROM axis WHERE dim = 'y') q JOIN axis a ON a.case_id = q.case_id AND a.dim = 'y' GROUP BY ALL),
lateral_profile AS MATERIALIZED (
  SELECT n.case_id, n.target, n.nearest_mm, f.x, a.mm AS x_mm, avg(f.c) AS value FROM near n JOIN mean_field f ON f.case_id = n.case_id AND f.y BETWEEN n.idx - 1 AND n.idx + 1
  JOIN axis a ON a.case_id = n.case_id AND a.dim = 'x' AND a.idx = f.x WHERE a.mm BETWEEN -5.01 AND 4.01 GROUP BY ALL HAVING count(f.c) > 0
)"""


def lateral_of(spark, sf_dir):
    """A profile 0.13 mm beside every row, over three rows."""
    table, axes = voxel(spark, sf_dir), axis(spark, sf_dir)
    targets = axes.filter("dim = 'y'").select("case_id", (F.col("mm") - F.lit(0.13)).alias("target"))
    return profile.lateral_profile(align.mean_field(table, "c"), axes, targets, "c", reach=1, x_mm=(-5.01, 4.01))


def stored_lateral(spark, sf_dir):
    """The same profiles, stored once for the queries that go on from them."""
    return _once(spark, sf_dir, "lateral", lambda: settle(lateral_of(spark, sf_dir), "lateral"))


@query("lateral_profile", f"SELECT case_id, {r('target', 'target')}, {r('nearest_mm', 'nearest_mm')}, x, {r('x_mm', 'x_mm')}, {r('value', 'value')} FROM lateral_profile", MEAN_SQL, LATERAL_SQL)
def lateral_profile(spark, sf_dir):
    return rounded(lateral_of(spark, sf_dir), 6, "target", "nearest_mm", "x_mm", "value")


@query("minmax_profile", f"SELECT case_id, {r('target', 'target')}, x, {r('(value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w)', 'value', 9)} FROM lateral_profile WINDOW w AS (PARTITION BY case_id, target)", MEAN_SQL, LATERAL_SQL)
def minmax_profile(spark, sf_dir):
    scaled = profile_scaled(spark, sf_dir)
    return rounded(rounded(scaled.select("case_id", "target", "x", "value"), 6, "target"), 9, "value")


def profile_scaled(spark, sf_dir):
    return select.minmax_profile(lateral_of(spark, sf_dir), ["case_id", "target"])


@query("union_cases", "SELECT case_id AS label, count(*) AS pixels, " + r("max(c)", "peak") + " FROM mean_field GROUP BY ALL", MEAN_SQL)
def union_cases(spark, sf_dir):
    """Mean fields of several cases, stacked with their labels."""
    field = align.mean_field(voxel(spark, sf_dir), "c")
    parts = [field.filter(F.col("case_id") == name).select(F.lit(name).alias("label"), "c") for name in ("case0", "case1")]
    stacked = parts[0].unionByName(parts[1])
    return rounded(stacked.groupBy("label").agg(F.count("*").alias("pixels"), F.max("c").alias("peak")), 6, "peak")


@query("sort_points", "SELECT case_id, x, string_agg(CAST(CAST(round(q * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY y) AS points FROM (SELECT case_id, x, y, "
       "CASE WHEN c > 0.25 THEN 1 ELSE 0 END AS q FROM mean_field) GROUP BY ALL", MEAN_SQL)
def sort_points(spark, sf_dir):
    """Per case and column, a flag of every row in order of the row."""
    flagged = align.mean_field(voxel(spark, sf_dir), "c").withColumn("q", F.when(F.col("c") > 0.25, F.lit(1000000)).otherwise(F.lit(0)))
    points = profile.sort_points(flagged, ["case_id", "x"], "y", "q")
    text = F.array_join(F.transform("points", lambda p: p["q"].cast("string")), ",")
    return points.select("case_id", "x", text.alias("points"))


