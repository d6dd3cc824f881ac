"""Statistics over time, turbulence and fluxes over the fixture."""

from __future__ import annotations

from eddyfield.model import PIXEL
from eddyfield.operators import align, select, stats, transport, turbulence
from eddyfield.plans.fixture import axis, voxel
from eddyfield.plans.registry import query, r, rounded

DX = 0.000317  # metres between pixels
NU = 1.5e-5  # kinematic viscosity of air, m^2/s
DIGITS = 9

MEAN_SQL = """
mean_field AS MATERIALIZED (
  SELECT case_id, y, x, avg(u) AS u, avg(v) AS v, avg(w) AS w, avg(c) AS c FROM voxel GROUP BY ALL
)"""
FLUCT_SQL = """
fluct AS MATERIALIZED (
  SELECT case_id, t, y, x, p.u - m.u AS u, p.v - m.v AS v,
         CASE WHEN p.w - m.w >= -1 THEN p.w - m.w END AS w, p.c - m.c AS c
  FROM voxel p JOIN mean_field m USING (case_id, y, x)
)"""


def strict_sql(expression: str, *values: str) -> str:
    missing = " OR ".join(f"{v} IS NULL" for v in values)
    return f"CASE WHEN count_if({missing}) = 0 THEN {expression} END"


SQUARES_SQL = f"""
squares AS MATERIALIZED (
  SELECT case_id, y, x, {strict_sql('avg(u * u)', 'u')} AS u2, {strict_sql('avg(v * v)', 'v')} AS v2,
         {strict_sql('avg(w * w)', 'w')} AS w2 FROM fluct GROUP BY ALL
)"""


def _slope_sql(value: str, dim: str, step: str, keys: str) -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY {dim})"
    return (
        f"CASE WHEN lag({dim}) {w} IS NULL THEN (lead({value}) {w} - {value}) / {step} "
        f"WHEN lead({dim}) {w} IS NULL THEN ({value} - lag({value}) {w}) / {step} "
        f"ELSE (lead({value}) {w} - lag({value}) {w}) / (2 * {step}) END"
    )


def slope_sql(value: str, dim: str, step: str) -> str:
    others = ", ".join(d for d in ("t", "y", "x") if d != dim)
    return _slope_sql(value, dim, step, f"case_id, {others}")


STRAIN_SQL = f"""
strain AS MATERIALIZED (
  SELECT *, -du - dv AS dw FROM (
    SELECT case_id, t, y, x, {slope_sql('u', 'y', '0.000317::DOUBLE')} AS du,
           {slope_sql('v', 'x', '0.000317::DOUBLE')} AS dv FROM fluct)
)"""
EPSILON_SQL = f"""
epsilon AS MATERIALIZED (
  SELECT case_id, y, x,
         {strict_sql('5 * 1.5e-5 * (avg(du * du) + avg(dv * dv) + avg(dw * dw))', 'du', 'dv')} AS epsilon
  FROM strain GROUP BY ALL
)"""
SCALES_SQL = """
scales AS MATERIALIZED (
  SELECT case_id, y, x, sqrt(15 * 1.5e-5 / eps) * rms AS taylor_length, pow(pow(1.5e-5, 3) / eps, 0.25) AS kolmogorov_length,
         sqrt(1.5e-5 / eps) AS kolmogorov_time, rms * (sqrt(15 * 1.5e-5 / eps) * rms) / 1.5e-5 AS taylor_re
  FROM (SELECT case_id, y, x, CASE WHEN epsilon > 0 THEN epsilon END AS eps, sqrt((u2 + v2 + w2) / 3) AS rms
        FROM squares JOIN epsilon USING (case_id, y, x))
)"""
TURBULENCE = (MEAN_SQL, FLUCT_SQL, SQUARES_SQL)


def first_mean(table):
    """The mean field of the first case as the supplied mean field of every case."""
    first = align.mean_field(table.filter("case_id = 'case0'")).drop("case_id")
    return table.select("case_id", "y", "x").distinct().join(first, ["y", "x"])


@query("temporal_mean", f"SELECT case_id, y, x, {r('avg(u)', 'u_mean')}, {r('avg(v)', 'v_mean')}, {r('avg(w)', 'w_mean')}, "
       f"{r('avg(c)', 'c_mean')}, count(u) AS u_count, count(v) AS v_count, count(w) AS w_count, count(c) AS c_count FROM voxel GROUP BY ALL")
def temporal_mean(spark, sf_dir):
    names = ("u", "v", "w", "c")
    return rounded(stats.temporal_mean(voxel(spark, sf_dir), *names), 6, *[f"{k}_mean" for k in names])


@query("temporal_variance", f"SELECT case_id, y, x, {r('avg(v)', 'v_mean')}, {r('avg(w)', 'w_mean')}, "
       f"{r('var_pop(v)', 'v_var')}, {r('var_pop(w)', 'w_var')} FROM voxel GROUP BY ALL")
def temporal_variance(spark, sf_dir):
    return rounded(stats.temporal_variance(voxel(spark, sf_dir), "v", "w"), 6, "v_mean", "w_mean", "v_var", "w_var")


@query("rms_raw", f"SELECT case_id, y, x, {r('sqrt(avg(w * w))', 'w_rms')}, {r('sqrt(avg(v * v))', 'v_rms')} FROM voxel GROUP BY ALL")
def rms_raw(spark, sf_dir):
    return rounded(stats.rms_raw(voxel(spark, sf_dir), "w", "v"), 6, "w_rms", "v_rms")


@query("rms_raw_strict", f"SELECT case_id, y, x, {r(strict_sql('sqrt(avg(v * v))', 'v'), 'v_rms')} FROM voxel GROUP BY ALL")
def rms_raw_strict(spark, sf_dir):
    return rounded(stats.rms_raw(voxel(spark, sf_dir), "v", strictly=True), 6, "v_rms")


@query("rms_fluct", f"SELECT case_id, y, x, {r('sqrt(avg((c - m) * (c - m)))', 'c_rms')} FROM voxel JOIN "
       "(SELECT case_id, y, x, avg(c) AS m FROM voxel GROUP BY ALL) USING (case_id, y, x) GROUP BY ALL")
def rms_fluct(spark, sf_dir):
    return rounded(stats.rms_fluct(voxel(spark, sf_dir)), 6, "c_rms")


@query("rms_fluct_supplied", f"SELECT case_id, y, x, {r('sqrt(avg((c - m) * (c - m)))', 'c_rms')} FROM voxel JOIN "
       "(SELECT y, x, avg(c) AS m FROM voxel WHERE case_id = 'case0' GROUP BY ALL) USING (y, x) GROUP BY ALL")
def rms_fluct_supplied(spark, sf_dir):
    """Every case about the mean field of the first one."""
    table = voxel(spark, sf_dir)
    return rounded(stats.rms_fluct(table, first_mean(table)), 6, "c_rms")


@query("intermittency", "SELECT case_id, y, x, coalesce(count_if(c > 0.1)::DOUBLE / nullif(count(c), 0), 0) AS intermittency FROM voxel GROUP BY ALL")
def intermittency(spark, sf_dir):
    return stats.intermittency(voxel(spark, sf_dir), 0.1)


@query("mean_squares", f"SELECT case_id, y, x, {r('u2', 'u2')}, {r('v2', 'v2')}, {r('w2', 'w2')} FROM squares", *TURBULENCE)
def mean_squares(spark, sf_dir):
    return rounded(turbulence.mean_squares(voxel(spark, sf_dir)), 6, "u2", "v2", "w2")


@query("tke", f"SELECT case_id, y, x, {r('u2', 'u2')}, {r('v2', 'v2')}, {r('w2', 'w2')}, {r('0.5 * (u2 + v2 + w2)', 'tke')} FROM squares", *TURBULENCE)
def tke(spark, sf_dir):
    return rounded(turbulence.tke(turbulence.mean_squares(voxel(spark, sf_dir))), 6, "u2", "v2", "w2", "tke")


@query("turbulence_intensity", f"SELECT case_id, y, x, {r('sqrt((u2 + v2 + w2) / 3) / 0.30', 'intensity')} FROM squares", *TURBULENCE)
def turbulence_intensity(spark, sf_dir):
    return rounded(turbulence.turbulence_intensity(turbulence.mean_squares(voxel(spark, sf_dir))), 6, "intensity")


@query("dissipation", f"SELECT case_id, y, x, {r('epsilon', 'epsilon')} FROM epsilon", MEAN_SQL, FLUCT_SQL, STRAIN_SQL, EPSILON_SQL)
def dissipation(spark, sf_dir):
    return rounded(turbulence.dissipation(voxel(spark, sf_dir), DX, NU), 6, "epsilon")


@query("dissipation_supplied", f"SELECT case_id, y, x, {r('epsilon', 'epsilon')} FROM epsilon",
       "mean_field AS MATERIALIZED (SELECT k.case_id, m.* FROM (SELECT DISTINCT case_id FROM voxel) k, "
       "(SELECT y, x, avg(u) AS u, avg(v) AS v, avg(w) AS w, avg(c) AS c FROM voxel WHERE case_id = 'case0' GROUP BY ALL) m)",
       FLUCT_SQL, STRAIN_SQL, EPSILON_SQL)
def dissipation_supplied(spark, sf_dir):
    """Every case about the mean field of the first one."""
    table = voxel(spark, sf_dir)
    return rounded(turbulence.dissipation(table, DX, NU, mean=first_mean(table)), 6, "epsilon")


@query("turbulence_scales", f"SELECT case_id, y, x, {r('taylor_length', 'taylor_length', DIGITS)}, {r('kolmogorov_length', 'kolmogorov_length', DIGITS)}, "
       f"{r('kolmogorov_time', 'kolmogorov_time', DIGITS)}, {r('taylor_re', 'taylor_re')} FROM scales",
       *TURBULENCE, STRAIN_SQL, EPSILON_SQL, SCALES_SQL)
def turbulence_scales(spark, sf_dir):
    table = voxel(spark, sf_dir)
    scales = turbulence.scales_of(table, DX, NU)
    return rounded(rounded(scales, DIGITS, "taylor_length", "kolmogorov_length", "kolmogorov_time"), 6, "taylor_re")


@query("anisotropy", f"SELECT case_id, {r('avg(u2 / nullif(k, 0))', 'u_share')}, {r('avg(v2 / nullif(k, 0))', 'v_share')}, {r('avg(w2 / nullif(k, 0))', 'w_share')} "
       "FROM (SELECT *, 0.5 * (u2 + v2 + w2) AS k FROM squares) GROUP BY ALL", *TURBULENCE)
def anisotropy(spark, sf_dir):
    energy = turbulence.tke(turbulence.mean_squares(voxel(spark, sf_dir)))
    return rounded(turbulence.anisotropy(energy), 6, "u_share", "v_share", "w_share")


@query("reynolds_stress", "SELECT case_id, y, x, " + r("uu", "uu") + ", " + r("vv", "vv") + ", " + r("uv", "uv") + ", "
       + r("CASE WHEN uu IS NOT NULL AND vv IS NOT NULL THEN least(uu, vv) / nullif(greatest(uu, vv), 0) END", "ratio")
       + f" FROM (SELECT case_id, y, x, {strict_sql('avg(u * u)', 'u')} AS uu, {strict_sql('avg(v * v)', 'v')} AS vv, "
       + f"{strict_sql('avg(u * v)', 'u', 'v')} AS uv FROM fluct GROUP BY ALL)", MEAN_SQL, FLUCT_SQL)
def reynolds_stress(spark, sf_dir):
    return rounded(turbulence.reynolds_stress(voxel(spark, sf_dir)), 6, "uu", "vv", "uv", "ratio")


FLUX = ", ".join(r(strict_sql(f"avg({k} * c)", k, "c"), f"{k}c") for k in ("u", "v", "w"))


@query("turbulent_flux", f"SELECT case_id, y, x, {FLUX} FROM fluct GROUP BY ALL", MEAN_SQL, FLUCT_SQL)
def turbulent_flux(spark, sf_dir):
    return rounded(transport.turbulent_flux(voxel(spark, sf_dir)), 6, "uc", "vc", "wc")


@query("turbulent_flux_slice", f"SELECT case_id, y, x, {FLUX} FROM fluct WHERE t >= 1 AND t < 12 GROUP BY ALL", MEAN_SQL, FLUCT_SQL)
def turbulent_flux_slice(spark, sf_dir):
    """Average over a slice of frames, fluctuations about the means over all frames."""
    return rounded(transport.turbulent_flux(voxel(spark, sf_dir), t=(1, 12)), 6, "uc", "vc", "wc")


@query("advective_flux", "SELECT case_id, y, x, " + ", ".join(r(f"avg({k}) * {strict_sql('avg(c)', 'c')}", f"{k}c") for k in ("u", "v", "w"))
       + " FROM voxel GROUP BY ALL")
def advective_flux(spark, sf_dir):
    return rounded(transport.advective_flux(voxel(spark, sf_dir)), 6, "uc", "vc", "wc")


@query("total_flux", f"SELECT case_id, y, x, {r('avg(u * c)', 'uc')}, {r('avg(v * c)', 'vc')} FROM voxel GROUP BY ALL")
def total_flux(spark, sf_dir):
    return rounded(transport.total_flux(voxel(spark, sf_dir)), 6, "uc", "vc")


BLOCK_SQL = """
blocks AS MATERIALIZED (
  SELECT case_id, t, y // 3 AS y, x // 3 AS x, avg(c) AS c, avg(u) AS u, avg(v) AS v FROM voxel
  WHERE y < 9 AND x < 18 GROUP BY case_id, t, y // 3, x // 3
)"""


@query("block_coarsen", f"SELECT case_id, t, y, x, {r('c', 'c')}, {r('u', 'u')}, {r('v', 'v')} FROM blocks", BLOCK_SQL)
def block_coarsen(spark, sf_dir):
    """3 x 3 blocks: one row and two columns do not fill a block."""
    return rounded(transport.block_coarsen(voxel(spark, sf_dir), 3, "c", "u", "v"), 6, "c", "u", "v")


@query("conditional_velocity", "SELECT case_id, y, x, " + ", ".join(
    r(f"coalesce(sum(CASE WHEN c >= 0.2003 THEN {k} END), 0) / count(*)", f"{k}_cond") for k in ("u", "v")) + " FROM blocks GROUP BY ALL", BLOCK_SQL)
def conditional_velocity(spark, sf_dir):
    return rounded(transport.conditional_velocity(voxel(spark, sf_dir), 3, 0.2003), 6, "u_cond", "v_cond")


@query("case_means", "SELECT case_id, component, " + r("mean", "mean") + " FROM (" + " UNION ALL ".join(
    f"SELECT case_id, '{k}' AS component, avg({k}) AS mean FROM voxel GROUP BY case_id" for k in ("u", "v", "c")) + ")")
def case_means(spark, sf_dir):
    return rounded(stats.case_means(voxel(spark, sf_dir), "u", "v", "c"), 6, "mean")


@query("linear_flow_tensor", "SELECT case_id, t, " + ", ".join(r(strict_sql(e, "u", "v"), n) for n, e in {
    "u_mean": "avg(u)", "v_mean": "avg(v)", "g_xx": "avg(xm * u - ym * v) / avg(xm * xm + ym * ym)", "g_xy": "avg(ym * u) / avg(ym * ym)",
    "g_yx": "avg(xm * v) / avg(xm * xm)", "g_yy": "avg(ym * v - xm * u) / avg(xm * xm + ym * ym)"}.items())
    + " FROM (SELECT p.*, a.mm AS xm, b.mm AS ym FROM voxel p JOIN axis a ON a.case_id = p.case_id AND a.dim = 'x' AND a.idx = p.x "
      "JOIN axis b ON b.case_id = p.case_id AND b.dim = 'y' AND b.idx = p.y) GROUP BY ALL")
def linear_flow_tensor(spark, sf_dir):
    placed = select.roi_coords(voxel(spark, sf_dir), axis(spark, sf_dir))
    return rounded(stats.linear_flow_tensor(placed), 6, "u_mean", "v_mean", "g_xx", "g_xy", "g_yx", "g_yy")


@query("flow_report_field", f"SELECT case_id, y, x, {r('intermittency', 'intermittency')}, {r('uc', 'uc')}, {r('vc', 'vc')}, {r('wc', 'wc')}, {r('0.5 * (u2 + v2 + w2)', 'tke')} "
       "FROM (SELECT case_id, y, x, coalesce(count_if(c > 0.1)::DOUBLE / nullif(count(c), 0), 0) AS intermittency FROM voxel GROUP BY ALL) "
       f"JOIN (SELECT case_id, y, x, {FLUX} FROM fluct GROUP BY ALL) USING (case_id, y, x) JOIN squares USING (case_id, y, x)", *TURBULENCE)
def flow_report_field(spark, sf_dir):
    """Where the plume is, how turbulent the flow is there, and which way it carries scalar: all
    pixel statistics from one scan and one shuffle."""
    terms = [stats.intermittency_term(0.1), *transport.flux_terms(), *turbulence.square_terms()]
    pixels = voxel(spark, sf_dir).groupBy(*PIXEL).agg(*terms)
    fields = pixels.select(*PIXEL, "intermittency", *transport.flux_columns(), *turbulence.square_columns())
    report = turbulence.tke(fields).select(*PIXEL, "intermittency", "uc", "vc", "wc", "tke")
    return rounded(report, 6, "intermittency", "uc", "vc", "wc", "tke")
