"""Gaussian fits, particle paths and stretching over the fixture."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from eddyfield.model import VOXEL
from eddyfield.operators import fit, lagrange, select
from eddyfield.plans.fixture import _once, axis, voxel
from eddyfield.plans.profile_queries import LATERAL_SQL, stored_lateral
from eddyfield.plans.registry import query, r, rounded
from eddyfield.plans.stats_queries import MEAN_SQL, strict_sql

MOMENTS_SQL = """
moments AS MATERIALIZED (
  SELECT case_id, target, max(value) AS amp, sum(x_mm * value) / sum(value) AS mu,
         greatest(sqrt(greatest(sum(x_mm * x_mm * value) / sum(value) - pow(sum(x_mm * value) / sum(value), 2), 0)), 1e-6) AS sigma
  FROM lateral_profile GROUP BY ALL HAVING count(*) >= 3 AND max(value) > 0
)"""


@query("gaussian_moments", f"SELECT case_id, {r('target', 'target')}, {r('amp', 'amp')}, {r('mu', 'mu')}, {r('sigma', 'sigma')} FROM moments", MEAN_SQL, LATERAL_SQL, MOMENTS_SQL)
def gaussian_moments(spark, sf_dir):
    return rounded(fit.gaussian_moments(stored_lateral(spark, sf_dir)), 6, "target", "amp", "mu", "sigma")


def fit_sql(steps: int = 200) -> str:
    """The same damped steps from the moments as a recursion over profiles packed into lists."""
    sums = ["sse", "b0", "b1", "b2", "b3", "b4", "g0", "g1", "g2"]
    terms = ["q[3] * q[3]"] + ["q[1] * q[1]" + " * q[2]" * k for k in range(5)] + ["q[1] * q[3]" + " * q[2]" * k for k in range(3)]
    of = ", ".join(f"list_sum(list_transform(q, lambda q: {term})) AS {name}_" for name, term in zip(sums, terms))

    def summed(source: str) -> str:
        """Sums at the parameters (ta, tm, ts) of every row of ``source``."""
        z = f"SELECT *, list_transform(xs, lambda v: (v - tm) / ts) AS zs FROM ({source})"
        b = f"SELECT *, list_transform(zs, lambda z: exp(-0.5 * z * z)) AS bs FROM ({z})"
        q = f"SELECT *, list_zip(bs, zs, list_transform(list_zip(bs, ys), lambda q: ta * q[1] - q[2])) AS q FROM ({b})"
        return f"SELECT * EXCLUDE (zs, bs, q), {of} FROM ({q})"

    held = "case_id, target, xs, ys"
    first = summed(f"SELECT {held}, amp AS ta, mu AS tm, sigma AS ts FROM packed JOIN moments USING (case_id, target)")
    grown = "SELECT *, amp / nullif(sigma, 0) AS k FROM fit WHERE running AND i < {steps}".format(steps=steps)
    normal = (f"SELECT *, b0 + damping * greatest(b0, 1e-30) AS a, k * b1 AS b, k * b2 AS c, k * k * b2 + damping * greatest(k * k * b2, 1e-30) AS d, "
              f"k * k * b3 AS e, k * k * b4 + damping * greatest(k * k * b4, 1e-30) AS f, -g0 AS u, -k * g1 AS v, -k * g2 AS w FROM ({grown})")
    cofactors = (f"SELECT *, d * f - e * e AS c11, c * e - b * f AS c12, b * e - c * d AS c13, a * f - c * c AS c22, b * c - a * e AS c23, a * d - b * b AS c33 FROM ({normal})")
    det = f"SELECT *, nullif(a * c11 + b * c12 + c * c13, 0) AS det FROM ({cofactors})"
    trial = (f"SELECT *, greatest(amp + (c11 * u + c12 * v + c13 * w) / det, 0) AS ta, mu + (c12 * u + c22 * v + c23 * w) / det AS tm, "
             f"greatest(sigma + (c13 * u + c23 * v + c33 * w) / det, 1e-6) AS ts FROM ({det})")
    judged = (f"SELECT *, coalesce(sse_ <= sse, false) AS better, greatest(abs(ta - amp), abs(tm - mu), abs(ts - sigma)) AS moved, "
              f"greatest(abs(ta), abs(tm), abs(ts)) AS size FROM ({summed(trial)})")
    kept = ", ".join(f"CASE WHEN better THEN {new} ELSE {old} END" for new, old in [("ta", "amp"), ("tm", "mu"), ("ts", "sigma"), *[(f"{n}_", n) for n in sums]])
    return f"""
(WITH RECURSIVE packed AS MATERIALIZED (
  SELECT case_id, target, list(x_mm ORDER BY x_mm, value) AS xs, list(value ORDER BY x_mm, value) AS ys FROM lateral_profile WHERE value IS NOT NULL GROUP BY ALL
), fit AS (
  SELECT {held}, 0 AS i, true AS running, false AS wide, 1e-3::DOUBLE AS damping, ta AS amp, tm AS mu, ts AS sigma, {", ".join(f"{n}_ AS {n}" for n in sums)} FROM ({first})
  UNION ALL
  SELECT {held}, i + 1, NOT far AND CASE WHEN better THEN moved > 1e-12 * (1 + size) ELSE damping * 10 <= 1e12 END, far, damping * CASE WHEN better THEN 0.3 ELSE 10 END, {kept} FROM (SELECT *, better AND ts > 1000 * (xs[-1] - xs[1]) AS far FROM ({judged}))
), last AS (
  SELECT * FROM fit QUALIFY i = max(i) OVER (PARTITION BY case_id, target)
)
SELECT k.case_id, k.target, CASE WHEN NOT running AND NOT wide THEN amp END AS amp, CASE WHEN NOT running AND NOT wide THEN mu END AS mu,
       CASE WHEN NOT running AND NOT wide THEN sigma END AS sigma,
       CASE WHEN running IS NULL THEN 'unusable' WHEN running THEN 'not converged' WHEN wide THEN 'unbounded' ELSE 'converged' END AS status
FROM (SELECT DISTINCT case_id, target FROM lateral_profile) k LEFT JOIN last USING (case_id, target))"""


@query("gaussian_fit", f"SELECT case_id, {r('target', 'target')}, {r('amp', 'amp', 4)}, {r('mu', 'mu', 4)}, {r('sigma', 'sigma', 4)}, status FROM {fit_sql()}", MEAN_SQL, LATERAL_SQL, MOMENTS_SQL)
def gaussian_fit(spark, sf_dir):
    """Least-squares fits of the measured profiles."""
    fitted = fit.gaussian_fit(stored_lateral(spark, sf_dir))
    return rounded(rounded(fitted, 4, "amp", "mu", "sigma"), 6, "target")


BELLS_SQL = """
bells AS (
  SELECT case_id, y, 1 + avg(c) AS amp, avg(u) * 5 AS mu, 2 + avg(abs(v)) AS sigma FROM voxel GROUP BY ALL
)"""


@query("gaussian_fit_recovery", f"SELECT case_id, CAST(y AS DOUBLE) AS target, {r('amp', 'amp', 5)}, {r('mu', 'mu', 5)}, {r('sigma', 'sigma', 5)} FROM bells", BELLS_SQL)
def gaussian_fit_recovery(spark, sf_dir):
    """Exact Gaussians drawn from the statistics of every row: the fit must find them again."""
    bells = voxel(spark, sf_dir).groupBy("case_id", F.col("y").cast("double").alias("target")).agg(
        (1 + F.avg("c")).alias("a"), (F.avg("u") * 5).alias("m"), (2 + F.avg(F.abs("v"))).alias("s")
    )
    columns = select.axis_of(axis(spark, sf_dir), "x")
    z = (F.col("x_mm") - F.col("m")) / F.col("s")
    drawn = bells.join(columns, "case_id").select(
        "case_id", "target", "x", "x_mm", (F.col("a") * F.exp(F.lit(-0.5) * z * z)).alias("value")
    )
    return rounded(fit.gaussian_fit(drawn).drop("status"), 5, "amp", "mu", "sigma")


COLLAPSE_SQL = """
nodes AS MATERIALIZED (SELECT case_id, target, (x_mm - mu) / sigma AS z, exp(-0.5 * pow((x_mm - mu) / sigma, 2)) AS g FROM lateral_profile JOIN moments USING (case_id, target)),
spans AS (SELECT case_id, target, z, g, lead(z) OVER w AS nz, lead(g) OVER w AS ng, max(g) OVER (PARTITION BY case_id, target) AS peak FROM nodes WINDOW w AS (PARTITION BY case_id, target ORDER BY z)),
zs AS (SELECT CAST(i AS INTEGER) AS point, -3.0::DOUBLE + i * (6.0::DOUBLE / 199) AS z FROM range(200) g(i)),
hits AS (SELECT target, point, avg((g + (ng - g) * (zs.z - s.z) / (nz - s.z)) / peak) AS value FROM spans s JOIN zs ON zs.z >= s.z AND zs.z < s.nz GROUP BY ALL)"""


@query("gaussian_collapse", f"SELECT {r('k.target', 'target')}, zs.point, {r('zs.z', 'z')}, {r('value', 'value')} FROM (SELECT DISTINCT target FROM moments) k CROSS JOIN zs LEFT JOIN hits h ON h.target = k.target AND h.point = zs.point",
       MEAN_SQL, LATERAL_SQL, MOMENTS_SQL, COLLAPSE_SQL)
def gaussian_collapse(spark, sf_dir):
    """Collapse on the moment parameters, which SQL can state."""
    lateral = stored_lateral(spark, sf_dir)
    return rounded(fit.gaussian_collapse(lateral, fit.gaussian_moments(lateral)), 6, "target", "z", "value")


DT, BLEND, STEPS = 1.5, 2.0, 2

FLOW_SQL = f"""
flow AS MATERIALIZED (SELECT p.case_id, t, y, x, u, coalesce(v, 0) AS v, a.mm AS xm, b.mm AS ym FROM voxel p
  JOIN axis a ON a.case_id = p.case_id AND a.dim = 'x' AND a.idx = p.x JOIN axis b ON b.case_id = p.case_id AND b.dim = 'y' AND b.idx = p.y),
tensor AS MATERIALIZED (SELECT case_id, t, {strict_sql('avg(u)', 'u', 'v')} AS um, {strict_sql('avg(v)', 'u', 'v')} AS vm,
  {strict_sql('avg(xm * u - ym * v) / avg(xm * xm + ym * ym)', 'u', 'v')} AS gxx, {strict_sql('avg(ym * u) / avg(ym * ym)', 'u', 'v')} AS gxy,
  {strict_sql('avg(xm * v) / avg(xm * xm)', 'u', 'v')} AS gyx, {strict_sql('avg(ym * v - xm * u) / avg(xm * xm + ym * ym)', 'u', 'v')} AS gyy FROM flow GROUP BY ALL),
geo AS (SELECT case_id, arg_min(xm, x) AS x0, (arg_max(xm, x) - arg_min(xm, x)) / max(x) AS xp, max(x) + 1 AS nx, max(abs(xm)) AS xf,
  arg_min(ym, y) AS y0, (arg_max(ym, y) - arg_min(ym, y)) / max(y) AS yp, max(y) + 1 AS ny, max(abs(ym)) AS yf FROM flow GROUP BY ALL)"""


def spline_slopes(n: int) -> str:
    """Slopes of a not-a-knot spline at n even nodes as rows (node, source node, weight), from
    its second derivatives m: m[i-1] + 4 m[i] + m[i+1] = 6 (f[i+1] - 2 f[i] + f[i-1])."""
    left, right = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        left[i, i - 1 : i + 2] = 1, 4, 1
        right[i, i - 1 : i + 2] = 6, -12, 6
    left[0, :3] = left[-1, -3:] = 1, -2, 1
    second = np.linalg.solve(left, right)
    f = np.eye(n)
    slopes = np.vstack([f[1:] - f[:-1] - (2 * second[:-1] + second[1:]) / 6, f[-1:] - f[-2:-1] + (second[-2:-1] + 2 * second[-1:]) / 6])
    return ", ".join(f"({i}, {k}, {float(slopes[i, k])!r}::DOUBLE)" for i in range(n) for k in range(n))


SPLINE_SQL = f"""
dy(i, k, d) AS (VALUES {spline_slopes(10)}),
dx(i, k, d) AS (VALUES {spline_slopes(20)}),
along AS MATERIALIZED (SELECT case_id, t, y, dx.i AS x, sum(d * u) AS u_x, sum(d * v) AS v_x FROM flow JOIN dx ON dx.k = flow.x GROUP BY ALL),
down AS MATERIALIZED (SELECT case_id, t, dy.i AS y, x, sum(d * u) AS u_y, sum(d * v) AS v_y, sum(d * u_x) AS u_xy, sum(d * v_x) AS v_xy
  FROM flow JOIN along USING (case_id, t, y, x) JOIN dy ON dy.k = flow.y GROUP BY ALL),
nodes AS MATERIALIZED (SELECT * FROM flow JOIN along USING (case_id, t, y, x) JOIN down USING (case_id, t, y, x))"""


def hermite_sql(k: str) -> str:
    """A bicubic cell as cubic Hermite steps: along both rows, then between them."""

    def step(s: str, f0: str, f1: str, m0: str, m1: str) -> str:
        return f"({f0} + {s} * ({m0} + {s} * (3 * ({f1} - {f0}) - 2 * {m0} - {m1} + {s} * (2 * ({f0} - {f1}) + {m0} + {m1}))))"

    top, low = step("sx", f"a.{k}", f"b.{k}", f"a.{k}_x", f"b.{k}_x"), step("sx", f"c.{k}", f"d.{k}", f"c.{k}_x", f"d.{k}_x")
    top_m, low_m = step("sx", f"a.{k}_y", f"b.{k}_y", f"a.{k}_xy", f"b.{k}_xy"), step("sx", f"c.{k}_y", f"d.{k}_y", f"c.{k}_xy", f"d.{k}_xy")
    return step("sy", top, low, top_m, low_m)


def bilinear_sql(k: str) -> str:
    return f"((1 - sy) * ((1 - sx) * a.{k} + sx * b.{k}) + sy * ((1 - sx) * c.{k} + sx * d.{k}))"


def stage_sql(name: str, source: str, stage: int, qx: str, qy: str, frame: str, method: str) -> str:
    """One Runge-Kutta stage: velocity at (qx, qy) in a frame, four corners by joins."""
    table, inner = ("flow", bilinear_sql) if method == "linear" else ("nodes", hermite_sql)
    outer = {"u": "(gxx * qx + gxy * qy + um)", "v": "(gyx * qx + gyy * qy + vm)"}
    corner = lambda q, dy, dx: f"LEFT JOIN {table} {q} ON {q}.case_id = s.case_id AND {q}.t = s.fr AND {q}.y = s.cy + {dy} AND {q}.x = s.cx + {dx}"
    value = lambda k: f"CASE WHEN wt = 0 THEN {outer[k]} WHEN wt = 1 THEN {inner(k)} ELSE {outer[k]} + ({inner(k)} - {outer[k]}) * wt END AS {k}{stage}"
    return f"""
{name} AS MATERIALIZED (
  SELECT s.* EXCLUDE (qx, qy, fr, cx, cy, sx, sy, wt, x0, xp, nx, xf, y0, yp, ny, yf), {value('u')}, {value('v')} FROM (
    SELECT *, (qx - x0) / xp - cx AS sx, (qy - y0) / yp - cy AS sy,
      CASE WHEN abs(qx) >= xf OR abs(qy) >= yf THEN 0 ELSE
        (CASE WHEN (xf - abs(qx)) / {BLEND} >= 1 THEN 1 ELSE pow((xf - abs(qx)) / {BLEND}, 2) * (3 - 2 * (xf - abs(qx)) / {BLEND}) END) *
        (CASE WHEN (yf - abs(qy)) / {BLEND} >= 1 THEN 1 ELSE pow((yf - abs(qy)) / {BLEND}, 2) * (3 - 2 * (yf - abs(qy)) / {BLEND}) END) END AS wt
    FROM (SELECT *, greatest(0, least(nx - 2, floor((qx - x0) / xp))) AS cx, greatest(0, least(ny - 2, floor((qy - y0) / yp))) AS cy FROM (
      SELECT p.*, g.* EXCLUDE (case_id), {qx} AS qx, {qy} AS qy, {frame} AS fr FROM {source} p JOIN geo g USING (case_id)) WHERE qx IS NOT NULL)) s
  {corner('a', 0, 0)} {corner('b', 0, 1)} {corner('c', 1, 0)} {corner('d', 1, 1)} LEFT JOIN tensor q ON q.case_id = s.case_id AND q.t = s.fr
  UNION ALL SELECT p.*, NULL, NULL FROM {source} p WHERE {qx} IS NULL
)"""


def advect_sql(direction: int, method: str = "linear") -> list[str]:
    h = direction * DT
    out = [FLOW_SQL, *([SPLINE_SQL] if method == "cubic" else []), "state0 AS MATERIALIZED (SELECT case_id, t AS start_t, y, x, xm AS px, ym AS py FROM flow)"]
    for n in range(STEPS):
        now = f"start_t + {direction * n}"
        mid = now if direction == 1 else f"{now} - 1"
        out += [
            stage_sql(f"s{n}a", f"state{n}", 1, "px", "py", now, method),
            stage_sql(f"s{n}b", f"s{n}a", 2, f"px + {h / 2} * u1", f"py + {h / 2} * v1", mid, method),
            stage_sql(f"s{n}c", f"s{n}b", 3, f"px + {h / 2} * u2", f"py + {h / 2} * v2", mid, method),
            stage_sql(f"s{n}d", f"s{n}c", 4, f"px + {h} * u3", f"py + {h} * v3", f"{now} + {direction}", method),
            f"state{n + 1} AS MATERIALIZED (SELECT case_id, start_t, y, x, px + {h / 6} * (u1 + 2 * u2 + 2 * u3 + u4) AS px, "
            f"py + {h / 6} * (v1 + 2 * v2 + 2 * v3 + v4) AS py FROM s{n}d)",
        ]
    return out


def flow_of(spark, sf_dir):
    """Velocity without gaps, so that every frame has a linear flow."""
    return voxel(spark, sf_dir).select(*VOXEL, "u", F.coalesce("v", F.lit(0.0)).alias("v"))


def advected(spark, sf_dir, direction, method="linear"):
    return _once(
        spark, sf_dir, f"advected-{method}-{direction}",
        lambda: lagrange.particle_advect(
            flow_of(spark, sf_dir), axis(spark, sf_dir), STEPS, dt=DT, direction=direction, method=method, blend=BLEND
        ),
    )


@query("particle_advect", f"SELECT case_id, start_t, y, x, {r('px', 'px')}, {r('py', 'py')} FROM state{STEPS}", *advect_sql(1))
def particle_advect(spark, sf_dir):
    """Two steps of all particles of all start frames; the last frames leave the recording."""
    return rounded(advected(spark, sf_dir, 1), 6, "px", "py")


@query("particle_advect_backward", f"SELECT case_id, start_t, y, x, {r('px', 'px')}, {r('py', 'py')} FROM state{STEPS}", *advect_sql(-1))
def particle_advect_backward(spark, sf_dir):
    return rounded(advected(spark, sf_dir, -1), 6, "px", "py")


@query("particle_advect_cubic", f"SELECT case_id, start_t, y, x, {r('px', 'px')}, {r('py', 'py')} FROM state{STEPS}", *advect_sql(1, "cubic"))
def particle_advect_cubic(spark, sf_dir):
    """With spline interpolation of the velocity."""
    return rounded(advected(spark, sf_dir, 1, "cubic"), 6, "px", "py")


FTLE_SQL = f"""
jacobian AS (SELECT case_id, start_t, y, x, lead(px) OVER r AS xr, lag(px) OVER r AS xl, lead(py) OVER r AS yr, lag(py) OVER r AS yl,
  lead(px) OVER c AS xu, lag(px) OVER c AS xd, lead(py) OVER c AS yu, lag(py) OVER c AS yd FROM state{STEPS}
  WINDOW r AS (PARTITION BY case_id, start_t, y ORDER BY x), c AS (PARTITION BY case_id, start_t, x ORDER BY y)),
tensors AS (SELECT *, (xr - xl) / 1.4 AS a, (xu - xd) / 1.2 AS b, (yr - yl) / 1.4 AS c, (yu - yd) / 1.2 AS d FROM jacobian),
eigen AS (SELECT *, (a*a + c*c + b*b + d*d) / 2 + sqrt(pow(a*a + c*c - b*b - d*d, 2) / 4 + pow(a*b + c*d, 2)) AS eig FROM tensors)"""


@query("ftle_field", f"SELECT case_id, start_t, y, x, {r('CASE WHEN y IN (0, 9) OR x IN (0, 19) THEN 0 WHEN eig > 0 THEN ln(sqrt(eig)) / 3 END', 'ftle')} FROM eigen", *advect_sql(1), FTLE_SQL)
def ftle_field(spark, sf_dir):
    return rounded(lagrange.ftle_field(advected(spark, sf_dir, 1), dx=0.7, dy=0.6, duration=STEPS * DT), 6, "ftle")
