"""Gaussian fits, particle paths and stretching on flows with known answers."""

from __future__ import annotations

import inspect
import math

import numpy as np
import pytest

from eddyfield.operators import fit, lagrange
from eddyfield.operators.stencil import Tile


def profile_of(spark, lines):
    rows = [
        (case, float(target), i, float(x), None if np.isnan(v) else float(v))
        for (case, target), (xs, vs) in lines.items()
        for i, (x, v) in enumerate(zip(xs, vs))
    ]
    return spark.createDataFrame(rows, "case_id string, target double, x int, x_mm double, value double")


def test_gaussian_fit(spark):
    xs = np.linspace(-10, 10, 41)
    rng = np.random.default_rng(1)
    bell = lambda a, m, s: a * np.exp(-0.5 * ((xs - m) / s) ** 2)
    gaps = bell(2.0, 1.0, 1.5)
    gaps[[3, 20]] = np.nan
    noisy = bell(1.0, -2.0, 3.0) + 0.05 * rng.normal(size=xs.size)
    lines = {
        ("a", 0): (xs, bell(1.5, 0.5, 2.0)),
        ("a", 1): (xs, gaps),
        ("a", 2): (xs, noisy),
        ("a", 3): (xs, -bell(1.0, 0.0, 1.0)),
        ("a", 4): (xs[:2], [1.0, 2.0]),
    }
    got = {r["target"]: (r["amp"], r["mu"], r["sigma"]) for r in fit.gaussian_fit(profile_of(spark, lines)).collect()}
    assert got[0] == pytest.approx((1.5, 0.5, 2.0), rel=1e-8)
    assert got[1] == pytest.approx((2.0, 1.0, 1.5), rel=1e-8)
    assert got[3] == (None, None, None) and got[4] == (None, None, None)
    # no neighbouring parameters fit the noisy profile better
    best = np.sum((bell(*got[2]) - noisy) ** 2)
    for d in rng.normal(size=(200, 3)) * 1e-3:
        assert np.sum((bell(*(np.array(got[2]) + d)) - noisy) ** 2) >= best
    moments = {r["target"]: r for r in fit.gaussian_moments(profile_of(spark, lines)).collect()}
    assert moments[0]["mu"] == pytest.approx(0.5, abs=1e-3) and moments[3]["mu"] is None


def test_fits_of_profiles_without_a_peak(spark):
    xs = np.linspace(0, 10, 30)
    lines = {("a", 0): (xs, np.ones(30)), ("a", 1): (xs, 1 + 0.1 * (xs - 5) ** 2), ("a", 2): (xs, np.exp(xs)), ("a", 3): (xs, np.exp(-0.5 * ((xs - 4) / 9) ** 2)), ("a", 4): (xs, np.full(30, np.nan))}
    got = {r["target"]: r for r in fit.gaussian_fit(profile_of(spark, lines)).collect()}
    assert [got[i]["status"] for i in (0, 1, 2, 4)] == ["unbounded", "unbounded", "not converged", "unusable"] and got[0]["sigma"] is None
    assert (got[3]["mu"], got[3]["sigma"], got[3]["status"]) == (pytest.approx(4, abs=1e-7), pytest.approx(9, abs=1e-7), "converged")
    few = {r["target"]: r["status"] for r in fit.gaussian_fit(profile_of(spark, lines), max_steps=2).collect()}
    assert few[3] == "not converged" and len(few) == 5


def test_fit_runs_without_python(spark):
    xs = np.linspace(-3, 3, 20)
    fitted = fit.gaussian_fit(profile_of(spark, {("a", 0): (xs, np.exp(-xs * xs))}))
    assert "Python" not in fitted._jdf.queryExecution().executedPlan().toString() and "Pandas" not in inspect.getsource(fit.gaussian_fit)


def test_collapse_of_equal_shapes(spark):
    xs = np.linspace(-20, 20, 401)
    lines = {
        ("a", 0): (xs, 3 * np.exp(-0.5 * ((xs - 1) / 2) ** 2)),
        ("b", 0): (xs, 0.5 * np.exp(-0.5 * ((xs + 3) / 4) ** 2)),
    }
    profile = profile_of(spark, lines)
    rows = fit.gaussian_collapse(profile, fit.gaussian_fit(profile)).orderBy("point").collect()
    assert len(rows) == 200 and rows[0]["z"] == -3.0
    assert [r["value"] for r in rows] == pytest.approx([math.exp(-0.5 * r["z"] ** 2) for r in rows], abs=2e-4)


XS, YS = np.linspace(-1.0, 1.0, 9), np.linspace(0.8, -0.8, 9)


@pytest.fixture(scope="module")
def axes(spark):
    rows = [("a", "x", i, float(v)) for i, v in enumerate(XS)] + [("a", "y", i, float(v)) for i, v in enumerate(YS)]
    return spark.createDataFrame(rows, "case_id string, dim string, idx int, mm double")


def flow(cube, u_of, v_of, frames=4):
    x, y = np.meshgrid(XS, YS)
    shape = (frames, len(YS), len(XS))
    return cube(u=np.broadcast_to(u_of(x, y), shape).copy(), v=np.broadcast_to(v_of(x, y), shape).copy())


def ends(df):
    return {(r["start_t"], r["y"], r["x"]): (r["px"], r["py"]) for r in df.collect()}


@pytest.mark.parametrize("method", ["linear", "cubic"])
@pytest.mark.parametrize("direction", [1, -1])
def test_uniform_flow(cube, axes, direction, method):
    table = flow(cube, lambda x, y: 0.0 * x + 0.3, lambda x, y: 0.0 * x - 0.1)
    got = ends(lagrange.particle_advect(table, axes, 2, dt=0.05, direction=direction, method=method))
    assert len(got) == 4 * 81
    start_t = 1 if direction == 1 else 2
    for y in range(9):
        for x in range(9):
            want = (XS[x] + direction * 0.03, YS[y] - direction * 0.01)
            assert got[start_t, y, x] == pytest.approx(want, abs=1e-12)
    lost = {k[0] for k, v in got.items() if v == (None, None)}
    assert lost == ({2, 3} if direction == 1 else {0, 1})


@pytest.mark.parametrize("method", ["linear", "cubic"])
def test_linear_flow_is_integrated_to_fourth_order(cube, axes, method):
    # u = a x, v = -a y is exact for both interpolations and for the linear extension
    a, dt = 0.4, 0.5
    table = flow(cube, lambda x, y: a * x, lambda x, y: -a * y)
    moved = lagrange.particle_advect(table, axes, 2, dt=dt, method=method)
    h = a * dt
    grow, shrink = (1 + h + h**2 / 2 + h**3 / 6 + h**4 / 24) ** 2, (1 - h + h**2 / 2 - h**3 / 6 + h**4 / 24) ** 2
    got = ends(moved)
    for y in range(9):
        for x in range(9):
            assert got[0, y, x] == pytest.approx((XS[x] * grow, YS[y] * shrink), abs=1e-9)
    spread = lagrange.ftle_field(moved, dx=0.25, dy=0.25, duration=1.0, tile=Tile(4, 4, 4)).filter("start_t = 0").collect()
    for r in spread:
        inner = 0 < r["x"] < 8 and 0 < r["y"] < 8
        # rows are 0.2 apart, columns 0.25; the columns stretch
        assert r["ftle"] == pytest.approx(math.log(grow) if inner else 0.0, abs=1e-9)


def test_missing_velocity_loses_the_particle(cube, axes):
    table = flow(cube, lambda x, y: 0 * x + 0.01, lambda x, y: 0 * x)
    u = np.full((4, 9, 9), 0.01)
    u[0, 4, 4] = np.nan
    table = cube(u=u, v=np.zeros_like(u))
    got = ends(lagrange.particle_advect(table, axes, 1, method="linear"))
    assert got[0, 4, 4] == (None, None) and got[0, 1, 1] == pytest.approx((XS[1] + 0.0005, YS[1]))
    assert got[1, 4, 4] == pytest.approx((XS[4] + 0.0005, YS[4]))
    # a spline couples the whole frame
    got = ends(lagrange.particle_advect(table, axes, 1, method="cubic"))
    assert got[0, 1, 1] == (None, None) and got[1, 4, 4] == pytest.approx((XS[4] + 0.0005, YS[4]))


def test_spline_is_exact_for_cubic_flow(cube, axes):
    u_of = lambda x, y: 0.2 + x**3 - 0.5 * x * y**2 + 0.1 * y
    v_of = lambda x, y: -0.1 + 0.7 * y**3 + 0.3 * x**2 * y
    got = ends(lagrange.particle_advect(flow(cube, u_of, v_of), axes, 1, dt=0.1, blend=1e-9))
    for y in range(1, 8):
        for x in range(1, 8):
            p = np.array([XS[x], YS[y]])
            f = lambda q: np.array([u_of(*q), v_of(*q)])
            k1 = f(p)
            k2 = f(p + 0.05 * k1)
            k3 = f(p + 0.05 * k2)
            k4 = f(p + 0.1 * k3)
            assert got[0, y, x] == pytest.approx(tuple(p + 0.1 / 6 * (k1 + 2 * k2 + 2 * k3 + k4)), abs=1e-10)


def test_bad_parameters(cube, axes):
    table = flow(cube, lambda x, y: 0 * x, lambda x, y: 0 * x)
    for bad in ({"direction": 2}, {"method": "quintic"}):
        with pytest.raises(ValueError):
            lagrange.particle_advect(table, axes, 1, **bad)


@pytest.mark.parametrize("direction", [1, -1])
def test_steps_in_one_group_or_in_many(cube, axes, direction):
    """The same paths, whatever a task may hold; also where the recording ends within a group."""
    table = flow(cube, lambda x, y: 0.3 * y + 0.1, lambda x, y: -0.2 * x, frames=6)
    size = 16 * len(XS) * len(YS)
    alone = lagrange.particle_advect(table, axes, 4, dt=0.1, direction=direction, method="linear", held=size)
    pairs = lagrange.particle_advect(table, axes, 4, dt=0.1, direction=direction, method="linear", held=3 * size)
    whole = lagrange.particle_advect(table, axes, 4, dt=0.1, direction=direction, method="linear")
    assert ends(alone).keys() == ends(pairs).keys() == ends(whole).keys()
    gone = {k for k, v in ends(whole).items() if v[0] is None}
    assert {k[0] for k in gone} == ({2, 3, 4, 5} if direction == 1 else {0, 1, 2, 3})
    for other in (ends(alone), ends(pairs)):  # means of the flow are summed in any order
        assert all(other[k] == v if k in gone else other[k] == pytest.approx(v, abs=1e-12) for k, v in ends(whole).items())
