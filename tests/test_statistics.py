"""Statistics over time, turbulence and fluxes on small cubes, against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyfield.functions.missing import finite, floor_at
from eddyfield.functions.scalar import lgamma
from eddyfield.model import by_pixel
from eddyfield.operators import align, stats, transport, turbulence
from eddyfield.operators.stencil import Tile

T, Y, X = 5, 4, 6


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(3)
    return {k: rng.normal(0.3, 0.2, (T, Y, X)) for k in ("u", "v", "w", "c")}


def test_missing_rules(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    kept = [r[0] for r in df.select(finite(F.col("v"))).collect()]
    assert kept == [1.0, None, None, None]
    assert [r[0] for r in df.select(floor_at(F.col("v"), 2.0)).limit(1).collect()] == [2.0]
    assert spark.range(1).select(floor_at(F.lit(None).cast("double"), 2.0)).first()[0] is None


def test_lgamma(spark):
    import math

    ks = [0.05, 0.5, 1.0, 1.5, 7.3, 60.0, 400.0]
    rows = spark.createDataFrame([(k,) for k in ks], "k double").select(lgamma(F.col("k"))).collect()
    assert [r[0] for r in rows] == pytest.approx([math.lgamma(k) for k in ks], rel=1e-11, abs=1e-11)


def test_skip_and_strict(cube, field):
    c = np.arange(T * Y * X, dtype=float).reshape(T, Y, X)
    c[2, 1, 1] = np.nan
    c[:, 0, 0] = np.nan
    table = cube(c=c, u=c, v=c, w=c)
    with np.errstate(all="ignore"):
        assert np.allclose(field(stats.temporal_mean(table, "c"), "c_mean"), np.nanmean(c, axis=0), equal_nan=True)
        assert np.allclose(field(stats.temporal_variance(table, "c"), "c_var"), np.nanvar(c, axis=0), equal_nan=True)
    strict = field(stats.rms_raw(table, "c", strictly=True), "c_rms")
    assert np.allclose(strict, np.sqrt(np.mean(c**2, axis=0)), equal_nan=True)
    assert np.isnan(strict[1, 1]) and np.isnan(strict[0, 0])


def test_intermittency_counts_only_present_samples(cube, field):
    c = np.full((4, 1, 3), 0.5)
    c[0, 0, 0] = np.nan
    c[1, 0, 0] = 0.1
    c[:, 0, 1] = np.nan
    c[:, 0, 2] = 0.2
    got = field(stats.intermittency(cube(c=c), 0.2), "intermittency")
    assert got[0].tolist() == [2 / 3, 0.0, 0.0]  # equal to the threshold does not exceed it
    assert field(stats.intermittency(cube(c=c), 0.2, percent=True), "intermittency")[0, 0] == pytest.approx(200 / 3)


def test_mean_squares_about_a_supplied_mean(cube, field, arrays):
    table = cube(**arrays)
    supplied = {k: np.full((1, Y, X), m) for k, m in zip(("u", "v", "w"), (0.1, 0.2, 0.4))}
    squares = turbulence.mean_squares(table, cube(**supplied), w_floor=-1e9)
    for k in ("u", "v", "w"):
        assert np.allclose(field(squares, f"{k}2"), np.mean((arrays[k] - supplied[k]) ** 2, axis=0))
    energy = field(turbulence.tke(squares), "tke")
    assert np.allclose(energy, 0.5 * sum(np.mean((arrays[k] - supplied[k]) ** 2, axis=0) for k in ("u", "v", "w")))


def test_w_floor_makes_a_pixel_missing(cube, field, arrays):
    w = arrays["w"].copy()
    w[3, 2, 2] = -20.0
    squares = field(turbulence.mean_squares(cube(**{**arrays, "w": w})), "w2")
    assert np.isnan(squares[2, 2]) and np.isfinite(np.delete(squares.ravel(), 2 * X + 2)).all()


def test_dissipation_equals_the_definition(cube, field, arrays):
    dx, nu = 0.01, 1.5e-5
    fluct = {k: arrays[k] - arrays[k].mean(axis=0) for k in ("u", "v")}
    du, dv = np.gradient(fluct["u"], dx, axis=1), np.gradient(fluct["v"], dx, axis=2)
    want = 5 * nu * sum(np.mean(d**2, axis=0) for d in (du, dv, -du - dv))
    for tile in (Tile(), Tile(2, 2, 3)):
        assert np.allclose(field(turbulence.dissipation(cube(**arrays), dx, nu, tile=tile), "epsilon"), want)
    zero = cube(**{k: np.zeros((1, Y, X)) for k in ("u", "v")})
    du, dv = np.gradient(arrays["u"], dx, axis=1), np.gradient(arrays["v"], dx, axis=2)
    want = 5 * nu * sum(np.mean(d**2, axis=0) for d in (du, dv, -du - dv))
    got = turbulence.dissipation(cube(**arrays), dx, nu, mean=zero.drop("t"))
    assert np.allclose(field(got, "epsilon"), want)


def test_scales_are_missing_without_dissipation(cube, field):
    flat = {k: np.ones((3, 2, 2)) for k in ("u", "v", "w")}
    table = cube(**flat)
    scales = turbulence.turbulence_scales(turbulence.mean_squares(table), turbulence.dissipation(table, 0.1))
    assert all(v is None for r in scales.collect() for v in r[3:])


def test_total_is_advective_plus_turbulent(cube, field, arrays):
    table = cube(**arrays)
    turbulent, advective, total = transport.turbulent_flux(table), transport.advective_flux(table), transport.total_flux(table)
    for k in ("uc", "vc"):
        assert np.allclose(field(turbulent, k) + field(advective, k), field(total, k))


def test_fluctuations_have_no_mean(cube, field, arrays):
    fluct = align.reynolds(cube(**arrays), w_floor=-1e9)
    for k in ("u", "v", "w"):
        assert np.abs(field(stats.temporal_mean(fluct, k), f"{k}_mean")).max() < 1e-12


def test_conditional_velocity_divides_by_all_frames(cube, field):
    c = np.zeros((4, 2, 4))
    c[1] = 1.0
    u = np.full((4, 2, 4), 3.0)
    got = transport.conditional_velocity(cube(c=c, u=u, v=-u), 2, 1.0)
    assert field(got, "u_cond").tolist() == [[0.75, 0.75]]
    assert field(got, "v_cond").tolist() == [[-0.75, -0.75]]


def test_voxels_stored_by_pixel_are_not_shuffled(spark, cube, arrays):
    stored = by_pixel(cube(**arrays))
    mean = align.mean_field(stored, "u", "v", "w")
    for df in (stats.temporal_mean(stored, "u"), align.reynolds(stored, mean)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan


def test_no_voxel_shuffle_of_statistics_beyond_the_partial_aggregate(cube, arrays):
    for df in (transport.turbulent_flux(cube(**arrays)), turbulence.mean_squares(cube(**arrays))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "partial_var_pop" in plan or "partial_covar_pop" in plan
        assert "Join" not in plan


def test_join_fields_checks_the_height(cube):
    c = np.zeros((2, 4, 2))
    trimmed = cube(u=c[:, :2])
    assert align.join_fields(trimmed, cube(c=c), y_offset=1, n_rows=2).count() == 8
    with pytest.raises(ValueError):
        align.join_fields(trimmed, cube(c=c), y_offset=1, n_rows=3)


def test_frame_counts_must_agree(cube):
    a, b = cube(u=np.zeros((3, 1, 1))), cube(c=np.zeros((2, 1, 1)))
    assert align.frame_count_check({"u": a, "v": a}).count() == 2
    with pytest.raises(Exception, match="frame counts differ"):
        align.frame_count_check({"u": a, "c": b}).collect()
