"""Interpolation and gap filling, against NumPy and brute force."""

from __future__ import annotations

import numpy as np
import pytest

from eddyfield.operators import align, regrid, select


def axes_of(spark, xs, ys, case="a"):
    rows = [(case, "x", i, float(v)) for i, v in enumerate(xs)] + [(case, "y", i, float(v)) for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "case_id string, dim string, idx int, mm double")


def bilinear(field, xs, ys, x, y, fill):
    """Value at one point of a grid with ascending axes."""
    if not (xs[0] <= x <= xs[-1] and ys[0] <= y <= ys[-1]):
        return fill
    i = min(np.searchsorted(xs, x, side="right") - 1, len(xs) - 2)
    j = min(np.searchsorted(ys, y, side="right") - 1, len(ys) - 2)
    a, b = (x - xs[i]) / (xs[i + 1] - xs[i]), (y - ys[j]) / (ys[j + 1] - ys[j])
    f = field
    return (1 - b) * ((1 - a) * f[j, i] + a * f[j, i + 1]) + b * ((1 - a) * f[j + 1, i] + a * f[j + 1, i + 1])


@pytest.mark.parametrize("fill", [None, -9.0])
def test_bilinear(spark, cube, field, fill):
    rng = np.random.default_rng(8)
    c = rng.random((2, 5, 6))
    c[1, 2, 3] = np.nan
    xs, ys = np.array([0.0, 1.0, 1.5, 3.0, 4.0, 6.0]), np.array([0.0, 0.5, 2.0, 2.5, 3.0])
    tx, ty = np.array([-0.5, 0.0, 0.7, 1.5, 2.9, 6.0, 6.01]), np.array([3.0, 1.0, 0.5, 0.0, -1.0])
    # the stored rows run downwards
    got = regrid.regrid(cube(c=c[:, ::-1]), axes_of(spark, xs, ys[::-1]), axes_of(spark, tx, ty), ["c"], fill=fill)
    out = field(got, "c", ("t", "y", "x"))
    empty = np.nan if fill is None else fill
    want = [[[bilinear(c[t], xs, ys, x, y, empty) for x in tx] for y in ty] for t in range(2)]
    assert np.allclose(out, want, equal_nan=True)


def test_nearest(spark, cube, field):
    c = np.arange(12.0).reshape(1, 3, 4)
    got = regrid.regrid(
        cube(c=c), axes_of(spark, [0, 1, 2, 3], [0, 1, 2]), axes_of(spark, [0.4, 0.6, 3.0, 1.0], [1.4, 1.6]), ["c"], method="nearest"
    )
    assert field(got, "c", ("t", "y", "x"))[0].tolist() == [[4, 5, 7, 5], [8, 9, 11, 9]]
    with pytest.raises(ValueError):
        regrid.regrid(cube(c=c), axes_of(spark, [0], [0]), axes_of(spark, [0], [0]), ["c"], method="cubic")


def test_nearest_coord_ties_and_ends(spark):
    axis = axes_of(spark, [3.0, 2.0, 1.0, 0.0], [0.0])
    targets = spark.createDataFrame([("a", "x", v) for v in (-5.0, 0.5, 1.0, 2.6, 9.0)], "case_id string, dim string, target double")
    got = {r["target"]: r["idx"] for r in align.nearest_coord(axis, targets).collect()}
    assert got == {-5.0: 3, 0.5: 2, 1.0: 2, 2.6: 0, 9.0: 0}


def brute_fill(f):
    out = f.copy()
    present = [(y, x) for y in range(f.shape[0]) for x in range(f.shape[1]) if not np.isnan(f[y, x])]
    for y in range(f.shape[0]):
        for x in range(f.shape[1]):
            if np.isnan(f[y, x]) and present:
                out[y, x] = f[min(present, key=lambda p: ((p[0] - y) ** 2 + (p[1] - x) ** 2, p))]
    return out


@pytest.mark.parametrize("share", [0.1, 0.6, 0.97, 1.0])
def test_fill_nearest(cube, field, share):
    rng = np.random.default_rng(int(share * 100))
    f = np.where(rng.random((17, 13)) < share, np.nan, rng.random((17, 13)))
    got = field(regrid.fill_nearest(cube(f=f[None]).drop("t"), "f"), "f")
    assert np.array_equal(got, brute_fill(f), equal_nan=True)


@pytest.mark.parametrize("kind", ["even", "crowded", "far"])
def test_curvilinear(spark, kind):
    rng = np.random.default_rng(6)
    points = [("a", int(t), *map(float, rng.random(2) * 10), float(v)) for t in range(2) for v in range(40)]
    points += [("a", 0, 50.0, 50.0, 99.0), ("a", 2, 1.0, 1.0, None)]
    if kind == "crowded":  # most points in a spot far smaller than a cell, some in the same place
        points += [("a", 1, 4.0 + float(a) * 1e-4, 4.0 + float(b) * 1e-4, 200.0 + i) for i, (a, b) in enumerate(rng.random((300, 2)))]
        points += [("a", 1, 4.0, 4.0, 500.0 + i) for i in range(300)]
    step = 60 if kind == "far" else 3
    targets = [("a", t, y, x, float(x * step - 4), float(y * step - 4)) for t in range(3) for y in range(6) for x in range(6)]
    p = spark.createDataFrame(points, "case_id string, t int, x_mm double, y_mm double, c double")
    q = spark.createDataFrame(targets, "case_id string, t int, y int, x int, x_mm double, y_mm double")
    got = {(r["t"], r["y"], r["x"]): r["c"] for r in regrid.regrid_curvilinear(p, q, "c", cell=0.5, fill=-1.0).collect()}
    assert len(got) == len(targets)
    for _, t, y, x, tx, ty in targets:
        near = [((a - tx) ** 2 + (b - ty) ** 2, v) for _, s, a, b, v in points if s == t and v is not None]
        assert got[t, y, x] == (min(near)[1] if near else -1.0)


def test_bad_bounds(spark, cube):
    table = cube(c=np.zeros((2, 3, 3)))
    for bad in ({"t": (2, 2)}, {"x": (-1, 2)}, {"y": (3, 1)}):
        with pytest.raises(ValueError):
            select.roi_index(table, **bad)
    with pytest.raises(IndexError):
        select.frame_pick(table, 2, n_frames=2)
    with pytest.raises(ValueError):
        select.roi_coords(table, axes_of(spark, [0, 1, 2], [0, 1, 2]), x_mm=(10, 20))


def test_filling_an_empty_field(cube):
    empty = cube(f=np.ones((1, 2, 2))).drop("t").limit(0)
    assert regrid.fill_nearest(empty, "f").count() == 0
