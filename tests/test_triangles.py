"""Triangulations against brute force, and interpolation on them."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eddyfield.operators import triangles

POINTS = "case_id string, t int, x_mm double, y_mm double, c double"
TARGETS = "case_id string, t int, y int, x int, x_mm double, y_mm double"


def empty_circles(x, y) -> set[tuple[int, int, int]]:
    """All triples whose circumcircle holds no other point."""
    found = set()
    for a, b, c in itertools.combinations(range(len(x)), 3):
        bx, by, cx, cy = x[b] - x[a], y[b] - y[a], x[c] - x[a], y[c] - y[a]
        double = 2 * (bx * cy - by * cx)
        if double:
            ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / double, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / double
            gap = (x - x[a] - ux) ** 2 + (y - y[a] - uy) ** 2
            gap[[a, b, c]] = np.inf
            if (gap > ux * ux + uy * uy).all():
                found.add((a, b, c))
    return found


@pytest.mark.parametrize("n", [3, 4, 7, 25, 45])
def test_helper_equals_brute_force(n):
    rng = np.random.default_rng(n)
    for _ in range(4):
        x, y = rng.random(n), rng.random(n) * rng.choice([1.0, 0.01, 300.0])
        got = [tuple(sorted(t)) for t in triangles.delaunay(x.tolist(), y.tolist())]
        assert len(got) == len(set(got)) and set(got) == empty_circles(x, y)


def test_helper_without_triangles():
    assert triangles.delaunay([0.0, 1.0, 2.0, 3.0], [0.0] * 4) == []
    assert triangles.delaunay([0.0, 1.0], [0.0, 1.0]) == []


def cloud(rng, n):
    """Points of uneven density with a large gap and a few far away."""
    x, y = rng.random(n) ** 2 * 40, rng.random(n) * 30
    keep = (x - 15) ** 2 + (y - 15) ** 2 > 36
    return np.append(x[keep], [90.0, -30.0, 44.0]), np.append(y[keep], [15.0, 60.0, -50.0])


@pytest.mark.parametrize("tile", [12, 60, 1000])
def test_tiles_give_the_triangles_of_the_whole(spark, tile):
    """Also on a regular mesh, where every four neighbours lie on one circle."""
    rng = np.random.default_rng(tile)
    rows = []
    for t in range(3):
        rows += [("a", t, float(x), float(y), 1.0) for x, y in zip(*cloud(rng, 400))]
    rows += [("b", 0, float(x), float(y), 1.0) for x in range(25) for y in range(18)]
    placed = triangles.numbered(spark.createDataFrame(rows, POINTS), "c")
    whole = triangles.triangulate(placed, whole=10**9)
    tiled = triangles.triangulate(placed, tile=tile, whole=5)
    assert sorted(tiled.collect()) == sorted(whole.collect())
    assert tiled.filter("case_id = 'b'").count() >= 2 * 24 * 17


def test_tiles_that_batches_cut(rng=np.random.default_rng(4)):
    """Runs of one key come whole and in order, wherever the batches end; many tiles share one call."""
    sizes = [1, 7, 30, 2, 2, 45]
    rows = [("a", 0, k, 0, 100 * k + i, float(x), float(y), 9.0) for k, n in enumerate(sizes) for i, (x, y) in enumerate(rng.random((n, 2)))]
    names = ["case_id", "t", "cx", "cy", "id", "px", "py", "side"]
    table = pa.table([pa.array(c) for c in zip(*rows)], names=names)
    for size in (1, 3, 11, len(rows)):
        batches = table.to_batches(max_chunksize=size)
        runs = [t.slice(i, j - i) for t, at in triangles._whole(iter(batches), ["case_id", "t", "cx", "cy"]) for i, j in zip(at[:-1], at[1:])]
        assert [r.num_rows for r in runs] == sizes and pa.concat_tables(runs).equals(table)
        calls = list(triangles._tiles(iter(batches)))
        assert size < len(rows) or len(calls) <= 2
        whole = pa.Table.from_batches(calls).to_pylist()
        assert whole == pa.Table.from_batches(list(triangles._tiles(iter(table.to_batches())))).to_pylist()
        assert all(r["a"] == min(r["a"], r["b"], r["c"]) for r in whole)


def test_values_at_nodes_and_on_linear_fields(spark):
    rng = np.random.default_rng(3)
    x, y = cloud(rng, 300)
    linear = 2.0 + 0.3 * x - 0.7 * y
    noise = rng.normal(size=len(x))
    points = [("a", 0, float(u), float(v), float(c)) for u, v, c in zip(x, y, linear)]
    points += [("a", 1, float(u), float(v), float(c)) for u, v, c in zip(x, y, noise)]
    points += [("a", 0, 3.0, 3.0, None), ("a", 1, None, 3.0, 5.0), ("a", 2, 1.0, 1.0, 4.0), ("a", 2, 2.0, 2.0, 4.0), ("a", 2, 3.0, 3.0, 4.0)]
    tx, ty = rng.uniform(-40, 100, 400), rng.uniform(-60, 70, 400)
    targets = [("a", 0, 0, i, float(u), float(v)) for i, (u, v) in enumerate(zip(tx, ty))]
    targets += [("a", 1, 0, i, float(u), float(v)) for i, (u, v) in enumerate(zip(x, y))]
    targets += [("a", 2, 0, 0, 1.5, 1.5), ("a", 3, 0, 0, 1.0, 1.0)]
    out = triangles.regrid_triangles(spark.createDataFrame(points, POINTS), spark.createDataFrame(targets, TARGETS), "c", fill=-99.0, tile=30, whole=50)
    got = {(r["t"], r["x"]): r["c"] for r in out.collect()}
    assert len(got) == len(targets)
    hull = empty_circles(x, y)

    def held(u, v):
        for a, b, c in hull:
            m = np.array([[x[a], x[b], x[c]], [y[a], y[b], y[c]], [1, 1, 1]])
            if (np.linalg.solve(m, [u, v, 1.0]) >= -1e-12).all():
                return True
        return False

    inside = np.array([got[0, i] != -99.0 for i in range(400)])
    expected = np.array([held(u, v) for u, v in zip(tx, ty)])
    assert (inside == expected).all() and 50 < inside.sum() < 350
    assert [got[0, i] for i in np.flatnonzero(inside)] == pytest.approx((2.0 + 0.3 * tx - 0.7 * ty)[inside], abs=1e-9)
    assert [got[1, i] for i in range(len(x))] == pytest.approx(noise, abs=1e-6)
    assert got[2, 0] == -99.0 and got[3, 0] == -99.0


def test_equal_to_brute_force_triangles_with_gaps(spark):
    rng = np.random.default_rng(9)
    x, y, c = rng.random(40), rng.random(40), rng.random(40)
    c[rng.random(40) < 0.3] = np.nan
    valid = ~np.isnan(c)
    vx, vy, vc = x[valid], y[valid], c[valid]
    tx, ty = rng.random(150), rng.random(150)
    want = np.full(150, np.nan)
    for a, b, d in empty_circles(vx, vy):
        m = np.array([[vx[a], vx[b], vx[d]], [vy[a], vy[b], vy[d]], [1, 1, 1]])
        w = np.linalg.solve(m, np.stack([tx, ty, np.ones(150)]))
        hit = (w >= 0).all(axis=0)
        want[hit] = (w[:, hit] * vc[[a, b, d]][:, None]).sum(axis=0)
    points = spark.createDataFrame([("a", 0, float(u), float(v), None if np.isnan(k) else float(k)) for u, v, k in zip(x, y, c)], POINTS)
    targets = spark.createDataFrame([("a", 0, 0, i, float(u), float(v)) for i, (u, v) in enumerate(zip(tx, ty))], TARGETS)
    out = triangles.regrid_triangles(points, targets, "c", tile=10, whole=12).orderBy("x").collect()
    got = np.array([np.nan if r["c"] is None else r["c"] for r in out])
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)
    assert triangles.regrid_triangles(points.filter(F.lit(False)), targets, "c").filter("c is not null").count() == 0
