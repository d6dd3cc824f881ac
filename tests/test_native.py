"""Frames on their own grids."""

from __future__ import annotations

import tempfile

import numpy as np
import pytest

from eddyfield.operators import native
from eddyfield.sources import tables

SCHEMA = "case_id string, t int, x_mm array<double>, y_mm array<double>, u array<float>"


def frames_of(rng, n, case="run"):
    """Frames of different sizes; the rows run downwards."""
    rows, arrays = [], []
    for t in range(n):
        ny, nx = 4 + t % 3, 6 + t % 4
        u = rng.random((ny, nx)).astype("float32")
        x, y = np.arange(nx) * 0.5 - 0.1 * t, 3.0 - np.arange(ny) * 0.7
        rows.append((case, t, x.tolist(), y.tolist(), u.ravel().tolist()))
        arrays.append((x, y, u))
    return rows, arrays


@pytest.mark.parametrize("offset,limit", [(0, None), (1, None), (3, 4)])
def test_interleaved_and_cropped_like_arrays(spark, offset, limit):
    rng = np.random.default_rng(1)
    (rows_a, a), (rows_b, b) = frames_of(rng, 6), frames_of(rng, 5)
    turns = [(a, b)[k % 2][k // 2] for k in range(offset, 10)][:limit]
    out = native.interleave_native(spark.createDataFrame(rows_a, SCHEMA), spark.createDataFrame(rows_b, SCHEMA), (2.0, 0.5), (1.0, 2.5), 0.3, offset, limit)
    got = out.orderBy("t").collect()
    assert [r["t"] for r in got] == list(range(len(turns)))
    for r, (x, y, u) in zip(got, turns):
        rows, columns = (y >= 0.7) & (y <= 2.8), (x >= 0.2) & (x <= 2.3)
        assert r["x_mm"] == pytest.approx(x[columns]) and r["y_mm"] == pytest.approx(y[rows])
        assert np.array_equal(np.array(r["u"], "float32"), u[rows][:, columns].ravel())
    with pytest.raises(ValueError, match="exceeds"):
        native.interleave_native(spark.createDataFrame(rows_a, SCHEMA), spark.createDataFrame(rows_b, SCHEMA), offset=10)


def test_common_bounds_and_empty_frames(spark):
    rows, arrays = frames_of(np.random.default_rng(2), 4)
    frames = spark.createDataFrame(rows, SCHEMA)
    bounds = native.common_bounds(frames).first()
    assert bounds["x_low"] == pytest.approx(max(x.min() for x, _, _ in arrays)) and bounds["x_high"] == pytest.approx(min(x.max() for x, _, _ in arrays))
    cropped = native.crop(frames).collect()
    assert all(min(r["x_mm"]) >= bounds["x_low"] and max(r["y_mm"]) <= bounds["y_high"] for r in cropped)
    beyond = native.crop(frames, (100, 101), (0, 1)).collect()
    assert len(beyond) == 4 and all(r["x_mm"] == [] and r["u"] == [] for r in beyond)
    assert native.voxels_of(native.crop(frames, (100, 101), (0, 1))).count() == 0


def test_voxels_and_back(spark):
    rows, arrays = frames_of(np.random.default_rng(3), 4)
    frames = spark.createDataFrame(rows, SCHEMA)
    cells = native.voxels_of(frames)
    assert cells.count() == sum(u.size for _, _, u in arrays)
    assert sorted(native.from_voxels(cells, "u").collect()) == sorted(frames.collect())
    with pytest.raises(Exception, match="full rectangle"):
        native.from_voxels(cells.filter("not (t = 1 and y = 0 and x = 0)"), "u").collect()


def test_lists_of_frames_and_axes(spark):
    rows, _ = frames_of(np.random.default_rng(4), 20)
    frames = spark.createDataFrame(rows, SCHEMA)
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    tables.write_arrays(native.lists_of(frames), root, "npz").count()
    lists = {k: tables.scan_frame_list(spark, f"{root}/{k}/run", case_id="run", component=k) for k in ("u", "xgrid", "ygrid")}
    back = native.from_lists({"u": lists["u"]}, lists["xgrid"], lists["ygrid"]).orderBy("t").collect()
    assert [r["u"] for r in back] == [r[4] for r in rows]
    assert [r["x_mm"] for r in back] == [pytest.approx(r[2], abs=1e-6) for r in rows]
    with pytest.raises(Exception, match="lacks a part"):
        native.from_lists({"u": lists["u"].filter("t <> 7")}, lists["xgrid"], lists["ygrid"]).collect()
    with pytest.raises(Exception, match="differ in size"):
        native.from_lists({"u": lists["u"]}, lists["ygrid"], lists["xgrid"]).collect()
