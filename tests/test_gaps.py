"""Absent rows, repeated keys and column-order files: neighbours and frames by their index."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyfield.operators import select, stencil
from eddyfield.session import new_path
from eddyfield.sources.arrays import FrameListSource, StackSource, write_bytes


def test_slopes_over_a_gap_are_missing(spark):
    """x = 0, 1, 2, 5, 6 with c = x^2: nothing is known about the slope beside the gap."""
    rows = [("a", 0, 0, x, float(x * x)) for x in (0, 1, 2, 5, 6)]
    voxel = spark.createDataFrame(rows, "case_id string, t int, y int, x int, c double")
    got = {r["x"]: r["d_dx"] for r in stencil.spatial_gradient(voxel, dx=1.0, dy=1.0).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: None, 5: None, 6: 11.0}


def test_median_counts_by_index(spark):
    rows = [("a", 0, y, x, float(x)) for y in (0, 1, 2) for x in (0, 1, 2, 9, 10)]
    field = spark.createDataFrame(rows, "case_id string, t int, y int, x int, c double")
    shape = spark.createDataFrame([("a", 3, 11)], "case_id string, ny int, nx int")
    got = {(r["y"], r["x"]): r["c"] for r in stencil.median_filter(field, "c", 3, shape).collect()}
    assert got[(1, 2)] == 1.5 and got[(1, 9)] == 9.5


@pytest.fixture
def archives(spark, tmp_path):
    for name, base in (("a", 0), ("b", 100)):
        np.savez(tmp_path / f"{name}.npz", **{f"arr_{i}": np.full((2, 2), base + i, "float32") for i in range(12)}, extra=np.full((2, 2), base + 50, "float32"))
    return tmp_path


def test_archives_follow_each_other(spark, archives):
    spark.dataSource.register(FrameListSource)
    frames = spark.read.format("frame_list").option("path", str(archives)).option("case_id", "a").load()
    values = [r["v"] for r in frames.orderBy("t").select(F.col("data")[0].alias("v")).collect()]
    assert values == [*range(12), 50, *range(100, 112), 150]


@pytest.mark.parametrize("axes", ["tyx", "yxt"])
@pytest.mark.parametrize("frame", [None, 2])
def test_column_order_stacks(spark, tmp_path, axes, frame):
    spark.dataSource.register(StackSource)
    stack = np.arange(2 * 3 * 4, dtype="float32").reshape(2, 3, 4)
    if axes == "tyx":
        stack = np.concatenate([stack, stack + 100])
    np.save(tmp_path / "c.npy", np.asfortranarray(stack))
    reader = spark.read.format("field_stack").option("c", str(tmp_path / "c.npy")).option("axes", axes)
    rows = (reader if frame is None else reader.option("frame", str(frame))).load().collect()
    where = {k: axes.index(k) for k in "tyx"}
    want = {tuple(i[where[k]] for k in "tyx"): float(v) for i, v in np.ndenumerate(stack)}
    if frame is not None:
        want = {k: v for k, v in want.items() if k[0] == frame}
    assert {(r["t"], r["y"], r["x"]): r["c"] for r in rows} == want


def test_writers_do_not_share_a_part(tmp_path):
    path = str(tmp_path / "out" / "x.npy")
    write_bytes(path, b"1")
    write_bytes(path, b"2")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["x.npy"]


def test_bounds_reach_the_scan(spark, cube):
    voxel = cube(c=np.random.default_rng(0).random((3, 8, 9)))
    path = new_path(spark, "pruned")
    voxel.write.parquet(path)
    axis = spark.createDataFrame(
        [("a", "x", i, float(i)) for i in range(9)] + [("a", "y", i, 10.0 - i) for i in range(8)], "case_id string, dim string, idx int, mm double"
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    crop = select.roi_coords(spark.read.parquet(path), axis, x_mm=(2.0, 4.5), y_mm=(7.0, 8.0))
    plan = crop._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,2)" in plan and "LessThanOrEqual(x,4)" in plan and "LessThanOrEqual(y,3)" in plan
    assert crop.count() == 3 * 2 * 3
