"""Readers, writers and the order of frames."""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyfield.functions.scalar import case_from_path
from eddyfield.model import extent, write_voxel
from eddyfield.operators import sequence
from eddyfield.sources import tables, versions


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def stack(nt=7, ny=3, nx=4):
    values = np.arange(nt * ny * nx, dtype=np.float32).reshape(nt, ny, nx)
    values[1, 2, 0] = np.nan
    values[2, 0, 0] = np.inf
    return values


@pytest.mark.parametrize("axes", ["tyx", "yxt"])
@pytest.mark.parametrize("dtype", ["float32", "float64"])
def test_stack(spark, field, folder, axes, dtype):
    values = stack()
    stored = values if axes == "tyx" else np.moveaxis(values, 0, -1)
    np.save(folder / "u.npy", np.ascontiguousarray(stored.astype(dtype)))
    got = field(tables.scan_stack(spark, {"u": f"{folder}/u.npy"}, axes=axes), "u", ("t", "y", "x"))
    assert np.array_equal(got, np.where(np.isinf(values), np.nan, values), equal_nan=True)
    one = tables.scan_stack(spark, {"u": f"{folder}/u.npy"}, axes=axes, frame=5)
    assert one.count() == 12 and one.agg(F.min("u"), F.max("t")).first() == (60.0, 5)
    with pytest.raises(Exception, match="out of range"):
        tables.scan_stack(spark, {"u": f"{folder}/u.npy"}, axes=axes, frame=7).count()


def test_stack_errors(spark, folder):
    np.save(folder / "u.npy", stack())
    np.save(folder / "v.npy", stack(nx=5))
    np.save(folder / "flat.npy", stack()[0])
    with pytest.raises(Exception, match="differ in shape"):
        tables.scan_stack(spark, {"u": f"{folder}/u.npy", "v": f"{folder}/v.npy"}).count()
    with pytest.raises(Exception, match="expected a 3-D stack"):
        tables.scan_stack(spark, {"u": f"{folder}/flat.npy"}).count()


def test_stack_of_several_files(spark, field, cube, folder):
    values = np.random.default_rng(0).random((37, 2, 3))
    written = tables.write_arrays(tables.frames_of(cube(c=values), "c"), str(folder), "npy", frames_per_file=5)
    assert written.count() == 8
    got = field(tables.scan_stack(spark, {"c": f"{folder}/c/a"}), "c", ("t", "y", "x"))
    assert np.array_equal(got, values.astype(np.float32))


def test_frame_list_order(spark, folder):
    frames = {f"arr_{i}": np.full((2, i % 3 + 1), i, dtype=np.float32) for i in (10, 2, 0, 11, 1)}
    np.savez(folder / "list.npz", extra=np.full((1, 1), -1.0), another=np.full((1, 2), -2.0), **frames)
    rows = tables.scan_frame_list(spark, f"{folder}/list.npz").orderBy("t").collect()
    assert [r["key"] for r in rows] == ["arr_0", "arr_1", "arr_2", "arr_10", "arr_11", "another", "extra"]
    assert [(r["ny"], r["nx"]) for r in rows[:3]] == [(2, 1), (2, 2), (2, 3)]
    cells = tables.voxels_of(tables.scan_frame_list(spark, f"{folder}/list.npz"))
    assert cells.filter("t = 2").agg(F.count("*"), F.max("y"), F.max("x"), F.sum("value")).first() == (6, 1, 2, 12.0)


def test_text_series_over_many_splits(spark, folder):
    lines = ["# header", "name x"] + [f"{i}, {i * 0.5}" + ("  # note" if i % 3 == 0 else "") for i in range(400)]
    lines.insert(50, "")
    lines.insert(120, "# pause")
    (folder / "run one.v2.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "512")
    try:
        series = tables.scan_text_series(spark, str(folder), skiprows=2, delimiter=",", y_scale=10.0)
        rows = series.orderBy("row_no").collect()
        index = tables.scan_text_series(spark, str(folder), skiprows=2, delimiter=",", xcol=None, ycol=0).orderBy("row_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["source"], r["row_no"], r["x"], r["y"]) for r in rows] == [("run one.v2", i, float(i), i * 5.0) for i in range(400)]
    assert [(r["x"], r["y"]) for r in index] == [(float(i), float(i)) for i in range(400)]


def test_single_column_series(spark, folder):
    (folder / "a.txt").write_text("1\n2\n4\n")
    rows = tables.scan_text_series(spark, str(folder)).orderBy("row_no").collect()
    assert [(r["x"], r["y"]) for r in rows] == [(0.0, 1.0), (1.0, 2.0), (2.0, 4.0)]
    stats = tables.series_stats(tables.scan_text_series(spark, str(folder))).first()
    assert (stats["mean"], stats["std"]) == pytest.approx((7 / 3, np.std([1, 2, 4])))


@pytest.mark.parametrize(
    "text, problem",
    [("# only\n\n", "no usable lines"), ("a | b\nc\n", "lack a head"), ("a | b | n\nc | d\n", "names on all")],
)
def test_manifest_errors(spark, folder, text, problem):
    (folder / "pairs.txt").write_text(text)
    with pytest.raises(ValueError, match=problem):
        tables.scan_manifest(spark, str(folder / "pairs.txt"))


def test_manifest_without_names(spark, folder):
    (folder / "pairs.txt").write_text("a|b\n  c |  d |  \n")
    assert sorted(map(tuple, tables.scan_manifest(spark, str(folder / "pairs.txt")).collect())) == [("a", "b", None), ("c", "d", None)]


def test_finding_inputs(spark, folder):
    for name in ("Taylor_Re_x.npy", "taylor_length.npy", "kolmogorov_time.npy", "notes.txt"):
        (folder / name).write_text("x")
    assert tables.find_inputs(spark, str(folder), "*.npy").count() == 3
    assert tables.first_input(spark, str(folder), "*.npy", ("taylor", "re")).endswith("Taylor_Re_x.npy")
    with pytest.raises(FileNotFoundError):
        tables.first_input(spark, str(folder), "*.npy", ("absent",))


def test_names():
    assert tables.output_name("x/a.set", "y/b.set") == "a_and_b"
    assert tables.output_name("x/a.set", "y/b.set", "run") == "run"


def test_case_from_path(spark):
    df = spark.createDataFrame([("d/mean_fields_near_bed.npz",), ("mean_fields_x.npy",)], "p string")
    got = [r[0] for r in df.select(case_from_path(F.col("p"), "mean_fields", r"\.npz$")).collect()]
    assert got == ["near_bed", None]


def test_versions(spark, folder, cube):
    root = f"{folder}/archive"
    table = cube(u=np.ones((1, 2, 2)), w=np.ones((1, 2, 2))).drop("t")
    assert versions.append_version(table, root) == 0
    newer = sequence.upsert_component(versions.read_version(spark, root), table.withColumn("w", F.lit(5.0)), "w")
    assert versions.append_version(newer, root) == 1
    latest = versions.read_version(spark, root)
    assert latest.agg(F.sum("u"), F.sum("w"), F.count("*")).first() == (4.0, 20.0, 4)


def test_voxel_layout_prunes(spark, folder, cube):
    write_voxel(cube(c=np.random.default_rng(0).random((70, 3, 4))), f"{folder}/voxel")
    from eddyfield.operators.select import frames

    picked = frames(spark.read.parquet(f"{folder}/voxel"), 33, 40)
    assert picked.count() == 7 * 12
    assert len(picked.inputFiles()) == 3  # files of the table
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(t_block" in plan and "PushedFilters: [IsNotNull(t)" in plan


def test_interleave(cube):
    a = cube(c=np.arange(4.0).reshape(4, 1, 1))
    b = cube(c=10 + np.arange(3.0).reshape(3, 1, 1))
    both = sequence.interleave_heads(a, b).orderBy("t").collect()
    assert [(r["t"], r["c"]) for r in both] == list(enumerate([0, 10, 1, 11, 2, 12]))
    part = sequence.interleave_heads(a, b, offset=3, limit=2).orderBy("t").collect()
    assert [(r["t"], r["c"]) for r in part] == [(0, 11.0), (1, 2.0)]
    for bad in ({"offset": -1}, {"offset": 6}, {"limit": 0}, {"limit": -2}):
        with pytest.raises(ValueError):
            sequence.interleave_heads(a, b, **bad)


def test_circular_lag_by_the_whole_length_is_identity(cube):
    table = cube(c=np.random.default_rng(0).random((5, 2, 2)))
    moved = sequence.circular_lag(table, 5, extent(table))
    assert moved.exceptAll(table.select(moved.columns)).isEmpty()
    back = sequence.circular_lag(sequence.circular_lag(table, 3, extent(table)), -3, extent(table))
    assert back.exceptAll(table.select(back.columns)).isEmpty()


def test_renumbered_frames_still_prune_rightly(spark, folder, cube):
    from eddyfield.operators.select import frames

    write_voxel(cube(c=np.arange(80.0).reshape(80, 1, 1)), f"{folder}/voxel")
    stored = spark.read.parquet(f"{folder}/voxel")
    train, test = sequence.train_test(stored, 40)
    moved = [
        (sequence.offset_limit(stored, 35), 40, 75.0),
        (sequence.offset_limit(stored, 35, 30), 29, 64.0),
        (sequence.circular_lag(stored, 70, extent(stored)), 0, 70.0),
        (sequence.concat_stacks(stored, stored), 81, 1.0),
        (test, 33, 73.0),
        (train, 33, 33.0),
    ]
    for df, t, value in moved:
        assert [r["c"] for r in frames(df, t, t + 1).collect()] == [value]


def test_concat_and_split(cube):
    a, b = cube(c=np.zeros((3, 1, 1))), cube(c=np.ones((2, 1, 1)))
    whole = sequence.concat_stacks(a, b)
    assert [(r["t"], r["c"]) for r in whole.orderBy("t").collect()] == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]
    train, test = sequence.train_test(whole, 3)
    assert train.exceptAll(a.select(train.columns)).isEmpty() and test.exceptAll(b.select(test.columns)).isEmpty()
    with pytest.raises(ValueError):
        sequence.concat_stacks(a.filter("false"), b.filter("false"))
