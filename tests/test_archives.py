"""Archives by name, meshes, manifests, splits and histograms."""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyfield.operators import align, distribution, mesh
from eddyfield.sources import tables


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def test_components_by_name(spark, field, folder):
    rng = np.random.default_rng(0)
    stacks = {k: rng.random((9, 5, 6)).astype("float32") for k in "uvw"}
    for k, v in stacks.items():
        np.save(folder / f"piv_smooth_{k}.npy", v)
    rows = tables.scan_components(spark, str(folder), "smooth", t=(2, 7), y=(1, None), x=(None, 4))
    assert rows.count() == 5 * 4 * 4 and rows.columns == ["case_id", "t", "y", "x", "u", "v", "w"]
    for k, v in stacks.items():
        assert np.array_equal(field(rows, k, ("t", "y", "x"))[2:, 1:], v[2:7, 1:, :4])
    with pytest.raises(Exception, match="piv_rough_u"):
        tables.scan_components(spark, str(folder), "rough").count()


def test_mean_fields_by_name(spark, field, folder):
    means = {k: np.random.default_rng(ord(k)).random((4, 3)) for k in "uvw"}
    means["u"][1, 2] = np.nan
    for k, v in means.items():
        np.save(folder / f"smooth_{k}_mean.npy", v)
    got = tables.scan_mean_fields(spark, str(folder), "smooth")
    for k, v in means.items():
        assert np.array_equal(field(got, k), v, equal_nan=True)
    np.save(folder / "smooth_w_mean.npy", np.zeros((4, 4)))
    with pytest.raises(ValueError, match="differ in size"):
        tables.scan_mean_fields(spark, str(folder), "smooth")


def test_field_arrays_round_trip(spark, field, cube, folder):
    c = np.random.default_rng(3).random((1, 5, 4))
    c[0, 2, 2] = np.nan
    written = tables.write_field_arrays(cube(c=c).select("case_id", "y", "x", "c"), str(folder)).collect()
    assert [Path(r["path"]).name for r in written] == ["a_c_mean.npy"]
    assert np.array_equal(np.load(folder / "a_c_mean.npy"), c[0], equal_nan=True)


def meshes(folder, bend):
    x, y = np.meshgrid(np.arange(6) * 0.5, 3 - np.arange(4) * 0.25)
    np.save(folder / "x.npy", x + bend * np.arange(4)[:, None])
    np.save(folder / "y.npy", y)


def test_grids_and_their_kinds(spark, folder):
    kinds = {}
    for name, bend in (("straight", 0.0), ("near", 1e-9), ("bent", 0.01)):
        meshes(folder, bend)
        grid = tables.scan_grid(spark, f"{folder}/x.npy", f"{folder}/y.npy", case_id=name)
        assert grid.count() == 24
        kinds[name] = mesh.mesh_kind(grid).first()
        if name == "bent":
            with pytest.raises(ValueError, match="curvilinear"):
                mesh.axes_of_mesh(grid)
            fields = spark.createDataFrame([("bent", 3, 4)], "case_id string, y int, x int")
            with pytest.raises(ValueError, match="4 x 6 points, its field 4 x 5"):
                mesh.check_mesh(grid, fields)
            with pytest.raises(ValueError, match="None"):
                mesh.check_mesh(grid, fields.withColumn("case_id", F.lit("absent")))
        else:
            axes = mesh.axes_of_mesh(grid).orderBy("dim", "idx").collect()
            assert [r["mm"] for r in axes] == pytest.approx([*np.arange(6) * 0.5, *(3 - np.arange(4) * 0.25)], abs=1e-6)
    assert [kinds[n]["straight"] for n in ("straight", "near", "bent")] == [True, True, False]
    np.save(folder / "x.npy", np.arange(6) * 0.5)
    with pytest.raises(ValueError, match="both be axes or meshes"):
        tables.scan_grid(spark, f"{folder}/x.npy", f"{folder}/y.npy")
    np.save(folder / "y.npy", np.arange(3) * 1.0)
    grid = tables.scan_grid(spark, f"{folder}/x.npy", f"{folder}/y.npy")
    assert grid.count() == 18 and grid.filter("y = 2 and x = 5").first()[3:] == (2.5, 2.0)


def test_location_in_a_curved_mesh(spark):
    """Polar cells: every point lies in the cell of its radius and angle."""
    rows, columns = 12, 20
    grid = [("p", j, i, (2 + j) * np.cos(0.05 * i), (2 + j) * np.sin(0.05 * i)) for j in range(rows) for i in range(columns)]
    grid = [(c, j, i, float(x), float(y)) for c, j, i, x, y in grid if not (j == 5 and i == 5)]
    rng = np.random.default_rng(4)
    radius, angle = rng.uniform(1, 15, 300), rng.uniform(-0.2, 1.2, 300)
    points = [("p", k, float(r * np.cos(a)), float(r * np.sin(a))) for k, (r, a) in enumerate(zip(radius, angle))]
    out = mesh.locate_in_mesh(spark.createDataFrame(grid, "case_id string, y int, x int, x_mm double, y_mm double"), spark.createDataFrame(points, "case_id string, point int, x_mm double, y_mm double"))
    got = {r["point"]: (r["y"], r["x"]) if r["inside"] else None for r in out.collect()}
    assert len(got) == 300
    checked = 0
    for k, (r, a) in enumerate(zip(radius, angle)):
        j, i = r - 2, a / 0.05
        if min(abs(j - round(j)), abs(i - round(i))) < 0.02:
            continue  # straight sides of cells leave the circles a little
        checked += 1
        inside = 0 <= j < rows - 1 and 0 <= i < columns - 1 and not (4 <= j < 6 and 4 <= i < 6)
        assert got[k] == ((int(j), int(i)) if inside else None)
    assert checked > 200


def test_missing_files_of_a_manifest(spark, folder):
    (folder / "a.set").write_text("x")
    (folder / "pairs.txt").write_text(f"{folder}/a.set | {folder}/b.set\n{folder}/a.set | {folder}/a.set\n")
    assert [r["path"] for r in tables.missing_inputs(tables.scan_manifest(spark, f"{folder}/pairs.txt")).collect()] == [f"{folder}/b.set"]
    with pytest.raises(FileNotFoundError, match="b.set"):
        tables.checked_manifest(spark, f"{folder}/pairs.txt")
    (folder / "b.set").write_text("x")
    assert tables.checked_manifest(spark, f"{folder}/pairs.txt").count() == 2


def test_split_copies_the_other_tables(spark, cube, folder):
    c = np.random.default_rng(1).random((7, 2, 3))
    tables.write_split({"voxel": cube(c=c), "notes": spark.range(3)}, "voxel", 5, str(folder))
    for part, frames in (("train", 5), ("test", 2)):
        assert spark.read.parquet(f"{folder}/{part}/voxel").agg(F.max("t"), F.count("*")).first() == (frames - 1, frames * 6)
        assert spark.read.parquet(f"{folder}/{part}/notes").count() == 3


@pytest.mark.parametrize("bins,bounds", [(10, None), (1, None), (7, (0.2, 0.6)), (4, (0.5, 0.5)), (5, (5.0, 6.0))])
def test_bins_like_numpy(spark, bins, bounds):
    rng = np.random.default_rng(bins)
    values = np.round(rng.random(500), 2)  # many samples on edges
    rows = [("a", float(v)) for v in values] + [("a", None), ("a", float("nan")), ("empty", None), (None, 0.25), (None, 0.25)]
    samples = spark.createDataFrame(rows, "g string, c double")
    got = distribution.pdf_by_bins(samples, ["g"], bins, bounds).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins, bounds)
    mine = [r for r in got if r["g"] == "a"]
    assert [r["n"] for r in mine] == counts.tolist()
    assert [r["left"] for r in mine] == pytest.approx(edges[:-1]) and mine[-1]["right"] == pytest.approx(edges[-1])
    if counts.sum():
        assert [r["pdf"] for r in mine] == pytest.approx(np.histogram(values, bins, bounds, density=True)[0])
    else:
        assert {r["pdf"] for r in mine} == {None}
    empty = [r for r in got if r["g"] == "empty"]
    assert len(empty) == bins and {(r["n"], r["pdf"]) for r in empty} == {(0, None)}
    assert (empty[0]["left"] is None) == (bounds is None)
    assert sum(r["n"] for r in got if r["g"] is None) == (2 if bounds is None or bounds[0] <= 0.25 <= bounds[1] or bounds == (0.5, 0.5) else 0)
    with pytest.raises(ValueError):
        distribution.pdf_by_bins(samples, ["g"], 0)


def test_join_refuses_every_mismatch(cube):
    u = np.zeros((3, 4, 5))
    for other in (u[:2], u[:, :3], u[:, :, :4]):
        with pytest.raises(ValueError, match="differ in size"):
            align.join_fields(cube(u=u), cube(c=other))
    assert align.join_fields(cube(u=u), cube(c=u[:2, :, :4]), trim=("t", "x")).count() == 2 * 4 * 4
    with pytest.raises(ValueError, match="differ in size"):
        align.join_fields(cube(u=u).unionByName(cube(case="b", u=u)), cube(c=u))
