"""Ranges that the array readers know before they read."""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np
import pytest

from eddyfield.sources import arrays, tables

NT, NY, NX = 70, 12, 9


@pytest.fixture(scope="module")
def folder():
    path = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    values = np.arange(NT * NY * NX, dtype=np.float32).reshape(NT, NY, NX)
    values[3, 4, 5] = np.nan
    np.save(path / "c.npy", values)
    np.save(path / "last.npy", np.ascontiguousarray(np.moveaxis(values, 0, -1)))
    np.save(path / "columns.npy", np.asfortranarray(values))
    np.savez(path / "list.npz", **{f"arr_{t}": values[t, : 3 + t % 4] for t in range(NT)})
    return path


def read(reader):
    """Rows and the bytes read."""
    rows = [tuple(row.values()) for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    return rows, reader.bytes_read


def test_one_frame_and_one_band_of_rows_are_all_that_is_read(folder):
    reader = arrays.StackReader({"c": f"{folder}/c.npy", "case_id": "a", "t_span": "40:41", "y_span": "5:8"})
    rows, size = read(reader)
    assert len(reader.partitions()) == 1 and size == 3 * NX * 4 and len(rows) == 3 * NX
    assert {(r[1], r[2]) for r in rows} == {(40, y) for y in (5, 6, 7)}
    assert read(arrays.StackReader({"c": f"{folder}/c.npy"}))[1] == NT * NY * NX * 4


def test_a_frame_list_opens_wanted_members_only(folder):
    reader = arrays.FrameListReader({"path": f"{folder}/list.npz", "case_id": "a", "key_list": '["arr_5", "arr_50"]', "t_span": ":21"})
    rows, size = read(reader)
    assert [r[1] for r in rows] == [5] and size == (3 + 5 % 4) * NX * 4


@pytest.mark.parametrize("name,axes", [("c.npy", "tyx"), ("last.npy", "yxt"), ("columns.npy", "tyx")])
@pytest.mark.parametrize("t,y,x", [((3, 4), (None, None), (None, None)), ((66, None), (None, 3), (2, 7)), ((None, 2), (11, 99), (8, 9)), ((5, 5), (0, 1), (0, 1)), ((80, 90), (None, None), (None, None)), ((0, 70), (0, 12), (9, 12))])
def test_rows_are_those_of_a_whole_scan(spark, folder, name, axes, t, y, x):
    got = tables.scan_stack(spark, {"c": f"{folder}/{name}"}, case_id="a", axes=axes, t=t, y=y, x=x)
    values = np.load(folder / name)
    if axes == "yxt":
        values = np.moveaxis(values, -1, 0)
    within = [[i for i in range(n) if (a or 0) <= i < (n if b is None else b)] for n, (a, b) in zip(values.shape, (t, y, x))]
    want = [("a", i, j, k, None if np.isnan(values[i, j, k]) else float(values[i, j, k])) for i in within[0] for j in within[1] for k in within[2]]
    assert sorted(map(tuple, got.collect())) == want


def test_several_filters_of_one_scan_do_not_meet(spark, folder):
    """What a reader would keep of one filter must not reach another use of the same DataFrame."""
    scan = tables.scan_stack(spark, {"c": f"{folder}/c.npy"}, case_id="a")
    one, two = scan.filter("t = 3 and y = 4"), scan.filter("t = 60")
    assert (one.count(), two.count(), scan.count(), one.count()) == (NX, NY * NX, NT * NY * NX, NX)
    assert one.unionByName(two).count() == NX + NY * NX
    assert one.alias("p").join(two.alias("q"), ["y", "x"]).count() == NX
