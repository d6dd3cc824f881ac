"""Array archives written by tasks and committed together."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyfield.sources import array_sink, tables

FRAMES = "case_id string, t int, component string, ny int, nx int, data array<float>"


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="run-", dir="/tmp")) / "frames"


def frames_of(spark, times, case="a", fail_at=None, shift=0.0):
    rows = []
    for t in times:
        size = (2 + t % 3, 3)
        data = (np.arange(size[0] * 3) + 100 * t + shift).tolist()
        data[0] = None
        rows.append((case, t, "u", *size, data[: 1 if t == fail_at else None]))
    return spark.createDataFrame(rows, FRAMES)


def files(folder):
    return sorted(str(Path(d, f).relative_to(folder)) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def test_round_trip_in_several_commits(spark, folder):
    one, two = frames_of(spark, range(40)).repartition(5), frames_of(spark, range(40, 50), "b")
    tables.sink_frames(one, str(folder), frames_per_file=7)
    tables.sink_frames(two, str(folder))
    back = tables.scan_frames(spark, str(folder))
    assert sorted(back.collect(), key=str) == sorted(one.union(two).collect(), key=str)
    entries = array_sink.index_of(str(folder))
    assert max(len(e["frames"]) for e in entries) <= 16 and len(files(folder)) == len(entries) + 2
    assert [r["t"] for r in back.filter("case_id = 'a' and t in (3, 44)").collect()] == [3]
    assert tables.scan_frames(spark, str(folder), cases=["b"], t=(41, 43)).count() == 2
    reader = array_sink.ArraySinkReader({"path": str(folder), "t_span": "41:42"})
    assert [p.members for p in reader.partitions()] == [((41, "arr_41"),)]


def test_a_failed_write_leaves_nothing(spark, folder):
    tables.sink_frames(frames_of(spark, range(6)), str(folder))
    before = files(folder)
    with pytest.raises(Exception, match="not 4 x 3 values|comes twice|values"):
        tables.sink_frames(frames_of(spark, range(10, 40), fail_at=38).repartitionByRange(6, "t"), str(folder), frames_per_file=2)
    assert files(folder) == before and not list(Path(folder).glob("_job-*"))
    assert tables.scan_frames(spark, str(folder)).count() == 6


def test_a_lost_attempt_is_not_listed(spark, folder):
    """An attempt writes its archives and dies; the next one takes its place."""
    writer = array_sink.ArraySinkWriter({"path": str(folder)}, False)
    batch = frames_of(spark, range(3)).toArrow().to_batches()
    writer.write(iter(batch))  # its message is lost
    second = writer.write(iter(batch))
    writer.commit([second, None])
    assert sorted(t for e in array_sink.index_of(str(folder)) for t in e["frames"]) == [0, 1, 2]
    assert len([f for f in files(folder) if f.endswith(".npz")]) == 1
    third = array_sink.ArraySinkWriter({"path": str(folder)}, False)
    third.abort([third.write(iter(frames_of(spark, [9]).toArrow().to_batches()))])
    assert len(files(folder)) == 2


def test_frames_that_are_there_and_overwriting(spark, folder):
    tables.sink_frames(frames_of(spark, range(5)), str(folder))
    with pytest.raises(Exception, match="is there already"):
        tables.sink_frames(frames_of(spark, range(4, 7)), str(folder))
    assert tables.scan_frames(spark, str(folder)).count() == 5
    tables.sink_frames(frames_of(spark, range(2), shift=0.5), str(folder), mode="overwrite")
    got = tables.scan_frames(spark, str(folder)).orderBy("t").collect()
    assert [r["t"] for r in got] == [0, 1] and got[0]["data"][1] == 1.5 and len(files(folder)) == 1 + len(array_sink.index_of(str(folder)))
    doubled = frames_of(spark, [8]).union(frames_of(spark, [8]))
    with pytest.raises(Exception, match="twice|there already"):
        tables.sink_frames(doubled.repartition(2, F.rand(1)), str(folder))
    assert tables.scan_frames(spark, str(folder)).count() == 2
