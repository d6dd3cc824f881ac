"""Versions under concurrent writers, merged statistics, streams."""

from __future__ import annotations

import tempfile
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyfield.model import PIXEL
from eddyfield.operators import incremental, sketch
from eddyfield.sources import versions
from eddyfield.streaming import pixel_stats


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/table"


def at_once(n, work):
    """Run ``work(i)`` in n threads; results in order."""
    out, failed = [None] * n, []
    gate = threading.Barrier(n)

    def run(i):
        gate.wait()
        try:
            out[i] = work(i)
        except Exception as error:  # reported below
            failed.append(error)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed, failed
    return out


def test_concurrent_writers_get_versions_of_their_own(spark, root):
    numbers = at_once(4, lambda i: versions.append_version(spark.range(10).withColumn("writer", F.lit(i)), root))
    assert sorted(numbers) == [0, 1, 2, 3]
    for writer, number in enumerate(numbers):
        rows = versions.read_version(spark, root, number).collect()
        assert len(rows) == 10 and {r["writer"] for r in rows} == {writer}


def test_no_update_is_lost(spark, root):
    versions.append_version(spark.createDataFrame([(0,)], "n int"), root)
    at_once(4, lambda i: versions.update_version(spark, root, lambda before: before.union(spark.createDataFrame([(i + 1,)], "n int"))))
    assert sorted(r["n"] for r in versions.read_version(spark, root).collect()) == [0, 1, 2, 3, 4]
    assert versions.taken(spark, root) == 4


def test_one_of_several_writers_writes_once(spark, root):
    wrote = at_once(3, lambda i: versions.write_once(spark.range(i, i + 1), root))
    assert sum(wrote) == 1
    assert versions.read_version(spark, root).first()["id"] == wrote.index(True)
    assert versions.write_once(spark.range(9), root) is False


def test_markers_without_a_version_are_passed_over(spark, root):
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, root)
    versions.append_version(spark.range(1), root)
    assert versions.claim(spark, root, 1, "")  # a writer that died
    assert not versions.claim(spark, root, 1, "late")
    assert versions.newest(spark, root)[0] == 0 and versions.read_version(spark, root).count() == 1
    assert versions.update_version(spark, root, lambda before: before.union(before)) == 2
    assert versions.read_version(spark, root).count() == 2 and versions.read_version(spark, root, 1).count() == 1
    assert versions.update_version(spark, root, lambda before: None) == 2


def cubes(rng, nt):
    c = rng.normal(1e4, 0.5, (nt, 3, 4))
    c[rng.random(c.shape) < 0.2] = np.nan
    c[:, 2, 3] = np.nan
    return c


@pytest.mark.parametrize("cuts", [[1, 2], [7], [3, 3, 9]])
def test_merged_equals_a_full_scan(spark, cube, field, cuts):
    c = cubes(np.random.default_rng(len(cuts)), 12)
    table = cube(c=c)
    edges = [0, *cuts, 12]
    parts = [incremental.accumulate(table.filter((F.col("t") >= a) & (F.col("t") < b)), "c", above={"c": 1e4}) for a, b in zip(edges, edges[1:])]
    out = incremental.finished(incremental.merged(parts))
    with np.errstate(all="ignore"):
        n = np.isfinite(c).sum(axis=0)
        mean, var = np.nanmean(c, axis=0), np.nanvar(c, axis=0)
        share = np.where(n > 0, (c > 1e4).sum(axis=0) / n, 0)
    assert np.allclose(field(out, "c_mean"), mean, rtol=1e-13, equal_nan=True)
    assert np.allclose(field(out, "c_var"), var, rtol=1e-9, equal_nan=True)  # at a mean of 20,000 deviations
    assert np.array_equal(field(out, "c_intermittency"), share) and np.array_equal(field(out, "c_n"), n)
    assert {r["frames"] for r in out.collect()} == {12}


def test_update_reads_new_frames_only(spark, cube, root):
    c = cubes(np.random.default_rng(5), 9)
    table = cube(c=c).unionByName(cube(case="b", c=c[:4]))
    assert incremental.update(spark, root, table.filter("t < 4 and case_id = 'a'"), "c") == 0
    # frames that are in are wrong this time: they must not be read again
    again = table.withColumn("c", F.when((F.col("t") < 4) & (F.col("case_id") == "a"), -1e9).otherwise(F.col("c")))
    assert incremental.update(spark, root, again, "c") == 1
    assert incremental.update(spark, root, table, "c") == 1
    got = versions.read_version(spark, root)
    want = incremental.accumulate(table, "c")
    assert {(r["case_id"], r["first_t"], r["last_t"]) for r in got.collect()} == {("a", 0, 8), ("b", 0, 3)}
    both = got.join(want.select(*PIXEL, F.col("c_mean").alias("m"), F.col("c_n").alias("k")), PIXEL)
    assert both.count() == 24 and both.filter("c_n <> k or abs(c_mean - m) > 1e-8").count() == 0


def test_stream_goes_on_after_a_restart_and_a_repeated_batch(spark, cube, root):
    c = cubes(np.random.default_rng(6), 10)
    table = cube(c=c)
    folder, checkpoint = f"{root}-in", f"{root}-state"

    def run():
        stream = pixel_stats.arriving(spark, folder, table.schema, files_at_once=1)
        pixel_stats.stream_pixel_stats(stream, root, checkpoint, "c", above={"c": 1e4}).awaitTermination()

    table.filter("t < 6").repartition(2, "t").write.parquet(folder)
    run()
    before = versions.taken(spark, root)
    assert before >= 1  # a version per batch
    run()
    assert versions.taken(spark, root) == before  # nothing new
    table.filter("t >= 6 and y < 2").coalesce(1).write.mode("append").parquet(folder)
    run()
    part = pixel_stats.pixel_stats(table.filter("t < 6 or y < 2"), "c", above={"c": 1e4})
    got = pixel_stats.results(spark, root)
    close = [F.abs(F.coalesce(got[k], F.lit(0.0)) - F.coalesce(part[k], F.lit(0.0))) < 1e-7 for k in ("c_mean", "c_var", "c_intermittency")]
    same = got.join(part, [got[k] == part[k] for k in (*PIXEL, "c_n", "frames")]).filter(close[0] & close[1] & close[2])
    assert got.count() == 12 and same.count() == 12
    # the last batch again, as after a failure between the table and the checkpoint
    last = versions.read_version(spark, root).agg(F.max("batch")).first()[0]
    number = versions.taken(spark, root)
    pixel_stats._replaced(root)(part.withColumn("frames", F.lit(-1).cast("long")), last)
    assert versions.taken(spark, root) == number


def test_sketches_of_parts_answer_for_the_whole(spark):
    n = 40_000
    rows = spark.range(n).select((F.col("id") % 8).alias("part"), F.lit("g").alias("g"), F.when(F.col("id") % 10 > 0, F.pow(F.rand(3), 3) * 50).alias("c"))
    rows = rows.unionByName(spark.createDataFrame([(0, "g", float("nan")), (0, "none", None)], "part long, g string, c double")).persist()
    stored = sketch.sketches(rows, ["g", "part"], "c")
    assert stored.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    whole = sketch.merged(stored, ["g"])
    assert {r["g"]: r["n"] for r in whole.collect()} == {"g": 36_000, "none": 0}
    got = sketch.quantiles(whole, ["g"], [1, 10, 50, 99.9])
    assert got.filter("g = 'none' and estimate is null").count() == 4
    values = np.sort([r["c"] for r in rows.filter("c is not null and not isnan(c)").collect()])
    for r in got.filter("g = 'g'").collect():
        assert abs(np.searchsorted(values, r["estimate"]) / len(values) - r["percent"] / 100) <= sketch.rank_error()
    assert {r["good"] for r in sketch.within(rows, got, ["g"]).collect()} == {True}
    wrong = got.withColumn("estimate", F.col("estimate") * 1.5)
    assert {r["good"] for r in sketch.within(rows, wrong, ["g"]).filter("percent = 50").collect()} == {False}
