"""Recordings that grow: merged statistics and streams over the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from eddyfield.model import VOXEL
from eddyfield.operators import incremental, sketch
from eddyfield.plans.fixture import voxel
from eddyfield.plans.registry import query, r, rounded
from eddyfield.session import new_path, settle
from eddyfield.sources import versions
from eddyfield.streaming import pixel_stats

INTERMITTENCY = "coalesce(count_if(c > 0.25)::DOUBLE / nullif(count(c), 0), 0)"


@query("incremental_stats", f"SELECT case_id, y, x, count(c) AS c_n, {r('avg(c)', 'c_mean')}, {r('var_pop(c)', 'c_var')}, {r('sqrt(avg(c * c))', 'c_rms')}, {r(INTERMITTENCY, 'c_intermittency')}, "
       f"count(u) AS u_n, {r('avg(u)', 'u_mean')}, {r('var_pop(u)', 'u_var')}, {r('sqrt(avg(u * u))', 'u_rms')}, count(*) AS frames FROM voxel GROUP BY ALL")
def incremental_stats(spark, sf_dir):
    """The recording comes in three overlapping runs; the last one twice. No frame is read a second time."""
    table, root = voxel(spark, sf_dir), new_path(spark, "pixels")
    for run in (F.col("t") < 1, F.col("t") < 4, F.lit(True), F.lit(True)):
        incremental.update(spark, root, table.filter(run), "c", "u", above={"c": 0.25})
    out = incremental.finished(versions.read_version(spark, root))
    return rounded(out, 6, *[n for n in out.columns if n.startswith(("c_", "u_")) and not n.endswith("_n")])


@query("stream_pixel_stats", f"SELECT case_id, y, x, count(c) AS c_n, {r('avg(c)', 'c_mean')}, {r('var_pop(c)', 'c_var')}, {r(INTERMITTENCY, 'c_intermittency')}, "
       f"count(u) AS u_n, {r('avg(u)', 'u_mean')}, {r('var_pop(u)', 'u_var')}, count(*) AS frames FROM voxel GROUP BY ALL")
def stream_pixel_stats(spark, sf_dir):
    """Frames arrive as files; the stream stops, more frames come, and it goes on from its checkpoint."""
    table, folder = voxel(spark, sf_dir).select(*VOXEL, "c", "u"), new_path(spark, "arriving")
    root, checkpoint = new_path(spark, "results"), new_path(spark, "stream")
    for run in (F.col("t") % 3 != 1, F.col("t") % 3 == 1):
        table.filter(run).write.mode("append").parquet(folder)
        stream = pixel_stats.arriving(spark, folder, table.schema)
        pixel_stats.stream_pixel_stats(stream, root, checkpoint, "c", "u", above={"c": 0.25}).awaitTermination()
    out = pixel_stats.results(spark, root)
    return rounded(out, 6, "c_mean", "c_var", "c_intermittency", "u_mean", "u_var")


@query("sketch_report", "SELECT case_id, value, percent, n, true AS good FROM (SELECT case_id, 'c' AS value, count(c) AS n FROM voxel GROUP BY case_id UNION ALL SELECT case_id, 'u', count(u) FROM voxel GROUP BY case_id), "
       "(SELECT unnest([0.1, 5.0, 25.0, 50.0, 90.0, 99.0]::DOUBLE[]) AS percent)")
def sketch_report(spark, sf_dir):
    """Sketches of blocks of frames, merged to cases; the exact ranks of their quantiles are within the bound."""
    table = voxel(spark, sf_dir)
    blocks = table.withColumn("block", F.floor(F.col("t") / 2))
    stored = settle(sketch.sketches(blocks, ["case_id", "block"], "c", "u"), "sketches")
    estimates = sketch.quantiles(sketch.merged(stored, ["case_id"]), ["case_id"], [0.1, 5, 25, 50, 90, 99])
    return sketch.within(table, settle(estimates, "estimates"), ["case_id"])
