"""Statistics of every pixel while frames arrive as files.

A file stream of voxels is aggregated by pixel, in update mode: the state is as large as the sensor, whatever the length of
the recording, and lives in the checkpoint. Every batch gives the pixels that changed, which replace those of the
table of results as a new version of it. The version remembers its batch, so that a batch that is repeated after
a failure leaves the table as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from eddyfield.model import PIXEL
from eddyfield.sources import versions


def arriving(spark: SparkSession, folder: str, schema: StructType | str, files_at_once: int | None = None) -> DataFrame:
    """Voxels of the Parquet files of a folder, those to come included."""
    reader = spark.readStream.schema(schema)
    if files_at_once is not None:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder)


def pixel_stats(voxel: DataFrame, *values: str, above: dict[str, float] | None = None) -> DataFrame:
    """Count, mean, population variance and share above a threshold of every pixel, of a stream or a table."""
    terms = []
    for v in values:
        terms += [F.count(v).alias(f"{v}_n"), F.avg(v).alias(f"{v}_mean"), F.var_pop(v).alias(f"{v}_var")]
        if above and v in above:
            share = F.coalesce(F.count_if(F.col(v) > above[v]) / F.nullif(F.count(v), F.lit(0)), F.lit(0.0))
            terms.append(share.alias(f"{v}_intermittency"))
    return voxel.groupBy(*PIXEL).agg(*terms, F.count(F.lit(1)).alias("frames"))


def _replaced(root: str):
    """Puts the pixels of a batch into the table of results."""

    def put(changed: DataFrame, batch: int) -> None:
        fresh = changed.withColumn("batch", F.lit(batch).cast("long")).persist()

        def change(stored: DataFrame | None) -> DataFrame | None:
            if stored is None:
                return fresh
            last = stored.agg(F.max("batch")).first()[0]
            if last is not None and last >= batch:
                return None  # it has been in: the batch is repeated after a failure
            return stored.join(fresh.select(*PIXEL), PIXEL, "left_anti").unionByName(fresh)

        versions.update_version(changed.sparkSession, root, change)
        fresh.unpersist()

    return put


def stream_pixel_stats(
    voxel: DataFrame, root: str, checkpoint: str, *values: str, above: dict[str, float] | None = None, available_now: bool = True
) -> StreamingQuery:
    """Start the statistics of a stream of voxels. ``root`` gets the results, ``checkpoint`` the state, from which a
    later call goes on. ``available_now``: stop when all files that are there have been read."""
    writer = pixel_stats(voxel, *values, above=above).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(_replaced(root)).start()


def results(spark: SparkSession, root: str) -> DataFrame:
    """The newest results."""
    return versions.read_version(spark, root).drop("batch")
