"""Tables of the engine.

``voxel(case_id, t_block, t, y, x, u, v, w, c)`` holds one row per pixel and frame; ``y`` is
the row and ``x`` the column of the sensor. The table is dense: a masked sample is a row with
NULL, not an absent row; ``densify`` makes a table so. ``t_block`` is a partition column so that
frame ranges prune.

``axis(case_id, dim, idx, mm)`` holds pixel coordinates, ``field(case_id, y, x, ...)`` holds
per-pixel results and ``profile(case_id, pos, value)`` holds results along one direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from eddyfield.session import settle, settle_buckets

PIXEL = ["case_id", "y", "x"]
VOXEL = ["case_id", "t", "y", "x"]
COMPONENTS = ["u", "v", "w"]

# Defaults of the analyses.
KINEMATIC_VISCOSITY = 1.5e-5  # air, m^2/s
FREE_STREAM = 0.30  # m/s
W_FLOOR = -1.0  # w' below this is an outlier, m/s
ENVELOPE_CUTOFF = 0.10  # intermittency from here on is inside the plume
C_MIN = 0.001  # smallest concentration of the motion correlator
GRADIENT_PITCH = 0.5  # mm between pixels of the gradient maps
FRAME_TIME = 0.05  # s between frames
BLEND = 0.015  # m over which velocity passes into its linear extension
TARGET_GRID = (540, 640)  # columns, rows of the shared grid
PROFILE_SKIP = 30  # points left out at the end of a smoothed profile
LATERAL_REACH = 2  # rows on either side of a lateral profile
COLLAPSE_POINTS, COLLAPSE_REACH = 200, 3.0  # grid of the collapsed Gaussians, in sigma

FRAMES_PER_BLOCK = 32
ROWS_PER_FILE = 64


def block_of(t: Column) -> Column:
    return F.floor(t / F.lit(FRAMES_PER_BLOCK)).cast("int")


def densify(voxel: DataFrame, rows: int, columns: int) -> DataFrame:
    """Every frame with all its pixels: absent rows of the grid are added with NULL.

    Only the frames (case_id, t) are listed and exploded to their pixels; a sample outside the
    grid is an error.
    """
    outside = (F.col("y") < 0) | (F.col("y") >= rows) | (F.col("x") < 0) | (F.col("x") >= columns)
    inside = F.assert_true(~outside, F.lit(f"a sample lies outside the grid of {rows} by {columns}"))
    pixels = (
        voxel.select("case_id", "t")
        .distinct()
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    )
    checked = voxel.filter(inside.isNull())
    return pixels.join(checked, VOXEL, "left").select(*voxel.columns)


def read_fields(spark: SparkSession, path: str, *, schema: str | None = None) -> DataFrame:
    """A stored table whose case names are text, as they were written: ``01`` is not the number 1."""
    plain = spark.read.parquet(path).schema if schema is None else schema
    if schema is None:
        plain = StructType([StructField(f.name, StringType() if f.name == "case_id" else f.dataType) for f in plain])
    return spark.read.schema(plain).parquet(path)


def read_voxel(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_voxel`` stored. Its frame blocks must have the length that pruning assumes."""
    voxel = read_fields(spark, path)
    odd = voxel.groupBy("t_block").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    low = F.col("t_block") * FRAMES_PER_BLOCK
    if not odd.filter((F.col("low") < low) | (F.col("high") >= low + FRAMES_PER_BLOCK)).isEmpty():
        raise ValueError(f"{path} is not stored in blocks of {FRAMES_PER_BLOCK} frames")
    return voxel


def write_voxel(voxel: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a voxel table for frame-wise reading.

    A file holds one band of rows of one block of frames (tens of MB at sensor size),
    sorted so that row-group statistics prune row and column ranges.
    """
    band = F.floor(F.col("y") / F.lit(ROWS_PER_FILE))
    (
        voxel.withColumn("t_block", block_of(F.col("t")))
        .withColumn("_band", band)
        .repartition("case_id", "t_block", "_band")
        .drop("_band")
        .sortWithinPartitions("case_id", "t_block", "y", "x", "t")
        .write.mode(mode)
        .partitionBy("case_id", "t_block")
        .parquet(path)
    )


def by_pixel(voxel: DataFrame) -> DataFrame:
    """The voxels stored a second time, bucketed by pixel. Statistics over time and joins with a
    mean field then need no shuffle of the voxels; keep the frame layout for neighbours."""
    return settle_buckets(voxel, "voxel", PIXEL)


def extent(df: DataFrame) -> DataFrame:
    """Size of the grid of every case: one row per case."""
    return settle(
        df.groupBy("case_id").agg(
            (F.max("t") + 1).alias("nt"), (F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx")
        ),
        "extent",
    )


def shape_of(field: DataFrame) -> DataFrame:
    """Rows and columns of a field of every case: one row per case."""
    return settle(
        field.groupBy("case_id").agg((F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx")), "shape"
    )


def per_case(df: DataFrame, *statistics: Column) -> DataFrame:
    """Statistics of every case as a settled table, so that joining them back is planned by
    their real size: a broadcast, unless there are very many cases."""
    return settle(df.groupBy("case_id").agg(*statistics), "per_case")
