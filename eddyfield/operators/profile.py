"""Profiles along one direction. A profile is at most as long as the sensor is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eddyfield.model import LATERAL_REACH, PIXEL, PROFILE_SKIP
from eddyfield.operators.align import nearest_coord


def row_profile(field: DataFrame, value: str, k: int = 1) -> DataFrame:
    """Mean over the columns of every row; with ``k`` > 1 the mean of k row means, centred on
    the k rows; rows beyond the last whole group are dropped."""
    rows = field.groupBy("case_id", F.col("y").alias("pos")).agg(F.avg(value).alias("value"))
    if k == 1:
        return rows.select("case_id", F.col("pos").cast("double").alias("pos"), "value")
    group = F.floor(F.col("pos") / k).cast("int").alias("group")
    return (
        rows.groupBy("case_id", group)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
        .filter(F.col("n") == k)
        .select("case_id", (F.col("group") * k + F.lit((k - 1) / 2.0)).alias("pos"), "value")
    )


def moving_average(profile: DataFrame, k: int) -> DataFrame:
    """k-point mean with the end values repeated outwards: ``profile(case_id, pos, value)``,
    positions 0..n-1. A missing value makes every mean that holds it missing. For an even k the
    padding is one point longer than the window needs, so the result has n + 1 points."""
    if k <= 1:
        return profile
    pad = k // 2
    line = Window.partitionBy("case_id")
    first, last = F.min("pos").over(line), F.max("pos").over(line)
    padded = (
        profile.withColumn("_first", first)
        .withColumn("_last", last)
        .withColumn("_lo", F.when(F.col("pos") == F.col("_first"), F.col("pos") - pad).otherwise(F.col("pos")))
        .withColumn("_hi", F.when(F.col("pos") == F.col("_last"), F.col("pos") + pad).otherwise(F.col("pos")))
        .withColumn("_at", F.explode(F.sequence(F.col("_lo").cast("int"), F.col("_hi").cast("int"))))
    )
    window = Window.partitionBy("case_id").orderBy("_at").rowsBetween(0, k - 1)
    total = F.when(F.count("value").over(window) == k, F.sum("value").over(window) / F.lit(float(k)))
    return (
        padded.withColumn("_n", F.count(F.lit(1)).over(window))
        .withColumn("_mean", total)
        .filter(F.col("_n") == k)
        .select("case_id", (F.col("_at") + pad).cast("int").alias("pos"), F.col("_mean").alias("value"))
    )


def row_smooth_profile(field: DataFrame, value: str, k: int, skip: int = PROFILE_SKIP, flip: bool = True) -> DataFrame:
    """Smoothed row profile without its first ``skip`` points, counted from the far end."""
    rows = row_profile(field, value).withColumn("pos", F.col("pos").cast("int"))
    smooth = moving_average(rows, k)
    end = F.max("pos").over(Window.partitionBy("case_id"))
    shown = (end - F.col("pos")) if flip else F.col("pos")
    return smooth.withColumn("shown", shown).filter(F.col("pos") >= skip).select("case_id", "pos", "shown", "value")


def even_sample(profile: DataFrame, m: int) -> DataFrame:
    """The points at floor(i (n - 1) / (m - 1)), i = 0..m-1, of every profile, in order of
    ``pos``; each point at most once. The last is the end of the profile; m = 1 takes its start."""
    if m < 1:
        raise ValueError("at least one point must be asked for")
    line = Window.partitionBy("case_id")
    numbered = profile.withColumn("_at", F.row_number().over(line.orderBy("pos")) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(line)
    )
    # whole numbers: a product of a quotient may fall below the end
    wanted = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / max(1, m - 1)).cast("int"))
    return numbered.filter(F.array_contains(wanted, F.col("_at"))).drop("_at", "_n")


def lateral_profile(
    field: DataFrame,
    axis: DataFrame,
    targets: DataFrame,
    value: str,
    reach: int = LATERAL_REACH,
    x_mm: tuple[float, float] | None = None,
) -> DataFrame:
    """Mean of the rows within ``reach`` of the row nearest to each target, per column.

    ``targets(case_id, target)`` in the coordinate of the rows. Returns ``(case_id, target,
    nearest_mm, x, x_mm, value)``, present values only, cropped to ``x_mm``.
    """
    rows = nearest_coord(
        axis.filter(F.col("dim") == "y"), targets.select("case_id", F.lit("y").alias("dim"), "target")
    ).select(
        "case_id",
        "target",
        F.col("mm").alias("nearest_mm"),
        F.explode(F.sequence(F.col("idx") - reach, F.col("idx") + reach)).alias("y"),
    )
    columns = axis.filter(F.col("dim") == "x").select("case_id", F.col("idx").alias("x"), F.col("mm").alias("x_mm"))
    if x_mm is not None:
        columns = columns.filter(F.col("x_mm").between(*sorted(x_mm)))
    return (
        field.select(*PIXEL, value)
        .join(rows, ["case_id", "y"])
        .groupBy("case_id", "target", "nearest_mm", "x")
        .agg(F.avg(value).alias("value"))
        .filter(F.col("value").isNotNull())
        .join(columns, ["case_id", "x"])
        .select("case_id", "target", "nearest_mm", "x", "x_mm", "value")
    )


def sort_points(points: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The points of every group as one array sorted by ``at``: a few per group."""
    return points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(at, value))).alias("points"))

