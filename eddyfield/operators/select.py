"""Crops, masks, coordinates and rescaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyfield.functions.missing import floor_at
from eddyfield.functions.scalar import speed
from eddyfield.model import FRAMES_PER_BLOCK, PIXEL, TARGET_GRID, per_case
from eddyfield.session import settle

Range = tuple[int, int]
TINY = 1e-12


def _check_range(name: str, bounds: Range) -> None:
    if bounds[0] < 0 or bounds[1] <= bounds[0]:
        raise ValueError(f"{name} range {bounds} selects nothing")


def frames(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Frames start <= t < stop; also prunes the frame blocks on disk."""
    _check_range("t", (start, stop))
    if "t_block" in df.columns:
        df = df.filter(F.col("t_block").between(start // FRAMES_PER_BLOCK, (stop - 1) // FRAMES_PER_BLOCK))
    return df.filter((F.col("t") >= start) & (F.col("t") < stop))


def roi_index(df: DataFrame, *, t: Range | None = None, y: Range | None = None, x: Range | None = None) -> DataFrame:
    """Half-open index ranges. A range that selects nothing is an error."""
    if t is not None:
        df = frames(df, *t)
    for name, bounds in (("y", y), ("x", x)):
        if bounds is not None:
            _check_range(name, bounds)
            df = df.filter((F.col(name) >= bounds[0]) & (F.col(name) < bounds[1]))
    return df


def frame_pick(df: DataFrame, t: int, n_frames: int | None = None) -> DataFrame:
    """One frame of every case."""
    if t < 0 or (n_frames is not None and t >= n_frames):
        raise IndexError(f"frame {t} is out of range")
    return frames(df, t, t + 1)


def pixel_series(df: DataFrame, y: int, x: int, value: str = "c", t: Range | None = None) -> DataFrame:
    """Values of one pixel over time, in order."""
    df = df if t is None else frames(df, *t)
    return df.filter((F.col("y") == y) & (F.col("x") == x)).select("case_id", "t", value).orderBy("case_id", "t")


def axis_of(axis: DataFrame, dim: str) -> DataFrame:
    """The axis table of one direction as (case_id, <dim>, <dim>_mm)."""
    return axis.filter(F.col("dim") == dim).select(
        "case_id", F.col("idx").alias(dim), F.col("mm").alias(f"{dim}_mm")
    )


def roi_coords(
    df: DataFrame,
    axis: DataFrame,
    x_mm: tuple[float, float] | None = None,
    y_mm: tuple[float, float] | None = None,
) -> DataFrame:
    """Crop to inclusive coordinate bounds, given in either order; adds the coordinates.

    ``axis`` is a stored table, so its size is known: Spark broadcasts it when it is small. The
    lowest and highest index inside the bounds are taken from it first and filter the scan.
    """
    for dim, bounds in (("x", x_mm), ("y", y_mm)):
        points = axis_of(axis, dim)
        if bounds is not None:
            low, high = sorted(bounds)
            points = points.filter(F.col(f"{dim}_mm").between(low, high))
            ends = points.agg(F.min(dim).alias("first"), F.max(dim).alias("last")).first()
            if ends["first"] is None:
                raise ValueError(f"no {dim} points within {bounds}")
            df = df.filter(F.col(dim).between(ends["first"], ends["last"]))
        df = df.join(points, ["case_id", dim])
    return df


def roi_bands(
    df: DataFrame,
    axis: DataFrame,
    x_bands: list[tuple[float, float]],
    y_band: tuple[float, float],
) -> DataFrame:
    """Samples of several column bands over one row band, with the number of the band. A sample
    in two overlapping bands counts twice. The samples are read once."""
    hull = (min(min(b) for b in x_bands), max(max(b) for b in x_bands))
    placed = roi_coords(df, axis, x_mm=hull, y_mm=y_band)
    hits = [F.when(F.col("x_mm").between(*sorted(band)), F.lit(i)) for i, band in enumerate(x_bands)]
    return placed.withColumn("band", F.explode(F.array_compact(F.array(*hits))))


def mask_below(df: DataFrame, value: str, threshold: float, magnitude: bool = False) -> DataFrame:
    """Values (or absolute values) below the threshold become missing."""
    tested = F.abs(F.col(value)) if magnitude else F.col(value)
    return df.withColumn(value, F.when(tested >= threshold, F.col(value)))


def clamp_low(df: DataFrame, value: str, low: float | None = None) -> DataFrame:
    """Values below ``low`` become ``low``; by default the smallest value of the case."""
    if low is not None:
        return df.withColumn(value, floor_at(F.col(value), low))
    lows = per_case(df, F.min(value).alias("_low"))
    return df.join(lows, "case_id").withColumn(value, floor_at(F.col(value), F.col("_low"))).drop("_low")


def point_patch(field: DataFrame, patch: DataFrame, value: str) -> DataFrame:
    """Overwrite listed pixels: ``patch(case_id, y, x, new_value)``."""
    return (
        field.join(patch, PIXEL, "left")
        .withColumn(value, F.coalesce(F.col("new_value"), F.col(value)))
        .drop("new_value")
    )


def affine_coords(
    df: DataFrame,
    index: str,
    offset: Column | float,
    slope: Column | float,
    *,
    stride: int = 1,
    unit: float = 1.0,
    shift: float = 0.0,
    out: str = "mm",
) -> DataFrame:
    """Coordinate = (offset + slope * stride * index) * unit + shift."""
    offset = offset if isinstance(offset, Column) else F.lit(float(offset))
    slope = slope if isinstance(slope, Column) else F.lit(float(slope))
    mm = (offset + slope * F.lit(stride) * F.col(index)) * F.lit(unit) + F.lit(shift)
    return df.withColumn(out, mm)


def linspace_axis(axis: DataFrame, dim: str, n: int) -> DataFrame:
    """n evenly spaced points over [min(axis, 0), max(axis)], both ends included."""
    bounds = axis.filter(F.col("dim") == dim).groupBy("case_id").agg(
        F.least(F.min("mm"), F.lit(0.0)).alias("lo"), F.max("mm").alias("hi")
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(n - 1)
    return bounds.select("case_id", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx")).select(
        "case_id",
        F.lit(dim).alias("dim"),
        "idx",
        F.when(F.col("idx") == n - 1, F.col("hi")).otherwise(F.col("lo") + F.col("idx") * step).alias("mm"),
    )


def step_axis(axis: DataFrame, dim: str, step: float) -> DataFrame:
    """Points 0, step, 2 step, ... below the whole part of the size of the source axis, where
    the size is the number of source pixels times their pitch."""
    size = axis.filter(F.col("dim") == dim).groupBy("case_id").agg(
        ((F.max("mm") - F.min("mm")) / (F.count("*") - 1) * F.count("*")).alias("size")
    )
    last = F.ceil(F.floor("size") / F.lit(step)).cast("int") - 1
    return size.select("case_id", F.explode(F.sequence(F.lit(0), last)).alias("idx")).select(
        "case_id", F.lit(dim).alias("dim"), "idx", (F.col("idx") * F.lit(step)).alias("mm")
    )


def make_target_grid(axis: DataFrame, nx: int = TARGET_GRID[0], ny: int = TARGET_GRID[1]) -> DataFrame:
    """Evenly spaced mesh over the extent of the axes (the mesh itself is the result)."""
    return mesh(linspace_axis(axis, "x", nx).unionByName(linspace_axis(axis, "y", ny)))


def mesh(axis: DataFrame) -> DataFrame:
    """Every grid point of a pair of axes: ``grid(case_id, y, x, x_mm, y_mm)``."""
    return axis_of(axis, "y").join(axis_of(axis, "x"), "case_id").select("case_id", "y", "x", "x_mm", "y_mm")


def ascending(axis: DataFrame) -> DataFrame:
    """Renumber every axis in ascending order of its coordinate; adds ``old_idx``.

    In long form a descending axis needs no flip of the data, only a new number per point.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("case_id", "dim").orderBy("mm")
    return axis.withColumnRenamed("idx", "old_idx").withColumn("idx", F.row_number().over(order) - 1)


def direction(field: DataFrame, u: str, v: str, threshold: float) -> DataFrame:
    """Unit vector, missing where the vector is shorter than the threshold."""
    length = F.hypot(F.col(u), F.col(v))
    shown = length >= threshold
    safe = F.greatest(length, F.lit(TINY))
    return field.withColumn("u_dir", F.when(shown, F.col(u) / safe)).withColumn(
        "v_dir", F.when(shown, F.col(v) / safe)
    )


def sign_direction(field: DataFrame, component: str, threshold: float) -> DataFrame:
    """Sign of one component, missing where it is weaker than the threshold."""
    return field.withColumn(
        "sign", F.when(F.abs(F.col(component)) >= threshold, F.signum(F.col(component)))
    )


def log_scaled_vectors(
    field: DataFrame, u: str, v: str, *, threshold: float = 0.0, short: float = 0.5, long: float = 1.0
) -> DataFrame:
    """Arrows whose length grows with the logarithm of the magnitude, from short to long."""
    field = settle(field, "field")  # read twice below
    length = F.hypot(F.col(u), F.col(v))
    shown = field.withColumn("magnitude", F.when(length >= threshold, length)).withColumn(
        "log_magnitude", F.log10(floor_at(F.col("magnitude"), TINY))
    )
    limits = per_case(shown, F.min("log_magnitude").alias("_lo"), F.max("log_magnitude").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    same = F.abs(span) <= 1e-8 + 1e-5 * F.abs(F.col("_hi"))
    scaled = F.when(F.col("magnitude").isNull(), None).when(same, 1.0).otherwise(
        (F.col("log_magnitude") - F.col("_lo")) / span
    )
    arrow = F.lit(short) + F.lit(long - short) * scaled
    return (
        shown.join(limits, "case_id")
        .withColumn("u_arrow", F.try_divide(F.col(u), F.col("magnitude")) * arrow)
        .withColumn("v_arrow", F.try_divide(F.col(v), F.col("magnitude")) * arrow)
        .drop("_lo", "_hi", "magnitude")
    )


def decimate(df: DataFrame, every_y: int, every_x: int) -> DataFrame:
    """Every k-th row and column of a vector plot, complete vectors only."""
    return df.filter(
        (F.col("y") % every_y == 0) & (F.col("x") % every_x == 0) & F.col("u").isNotNull() & F.col("v").isNotNull()
    )


def fluctuation_snapshot(voxel: DataFrame, t: int) -> DataFrame:
    """w' and w'c' of one frame, with the means over all frames.

    One aggregation: the frame's own value rides along with the mean, so no join is needed.
    """
    at_t = F.col("t") == t
    pixel = voxel.groupBy(*PIXEL).agg(
        F.avg("w").alias("w_mean"),
        F.avg("c").alias("c_mean"),
        F.max(F.when(at_t, F.col("w"))).alias("w_t"),
        F.max(F.when(at_t, F.col("c"))).alias("c_t"),
    )
    return pixel.select(
        *PIXEL,
        (F.col("w_t") - F.col("w_mean")).alias("w_fluct"),
        (F.col("c_t") - F.col("c_mean")).alias("c_fluct"),
        ((F.col("w_t") - F.col("w_mean")) * (F.col("c_t") - F.col("c_mean"))).alias("wc_fluct"),
    )


def box_region(field: DataFrame, axis: DataFrame, fractions: tuple[float, float, float, float]) -> DataFrame:
    """Speed and a flag for the box given as (x_lo, x_hi, y_lo, y_hi) fractions of the extent."""
    x_lo, x_hi, y_lo, y_hi = fractions
    spans = settle(
        axis.groupBy("case_id").pivot("dim", ["x", "y"]).agg(F.min("mm").alias("lo"), F.max("mm").alias("hi")),
        "spans",
    )

    def inside(dim: str, low: float, high: float) -> Column:
        start, size = F.col(f"{dim}_lo"), F.col(f"{dim}_hi") - F.col(f"{dim}_lo")
        return (F.col(f"{dim}_mm") >= start + F.lit(low) * size) & (F.col(f"{dim}_mm") <= start + F.lit(high) * size)

    return (
        roi_coords(field, axis)
        .join(spans, "case_id")
        .withColumn("speed", speed(F.col("u"), F.col("v")))
        .withColumn("in_box", inside("x", x_lo, x_hi) & inside("y", y_lo, y_hi))
        .drop("x_lo", "x_hi", "y_lo", "y_hi")
    )


def normalise_max(voxel: DataFrame, value: str = "c") -> DataFrame:
    """Divide by the largest value of the case, then take off the mean over time."""
    from eddyfield.operators.align import join_mean

    pixels = settle(voxel.groupBy(*PIXEL).agg(F.avg(value).alias("_mean"), F.max(value).alias("_most")), "pixels")
    top = per_case(pixels, F.max("_most").alias("_top"))  # of the field, not of the voxels again
    means = pixels.drop("_most")
    return (
        join_mean(voxel, means)
        .join(top, "case_id")
        .withColumn(value, F.col(value) / F.col("_top") - F.col("_mean") / F.col("_top"))
        .drop("_top", "_mean")
    )


def minmax_profile(profile: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(v - min) / (max - min) within every profile, clipped to [0, 1]; a flat profile fails."""
    from pyspark.sql import Window

    line = Window.partitionBy(*keys)
    low, high = F.min(value).over(line), F.max(value).over(line)
    ranged = profile.withColumn("_lo", low).withColumn("_hi", high)
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(
        F.raise_error(F.lit("zero range: the profile cannot be normalised")).cast("double")
    )
    scaled = (F.col(value) - F.col("_lo")) / span
    clipped = F.when(scaled < 0, 0.0).when(scaled > 1, 1.0).otherwise(scaled)
    return ranged.withColumn(value, F.when(F.col(value).isNotNull(), clipped)).drop("_lo", "_hi")


def zscore_field(field: DataFrame, *values: str) -> DataFrame:
    """(f - mean) / std of every field; zero where the field is constant (std < 1e-12)."""
    field = settle(field, "field")  # read twice below
    stats = per_case(
        field,
        *[F.avg(v).alias(f"_m_{v}") for v in values],
        *[F.stddev_pop(v).alias(f"_s_{v}") for v in values],
    )
    out = field.join(stats, "case_id")
    for v in values:
        std = F.col(f"_s_{v}")
        out = out.withColumn(v, F.when(std < TINY, F.lit(0.0)).otherwise((F.col(v) - F.col(f"_m_{v}")) / std))
        out = out.drop(f"_m_{v}", f"_s_{v}")
    return out
