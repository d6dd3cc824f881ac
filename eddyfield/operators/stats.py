"""Statistics over time at every pixel.

All are one ``groupBy(case_id, y, x)``. Spark combines the frames of an input file before the
shuffle, so what moves is one row per pixel and file, whatever the number of frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyfield.functions.missing import strict
from eddyfield.model import PIXEL


def temporal_mean(voxel: DataFrame, *values: str) -> DataFrame:
    """Mean of the samples that are present, and their number."""
    aggregates = [F.avg(v).alias(f"{v}_mean") for v in values] + [F.count(v).alias(f"{v}_count") for v in values]
    return voxel.groupBy(*PIXEL).agg(*aggregates)


def temporal_variance(voxel: DataFrame, *values: str) -> DataFrame:
    """Mean and population variance of the samples that are present."""
    aggregates = [F.avg(v).alias(f"{v}_mean") for v in values] + [F.var_pop(v).alias(f"{v}_var") for v in values]
    return voxel.groupBy(*PIXEL).agg(*aggregates)


def rms_raw(voxel: DataFrame, *values: str, strictly: bool = False) -> DataFrame:
    """sqrt(mean(v^2)); the mean is not removed."""
    squares = {v: F.avg(F.col(v).cast("double") * F.col(v)) for v in values}
    if strictly:
        squares = {v: strict(square, F.col(v)) for v, square in squares.items()}
    return voxel.groupBy(*PIXEL).agg(*[F.sqrt(square).alias(f"{v}_rms") for v, square in squares.items()])


def rms_fluct(voxel: DataFrame, mean: DataFrame | None = None, value: str = "c") -> DataFrame:
    """sqrt(mean((v - mean)^2)) about a supplied mean field, or about the own mean.

    E[(v - m)^2] = var(v) + (E[v] - m)^2, so the mean field joins the result, not the voxels.
    """
    if mean is None:
        return voxel.groupBy(*PIXEL).agg(F.stddev_pop(value).alias(f"{value}_rms"))
    own = voxel.groupBy(*PIXEL).agg(F.var_pop(value).alias("_var"), F.avg(value).alias("_avg"))
    shift = F.col("_avg") - F.col("_m")
    return own.join(mean.select(*PIXEL, F.col(value).alias("_m")), PIXEL).select(
        *PIXEL, F.sqrt(F.col("_var") + shift * shift).alias(f"{value}_rms")
    )


def intermittency(voxel: DataFrame, threshold: float, value: str = "c", percent: bool = False) -> DataFrame:
    """Share of the samples present that exceed the threshold; 0 where none is present."""
    return voxel.groupBy(*PIXEL).agg(intermittency_term(threshold, value, percent))


def intermittency_term(threshold: float, value: str = "c", percent: bool = False) -> Column:
    """The same as an aggregate, to go into one pass with others."""
    share = F.coalesce(F.try_divide(F.count_if(F.col(value) > threshold), F.count(value)), F.lit(0.0))
    return (share * 100.0 if percent else share).alias("intermittency")


def case_means(voxel: DataFrame, *values: str) -> DataFrame:
    """Domain mean of every component of every case, one row per case and component."""
    means = voxel.groupBy("case_id").agg(*[F.avg(v).alias(v) for v in values])
    return means.unpivot("case_id", list(values), "component", "mean")


def linear_flow_tensor(voxel: DataFrame) -> DataFrame:
    """Mean velocity and 2 x 2 linear-flow tensor of every frame, from moments.

    Expects coordinates ``x_mm`` and ``y_mm`` (any unit) beside u and v; complete frames only.
    """
    x, y, u, v = (F.col(k) for k in ("x_mm", "y_mm", "u", "v"))
    both = F.avg(x * x + y * y)
    tensor = {
        "u_mean": F.avg(u),
        "v_mean": F.avg(v),
        "g_xx": F.avg(x * u - y * v) / both,
        "g_xy": F.avg(y * u) / F.avg(y * y),
        "g_yx": F.avg(x * v) / F.avg(x * x),
        "g_yy": F.avg(y * v - x * u) / both,
    }
    return voxel.groupBy("case_id", "t").agg(*[strict(value, u, v).alias(k) for k, value in tensor.items()])
