"""Fluxes of the scalar, and averages conditioned on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyfield.functions.missing import strict
from eddyfield.model import COMPONENTS, PIXEL, W_FLOOR


def turbulent_flux(
    voxel: DataFrame, t: tuple[int, int] | None = None, w_floor: float = W_FLOOR
) -> DataFrame:
    """<u'c'>, <v'c'>, <w'c'> over the frames ``t``; missing where any sample is missing.

    The means are those over *all* frames, even when the average is over a slice:
    E[(a - ma)(c - mc)] = cov(a, c) + (E[a] - ma)(E[c] - mc), all from one scan.
    """
    return voxel.groupBy(*PIXEL).agg(*flux_terms(t)).select(*PIXEL, *flux_columns(w_floor))


def flux_terms(t: tuple[int, int] | None = None) -> list[Column]:
    """Aggregates for ``flux_columns``."""
    used = F.lit(True) if t is None else (F.col("t") >= t[0]) & (F.col("t") < t[1])
    n_used = F.count_if(used)
    aggregates = [F.avg("c").alias("all_c"), F.avg(F.when(used, F.col("c"))).alias("used_c")]
    for k in COMPONENTS:
        a, c = F.when(used, F.col(k)), F.when(used, F.col("c"))
        aggregates += [
            F.avg(k).alias(f"all_{k}"),
            F.avg(a).alias(f"used_{k}"),
            (F.count_if(a.isNotNull() & c.isNotNull()) == n_used).alias(f"ok_{k}c"),
            F.covar_pop(a, c).alias(f"cov_{k}c"),
        ]
    return [*aggregates, F.min(F.when(used, F.col("w"))).alias("used_min_w")]


def flux_columns(w_floor: float = W_FLOOR) -> list[Column]:
    kept_w = F.col("used_min_w") - F.col("all_w") >= w_floor
    return [
        F.when(
            F.col(f"ok_{k}c") & (kept_w if k == "w" else F.lit(True)),
            F.col(f"cov_{k}c") + (F.col(f"used_{k}") - F.col(f"all_{k}")) * (F.col("used_c") - F.col("all_c")),
        ).alias(f"{k}c")
        for k in COMPONENTS
    ]


def advective_flux(voxel: DataFrame, mean: DataFrame | None = None) -> DataFrame:
    """Mean velocity times mean concentration; the concentration mean is strict."""
    c_mean = strict(F.avg("c"), F.col("c")).alias("_c")
    if mean is None:
        both = voxel.groupBy(*PIXEL).agg(c_mean, *[F.avg(k).alias(k) for k in COMPONENTS])
    else:
        both = voxel.groupBy(*PIXEL).agg(c_mean).join(mean.select(*PIXEL, *COMPONENTS), PIXEL)
    return both.select(*PIXEL, *[(F.col(k) * F.col("_c")).alias(f"{k}c") for k in COMPONENTS])


def total_flux(voxel: DataFrame) -> DataFrame:
    """Mean of u c and v c over the samples where both are present."""
    return voxel.groupBy(*PIXEL).agg(
        *[F.avg(F.col(k).cast("double") * F.col("c")).alias(f"{k}c") for k in ("u", "v")]
    )


def block_coarsen(voxel: DataFrame, k: int, *values: str) -> DataFrame:
    """Mean of the values present in k x k blocks of every frame; rows and columns beyond the
    last whole block are dropped. A block is whole when it has k^2 cells (the table is dense)."""
    return (
        voxel.groupBy(
            "case_id", "t", F.floor(F.col("y") / k).cast("int").alias("y"), F.floor(F.col("x") / k).cast("int").alias("x")
        )
        .agg(F.count(F.lit(1)).alias("_cells"), *[F.avg(v).alias(v) for v in values])
        .filter(F.col("_cells") == k * k)
        .drop("_cells")
    )


def conditional_velocity(voxel: DataFrame, k: int, threshold: float) -> DataFrame:
    """Block velocity summed over the frames where the block holds scalar at or above the
    threshold, divided by the number of *all* frames."""
    blocks = block_coarsen(voxel, k, "c", "u", "v")
    n = F.count(F.lit(1)).cast("double")

    def conditioned(component: str):
        return F.coalesce(F.sum(F.when(F.col("c") >= threshold, F.col(component))), F.lit(0.0)) / n

    return blocks.groupBy(*PIXEL).agg(conditioned("u").alias("u_cond"), conditioned("v").alias("v_cond"))

