"""Energy, dissipation and scales of the velocity fluctuations.

A fluctuation is a value minus a mean field that does not depend on time, so every mean square
follows from statistics of the raw values: E[(a - m)^2] = var(a) + (E[a] - m)^2. The voxels are
scanned once and only per-pixel results meet the mean field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyfield.functions.missing import complete
from eddyfield.model import COMPONENTS, FREE_STREAM, KINEMATIC_VISCOSITY, PIXEL, W_FLOOR
from eddyfield.operators.stencil import Tile, gradients


def _about(var: Column, avg: Column, mean: Column) -> Column:
    return var + (avg - mean) * (avg - mean)


def mean_squares(voxel: DataFrame, mean: DataFrame | None = None, w_floor: float = W_FLOOR) -> DataFrame:
    """<u'^2>, <v'^2>, <w'^2>; missing where a sample is missing, and for w also where any w'
    lies below ``w_floor`` (such a sample counts as missing)."""
    moments = voxel.groupBy(*PIXEL).agg(*square_terms())
    if mean is None:
        return moments.select(*PIXEL, *square_columns(w_floor))
    moments = moments.join(mean.select(*PIXEL, *[F.col(k).alias(f"m_{k}") for k in COMPONENTS]), PIXEL)
    return moments.select(*PIXEL, *square_columns(w_floor, "m"))


def square_terms() -> list[Column]:
    """Aggregates for ``square_columns``."""
    return [
        *[complete(F.col(k)).alias(f"ok_{k}") for k in COMPONENTS],
        *[F.avg(k).alias(f"avg_{k}") for k in COMPONENTS],
        *[F.var_pop(k).alias(f"var_{k}") for k in COMPONENTS],
        F.min("w").alias("min_w"),
    ]


def square_columns(w_floor: float = W_FLOOR, mean: str = "avg") -> list[Column]:
    """Mean squares about the columns ``<mean>_u``, ``<mean>_v``, ``<mean>_w``."""
    kept_w = F.col("min_w") - F.col(f"{mean}_w") >= w_floor
    return [
        F.when(
            F.col(f"ok_{k}") & (kept_w if k == "w" else F.lit(True)),
            _about(F.col(f"var_{k}"), F.col(f"avg_{k}"), F.col(f"{mean}_{k}")),
        ).alias(f"{k}2")
        for k in COMPONENTS
    ]


def tke(squares: DataFrame) -> DataFrame:
    """Turbulent kinetic energy beside its three terms."""
    return squares.withColumn("tke", F.lit(0.5) * (F.col("u2") + F.col("v2") + F.col("w2")))


def _rms() -> Column:
    return F.sqrt(F.lit(1.0 / 3.0) * (F.col("u2") + F.col("v2") + F.col("w2")))


def energy_fields(squares: DataFrame, free_stream: float = FREE_STREAM) -> DataFrame:
    """Energy and intensity of one table of mean squares side by side."""
    return tke(squares).withColumn("intensity", _rms() / F.lit(free_stream))


def turbulence_intensity(squares: DataFrame, free_stream: float = FREE_STREAM) -> DataFrame:
    """RMS of the three components over the free-stream speed."""
    return squares.select(*PIXEL, (_rms() / F.lit(free_stream)).alias("intensity"))


def anisotropy(energy: DataFrame) -> DataFrame:
    """Field means of the share of each component in the energy, per case."""
    return energy.groupBy("case_id").agg(
        *[F.avg(F.try_divide(F.col(f"{k}2"), F.col("tke"))).alias(f"{k}_share") for k in COMPONENTS]
    )


def _slopes(voxel: DataFrame, dx: float, tile: Tile, *keep: str) -> DataFrame:
    slopes = gradients(voxel, {"du": ("u", "y", dx), "dv": ("v", "x", dx)}, tile=tile, keep=keep)
    return slopes.withColumn("dw", -F.col("du") - F.col("dv"))


def _epsilon(nu: float) -> Column:
    """The aggregate over the slopes of a pixel."""
    variances = F.var_pop("du") + F.var_pop("dv") + F.var_pop("dw")
    return F.when(complete(F.col("du"), F.col("dv")), F.lit(5.0 * nu) * variances).alias("epsilon")


def dissipation(
    voxel: DataFrame, dx: float, nu: float = KINEMATIC_VISCOSITY, mean: DataFrame | None = None, tile: Tile = Tile()
) -> DataFrame:
    """5 nu (<(du')^2> + <(dv')^2> + <(dw')^2>) with dw' = -du' - dv' from continuity.

    A slope is linear, so du' = du - d(mean u): again only variances of raw slopes are needed,
    plus the slope of the mean field when one is supplied.
    """
    slopes = _slopes(voxel, dx, tile)
    terms = ["du", "dv", "dw"]
    ok = complete(F.col("du"), F.col("dv"))
    if mean is None:
        return slopes.groupBy(*PIXEL).agg(_epsilon(nu))
    flat = gradients(mean, {"m_du": ("u", "y", dx), "m_dv": ("v", "x", dx)}, tile=tile)
    flat = flat.select(*PIXEL, "m_du", "m_dv", (-F.col("m_du") - F.col("m_dv")).alias("m_dw"))
    moments = slopes.groupBy(*PIXEL).agg(
        ok.alias("ok"),
        *[F.var_pop(k).alias(f"var_{k}") for k in terms],
        *[F.avg(k).alias(f"avg_{k}") for k in terms],
    )
    squares = [_about(F.col(f"var_{k}"), F.col(f"avg_{k}"), F.col(f"m_{k}")) for k in terms]
    return moments.join(flat, PIXEL).select(
        *PIXEL, F.when(F.col("ok"), F.lit(5.0 * nu) * (squares[0] + squares[1] + squares[2])).alias("epsilon")
    )


def turbulence_scales(squares: DataFrame, epsilon: DataFrame, nu: float = KINEMATIC_VISCOSITY) -> DataFrame:
    """Taylor length and Reynolds number, Kolmogorov length and time; missing where the
    dissipation is not positive."""
    return _scales(squares.join(epsilon, PIXEL), nu)


def scales_of(
    voxel: DataFrame, dx: float, nu: float = KINEMATIC_VISCOSITY, w_floor: float = W_FLOOR, tile: Tile = Tile()
) -> DataFrame:
    """The same scales from the voxels: mean squares and dissipation in one aggregate over one scan."""
    moments = _slopes(voxel, dx, tile, "w").groupBy(*PIXEL).agg(*square_terms(), _epsilon(nu))
    return _scales(moments.select(*PIXEL, *square_columns(w_floor), "epsilon"), nu)


def _scales(fields: DataFrame, nu: float) -> DataFrame:
    both = fields.withColumn("rms", _rms())
    eps = F.when(F.col("epsilon") > 0, F.col("epsilon"))
    taylor = F.sqrt(F.lit(15.0 * nu) / eps) * F.col("rms")
    return both.select(
        *PIXEL,
        taylor.alias("taylor_length"),
        F.pow(F.lit(nu**3) / eps, F.lit(0.25)).alias("kolmogorov_length"),
        F.sqrt(F.lit(nu) / eps).alias("kolmogorov_time"),
        (F.col("rms") * taylor / F.lit(nu)).alias("taylor_re"),
    )


def reynolds_stress(voxel: DataFrame) -> DataFrame:
    """<u'^2>, <v'^2>, <u'v'> and the ratio of the smaller to the larger normal stress."""
    u, v = F.col("u"), F.col("v")
    stress = voxel.groupBy(*PIXEL).agg(
        F.when(complete(u), F.var_pop("u")).alias("uu"),
        F.when(complete(v), F.var_pop("v")).alias("vv"),
        F.when(complete(u, v), F.covar_pop("u", "v")).alias("uv"),
    )
    ratio = F.try_divide(F.least("uu", "vv"), F.greatest("uu", "vv"))
    return stress.withColumn("ratio", F.when(F.col("uu").isNotNull() & F.col("vv").isNotNull(), ratio))
