"""Scalar column functions that Spark lacks or that need a fixed order of operations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published Lanczos coefficients for g = 7, n = 9.
LANCZOS_G = 7.0
LANCZOS = [
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
]


def lgamma(k: Column) -> Column:
    """ln Gamma(k) for k > 0 (shifted by one step so that small k keeps its accuracy)."""
    series = F.lit(LANCZOS[0])
    for i, coefficient in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(coefficient) / (k + F.lit(float(i)))
    base = k + F.lit(LANCZOS_G + 0.5)
    # the series approximates Gamma(k + 1) = k Gamma(k)
    return (
        F.lit(0.5 * math.log(2.0 * math.pi))
        + (k + F.lit(0.5)) * F.log(base)
        - base
        + F.log(series)
        - F.log(k)
    )


def speed(u: Column, v: Column, w: Column | None = None) -> Column:
    """Magnitude of a velocity vector of two or three components."""
    u, v = u.cast("double"), v.cast("double")
    total = u * u + v * v
    if w is not None:
        total = total + w.cast("double") * w
    return F.sqrt(total)


def case_from_path(path: Column, prefix: str, suffix: str) -> Column:
    """Case name out of a file name ``<prefix>_<case><suffix>``; NULL when it has another form."""
    name = F.regexp_extract(path, rf"(?:^|/){prefix}_(.+?){suffix}", 1)
    return F.when(name != "", name)


def frame_number(key: Column) -> Column:
    """Number of a frame key ``arr_<n>``; NULL for other keys."""
    digits = F.regexp_extract(key, "^arr_([0-9]+)$", 1)
    return F.when(digits != "", digits.cast("bigint"))
