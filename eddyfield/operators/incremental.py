"""Statistics over time that grow with the recording.

Per pixel and value an accumulator holds count, mean and sum of squared deviations, and counts above thresholds:
a table as large as the sensor. New frames are accumulated by themselves and merged pixel by pixel, by the exact
formula for two samples; frames that are in already are not read again. The table remembers which frames those are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyfield.model import PIXEL
from eddyfield.sources import versions


def accumulate(voxel: DataFrame, *values: str, above: dict[str, float] | None = None) -> DataFrame:
    """``(case_id, y, x, <v>_n, <v>_mean, <v>_m2, <v>_above, first_t, last_t, frames)`` of the frames given."""
    terms = []
    for v in values:
        n = F.count(v)
        terms += [n.alias(f"{v}_n"), F.avg(v).alias(f"{v}_mean"), (F.var_pop(v) * n).alias(f"{v}_m2")]
        if above and v in above:
            terms.append(F.count_if(F.col(v) > above[v]).alias(f"{v}_above"))
    span = [F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("frames")]
    return voxel.groupBy(*PIXEL).agg(*terms, *span)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Accumulators of two sets of frames as those of both. A pixel may be in one of them only."""
    left, right = a.withColumnsRenamed({c: f"{c}_a" for c in a.columns if c not in PIXEL}), b.withColumnsRenamed({c: f"{c}_b" for c in b.columns if c not in PIXEL})
    both = left.join(right, PIXEL, "full")
    out = {}
    for name in a.columns:
        one, two = F.col(f"{name}_a"), F.col(f"{name}_b")
        kind, value = name.rpartition("_")[2], name.rpartition("_")[0]
        na, nb = (F.coalesce(F.col(f"{value}_n_{s}"), F.lit(0)) for s in "ab") if kind in ("mean", "m2") else (None, None)
        if name in PIXEL:
            continue
        if name == "first_t":
            out[name] = F.least(one, two)
        elif name == "last_t":
            out[name] = F.greatest(one, two)
        elif kind == "mean":
            out[name] = F.when(na == 0, two).when(nb == 0, one).otherwise((na * one + nb * two) / (na + nb))
        elif kind == "m2":
            gap = F.col(f"{value}_mean_b") - F.col(f"{value}_mean_a")
            out[name] = F.when(na == 0, two).when(nb == 0, one).otherwise(one + two + gap * gap * (na * nb) / (na + nb))
        else:
            out[name] = F.coalesce(one, F.lit(0)) + F.coalesce(two, F.lit(0))
    return both.select(*PIXEL, *[c.alias(n) for n, c in out.items()])


def finished(accumulators: DataFrame) -> DataFrame:
    """Mean, variance, root mean square and share above the threshold of every value."""
    values = [c.removesuffix("_n") for c in accumulators.columns if c.endswith("_n")]
    out: list[Column] = []
    for v in values:
        n, mean, m2 = F.col(f"{v}_n"), F.col(f"{v}_mean"), F.col(f"{v}_m2")
        variance = F.when(n > 0, m2 / n)
        out += [n.alias(f"{v}_n"), mean.alias(f"{v}_mean"), variance.alias(f"{v}_var"), F.sqrt(variance + mean * mean).alias(f"{v}_rms")]
        if f"{v}_above" in accumulators.columns:
            out.append(F.when(n > 0, F.col(f"{v}_above") / n).otherwise(0.0).alias(f"{v}_intermittency"))
    return accumulators.select(*PIXEL, *out, "frames")


def spans(accumulators: DataFrame) -> DataFrame:
    """First and last frame of every case: one row per case."""
    return accumulators.groupBy("case_id").agg(F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"))


def update(spark: SparkSession, root: str, voxel: DataFrame, *values: str, above: dict[str, float] | None = None) -> int:
    """Merge the new frames of a recording into the stored accumulators, as a version of them. Frames up to the last one
    that is in, case by case, are left out, so that a repeated call changes nothing. Returns the version."""

    def change(stored: DataFrame | None) -> DataFrame | None:
        fresh = voxel
        if stored is not None:
            known = spans(stored).select("case_id", F.col("last_t").alias("_in"))
            fresh = fresh.join(known, "case_id", "left").filter(F.col("_in").isNull() | (F.col("t") > F.col("_in"))).drop("_in")
        if fresh.isEmpty():
            return None if stored is not None else accumulate(fresh, *values, above=above)
        added = accumulate(fresh, *values, above=above)
        return added if stored is None else merge(stored, added)

    return versions.update_version(spark, root, change)


def merged(parts: list[DataFrame]) -> DataFrame:
    """Accumulators of several sets of frames."""
    return reduce(merge, parts)
