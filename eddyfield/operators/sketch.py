"""Quantiles of voxels without sorting them: sketches that are kept, merged and asked.

A sketch holds a few hundred samples with weights, whatever it has seen. Sketches of blocks of frames, cases or regions are made
once, in one scan with a partial aggregate per task, and those of any union of them are merged later without
reading a voxel. Estimates are off by a bounded rank, ``rank_error``; the reports in ``distribution`` are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 400  # of a sketch: the rank error falls with it


def rank_error(size: int = SIZE) -> float:
    """Twice the rank error that the sketch keeps in 99 of 100 cases, as a share of all samples."""
    return 2 * 2.296 / size**0.9723


def sketches(samples: DataFrame, keys: list[str], *values: str, size: int = SIZE) -> DataFrame:
    """``(*keys, value, n, sketch)``: a sketch of every value and group; missing samples are left out. A group without any has
    a count of 0 and no sketch."""
    parts = []
    for v in values:
        present = F.when(~F.isnan(v), F.col(v)).cast("double")
        sketch = F.when(F.count(present) > 0, F.kll_sketch_agg_double(present, size))
        parts.append(samples.groupBy(*keys).agg(F.count(present).alias("n"), sketch.alias("sketch")).withColumn("value", F.lit(v)))
    return reduce(DataFrame.unionByName, parts).select(*keys, "value", "n", "sketch")


def merged(stored: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """Sketches of larger groups from those of their parts."""
    return stored.groupBy(*keys, "value").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch"))


def quantiles(stored: DataFrame, keys: list[str], percents: list[float]) -> DataFrame:
    """``(*keys, value, n, percent, estimate)``: one row per percentage, without an estimate where there is no sample."""
    asked = F.array(*[F.lit(p / 100.0) for p in percents])
    found: Column = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", asked))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(percents)])
    rows = stored.withColumn("found", found).withColumn("percent", F.explode(each))
    return rows.select(*keys, "value", "n", F.col("percent.p").alias("percent"), F.get("found", F.col("percent.i")).alias("estimate"))


def within(samples: DataFrame, estimates: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """``(*keys, value, percent, n, good)``: whether the exact ranks of the estimates are within the bound. Every sample meets the few
    estimates of its group and is counted at once."""
    bound = rank_error(size)
    out = []
    for (v,) in estimates.select("value").distinct().collect():
        mine = estimates.filter(F.col("value") == v)
        met = samples.filter(F.col(v).isNotNull() & ~F.isnan(v)).join(mine, keys)
        below, upto = F.count_if(F.col(v) < F.col("estimate")), F.count_if(F.col(v) <= F.col("estimate"))
        ranks = met.groupBy(*keys, "percent", "n").agg(below.alias("below"), upto.alias("upto"))
        share = F.col("percent") / 100.0
        good = (F.col("below") / F.col("n") <= share + bound) & (F.col("upto") / F.col("n") >= share - bound)
        out.append(ranks.select(*keys, F.lit(v).alias("value"), "percent", "n", good.alias("good")))
    return reduce(DataFrame.unionByName, out)
