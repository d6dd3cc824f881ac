"""Joins of fields on their position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eddyfield.model import COMPONENTS, ENVELOPE_CUTOFF, PIXEL, VOXEL, W_FLOOR
from eddyfield.operators.select import roi_index
from eddyfield.session import settle


def grid_sizes(field: DataFrame) -> DataFrame:
    """``(case_id, nt, ny, nx)``: how far a table reaches in every direction, one row per case, settled."""
    return settle(field.groupBy("case_id").agg(*[(F.max(d) + 1).alias(f"n{d}") for d in ("t", "y", "x")]), "sizes")


def join_fields(
    velocity: DataFrame,
    scalar: DataFrame,
    *,
    y_offset: int = 0,
    n_rows: int | None = None,
    trim: tuple[str, ...] = (),
) -> DataFrame:
    """Velocity and concentration of the same voxel.

    ``velocity`` may be stored already trimmed: its row 0 is row ``y_offset`` of the scalar.
    ``n_rows`` crops the scalar to the trimmed rows. The two must have the same cases and be of the same size in
    every direction; those in ``trim`` are cut to the shorter one instead. What differs otherwise is refused, since
    a join would drop it unseen.
    """
    if n_rows is not None:
        scalar = roi_index(scalar, y=(y_offset, y_offset + n_rows))
    sizes = grid_sizes(velocity).join(grid_sizes(scalar).withColumnsRenamed({f"n{d}": f"m{d}" for d in "tyx"}), "case_id", "full")
    sizes = sizes.withColumn("my", F.col("my") - F.lit(y_offset))
    odd = F.lit(False)
    for d in "tyx":
        if d not in trim:
            odd = odd | ~F.col(f"n{d}").eqNullSafe(F.col(f"m{d}"))
    wrong = sizes.filter(odd | F.col("nt").isNull() | F.col("mt").isNull()).orderBy("case_id").limit(3).collect()
    if wrong:
        told = "; ".join(f"{r['case_id']}: velocity {r['nt']} frames, {r['ny']} rows, {r['nx']} columns, scalar {r['mt']}, {r['my']}, {r['mx']}" for r in wrong)
        raise ValueError(f"the fields differ in size: {told}")
    aligned = velocity.withColumn("y", F.col("y") + F.lit(y_offset))
    return aligned.join(scalar, VOXEL)


def join_mean(voxel: DataFrame, mean: DataFrame) -> DataFrame:
    """Every frame beside a 2-D field.

    A stored mean field below the broadcast threshold is broadcast. A larger one is a shuffle
    of the voxels by pixel (an even key: each pixel has one row per frame), or no shuffle at all
    of voxels stored by ``model.by_pixel``.
    """
    return voxel.join(mean, PIXEL)


def mean_field(voxel: DataFrame, *values: str) -> DataFrame:
    return voxel.groupBy(*PIXEL).agg(*[F.avg(v).alias(v) for v in values or ("u", "v", "w", "c")])


def reynolds(voxel: DataFrame, mean: DataFrame | None = None, w_floor: float = W_FLOOR) -> DataFrame:
    """Fluctuations u', v', w' about a mean field (the voxels' own by default); w' below
    ``w_floor`` is missing. Statistics of fluctuations do not need this table, see
    ``turbulence``: they subtract the mean after aggregating."""
    if mean is None:
        mean = settle(mean_field(voxel, *COMPONENTS), "mean")
    means = mean.select(*PIXEL, *[F.col(k).alias(f"_{k}") for k in COMPONENTS])
    out = join_mean(voxel, means)
    for k in COMPONENTS:
        out = out.withColumn(k, F.col(k) - F.col(f"_{k}"))
    return out.withColumn("w", F.when(F.col("w") >= w_floor, F.col("w"))).drop(*[f"_{k}" for k in COMPONENTS])


def refresh_fluctuation(voxel: DataFrame, mean: DataFrame, rows: tuple[int, int]) -> DataFrame:
    """w' about a new mean on a band of rows, renumbered from the start of the band."""
    band = roi_index(voxel, y=rows).select(*VOXEL, "w")
    return (
        join_mean(band, mean.select(*PIXEL, F.col("w").alias("_w")))
        .select("case_id", "t", (F.col("y") - rows[0]).alias("y"), "x", (F.col("w") - F.col("_w")).alias("w"))
    )


def join_envelope(df: DataFrame, intermittency: DataFrame, cutoff: float = ENVELOPE_CUTOFF) -> DataFrame:
    """Flag pixels inside the plume: intermittency (a fraction) at or above the cutoff."""
    return df.join(
        intermittency.select(*PIXEL, (F.col("intermittency") >= cutoff).alias("inside")), PIXEL
    )


def nearest_coord(axis: DataFrame, targets: DataFrame) -> DataFrame:
    """Point of an axis closest to each target; the first index wins a tie.

    ``axis(case_id, dim, idx, mm)``, ``targets(case_id, dim, target)``. The neighbours on either
    side come from one sort of points and targets together, not from pairs of them.
    """
    keys = ["case_id", "dim"]
    points = axis.groupBy(*keys, "mm").agg(F.min("idx").alias("idx"))
    both = points.select(*keys, "mm", F.struct("mm", "idx").alias("point"), F.lit(None).cast("double").alias("target"))
    both = both.unionByName(
        targets.select(
            *keys,
            F.col("target").alias("mm"),
            F.lit(None).cast(both.schema["point"].dataType).alias("point"),
            F.col("target").cast("double").alias("target"),
        )
    )
    # at equal coordinates points sort before targets, in both directions
    line, is_target = Window.partitionBy(*keys), F.col("target").isNotNull()
    so_far = (Window.unboundedPreceding, 0)
    below = F.last("point", ignorenulls=True).over(line.orderBy("mm", is_target).rowsBetween(*so_far))
    above = F.last("point", ignorenulls=True).over(line.orderBy(F.desc("mm"), is_target).rowsBetween(*so_far))
    found = both.withColumn("below", below).withColumn("above", above).filter(F.col("target").isNotNull())
    d_below = F.col("target") - F.col("below.mm")
    d_above = F.col("above.mm") - F.col("target")
    take_below = (
        F.col("above").isNull()
        | (d_below < d_above)
        | ((d_below == d_above) & (F.col("below.idx") <= F.col("above.idx")))
    )
    best = F.when(F.col("below").isNotNull() & take_below, F.col("below")).otherwise(F.col("above"))
    return found.select(*keys, "target", best["idx"].alias("idx"), best["mm"].alias("mm")).distinct()


def frame_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """Number of frames of every case in every named source: (source, case_id, frames)."""
    tagged = [df.select(F.lit(name).alias("source"), "case_id", "t") for name, df in sources.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("source", "case_id").agg(F.countDistinct("t").alias("frames"))


def frame_count_check(sources: dict[str, DataFrame]) -> DataFrame:
    """Frame counts of all sources; the query fails unless every case has equally many, and some, in
    each of them."""
    counts = frame_counts(sources)
    case = Window.partitionBy("case_id")  # one row per source
    low, high = F.min("frames").over(case), F.max("frames").over(case)
    ok = (low == high) & (low > 0) & (F.count(F.lit(1)).over(case) == len(sources))
    return counts.withColumn(
        "frames",
        F.when(ok, F.col("frames")).otherwise(F.raise_error(F.lit("frame counts differ or are zero")).cast("bigint")),
    )


def available_cases(wanted: DataFrame, voxel: DataFrame) -> DataFrame:
    """Wanted cases, each with whether it has data."""
    have = settle(voxel.select("case_id").distinct().withColumn("has_data", F.lit(True)), "cases")
    return wanted.join(have, "case_id", "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))


def skip_missing_case(wanted: DataFrame, voxel: DataFrame) -> DataFrame:
    """Voxels of those wanted cases that have data; the others are skipped silently."""
    return voxel.join(wanted.select("case_id").distinct(), "case_id", "left_semi")


def avg_components(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Half the sum of two component fields of a case."""
    other = b.select(*PIXEL, F.col(value).alias("_b"))
    return a.join(other, PIXEL).select(*PIXEL, (F.lit(0.5) * (F.col(value) + F.col("_b"))).alias(value))


def avg_columns(field: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """The same of two columns of one table, without a join."""
    return field.select(*PIXEL, (F.lit(0.5) * (F.col(a) + F.col(b))).alias(value))
