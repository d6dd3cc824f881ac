"""Frames on their own grids: recordings whose frames differ in size and place.

``native(case_id, t, x_mm, y_mm, <component>, ...)`` holds one row per frame: the coordinates of its columns
and rows, in the order in which they lie, and every component in row order. A frame is as large as the sensor;
it is never joined with another one, so that interleaving and cropping need no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyfield.model import per_case
from eddyfield.operators.sequence import interleave_heads

AXES = ["x_mm", "y_mm"]


def components_of(frames: DataFrame) -> list[str]:
    return [c for c in frames.columns if c not in ("case_id", "t", *AXES)]


def from_voxels(voxel: DataFrame, *values: str) -> DataFrame:
    """Voxels with coordinates ``(case_id, t, y, x, y_mm, x_mm, <values>)`` as native frames. Every frame
    numbers its own rows and columns; a pixel that is absent inside its frame is missing."""
    frame = ["case_id", "t"]
    cells = F.sort_array(F.collect_list(F.struct("y", "x", "y_mm", "x_mm", *values)))
    packed = voxel.groupBy(*frame).agg(cells.alias("cells"))

    def axis(place: str) -> Column:
        pairs = F.transform("cells", lambda c: F.struct(c[place], c[f"{place}_mm"].alias("mm")))
        return F.array_sort(F.array_distinct(pairs))["mm"]

    placed = packed.withColumns({"x_mm": axis("x"), "y_mm": axis("y")})
    whole = F.size("cells") == F.size("x_mm") * F.size("y_mm")
    checked = F.when(whole, F.col("cells")).otherwise(F.raise_error(F.lit("a frame is not a full rectangle, or its axes are not straight")).cast(packed.schema["cells"].dataType))
    return placed.withColumn("cells", checked).select(*frame, *AXES, *[F.col("cells")[v].alias(v) for v in values])


def from_lists(components: dict[str, DataFrame], x_frames: DataFrame, y_frames: DataFrame) -> DataFrame:
    """Native frames from frame lists ``(case_id, t, ny, nx, data)``: one per component, and one each for the
    coordinates of columns and rows. All must have the same frames, and sizes that fit."""
    frame = ["case_id", "t"]
    sized = {n: df.select(*frame, F.col("data").alias(n), F.array("ny", "nx").alias(f"{n}_size")) for n, df in components.items()}
    parts = list(sized.values())
    for name, df in zip(AXES, (x_frames, y_frames)):
        parts.append(df.select(*frame, F.transform("data", lambda v: v.cast("double")).alias(name)))
    joined = reduce(lambda a, b: a.join(b, frame, "full"), parts)
    fits = F.size("x_mm") > 0
    for n in components:
        fits = fits & (F.col(f"{n}_size") == F.array(F.size("y_mm"), F.size("x_mm")))
    message = F.concat(F.lit("frame "), F.col("t").cast("string"), F.lit(" of "), F.col("case_id"), F.lit(" lacks a part, or its parts differ in size"))
    first = next(iter(components))
    kind = joined.schema[first].dataType
    checked = F.when(F.coalesce(fits, F.lit(False)), F.col(first)).otherwise(F.raise_error(message).cast(kind))
    return joined.withColumn(first, checked).select(*frame, *AXES, *components)


def common_bounds(frames: DataFrame) -> DataFrame:
    """``(case_id, x_low, x_high, y_low, y_high)``: what all frames of a case cover. One row per case."""
    ends = {}
    for dim in ("x", "y"):
        ends[f"{dim}_low"] = F.max(F.array_min(f"{dim}_mm"))
        ends[f"{dim}_high"] = F.min(F.array_max(f"{dim}_mm"))
    return per_case(frames, *[v.alias(k) for k, v in ends.items()])


def crop(
    frames: DataFrame,
    x_mm: tuple[float, float] | None = None,
    y_mm: tuple[float, float] | None = None,
    margin: float = 0.0,
) -> DataFrame:
    """Rows and columns of every frame whose coordinates lie within the bounds, ``margin`` included on both
    sides. Bounds that are not given are those that all frames of the case cover. A frame beyond the
    bounds keeps its place with no pixels."""
    given = {"x": x_mm, "y": y_mm}
    values = components_of(frames)
    out = frames
    if None in given.values():
        out = out.join(common_bounds(frames), "case_id")

    def kept(dim: str) -> Column:
        low, high = (F.col(f"{dim}_low"), F.col(f"{dim}_high")) if given[dim] is None else (F.lit(float(b)) for b in sorted(given[dim]))
        inside = F.transform(f"{dim}_mm", lambda mm, i: F.when((mm >= low - margin) & (mm <= high + margin), i))
        return F.filter(inside, lambda i: i.isNotNull())

    out = out.withColumns({"_rows": kept("y"), "_columns": kept("x"), "_width": F.size("x_mm")})

    def part(name: str) -> Column:
        return F.flatten(F.transform("_rows", lambda j: F.transform("_columns", lambda i: F.col(name)[j * F.col("_width") + i])))

    return out.select(
        "case_id",
        "t",
        F.transform("_columns", lambda i: F.col("x_mm")[i]).alias("x_mm"),
        F.transform("_rows", lambda j: F.col("y_mm")[j]).alias("y_mm"),
        *[part(v).alias(v) for v in values],
    )


def interleave_native(
    a: DataFrame,
    b: DataFrame,
    x_mm: tuple[float, float] | None = None,
    y_mm: tuple[float, float] | None = None,
    margin: float = 1.0,
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Native frames of two heads in turn, each cropped to the bounds on its own grid. The bounds default to what
    all frames of both heads cover."""
    return crop(interleave_heads(a, b, offset, limit), x_mm, y_mm, margin)


def axes_of(frames: DataFrame) -> DataFrame:
    """The axes of every frame: ``axis(case_id, t, dim, idx, mm)``."""
    return reduce(
        DataFrame.unionByName,
        [frames.select("case_id", "t", F.lit(d).alias("dim"), F.posexplode(f"{d}_mm").alias("idx", "mm")) for d in ("x", "y")],
    )


def voxels_of(frames: DataFrame) -> DataFrame:
    """One row per pixel with its coordinates: ``(case_id, t, y, x, y_mm, x_mm, <components>)``."""
    values = components_of(frames)
    cells = frames.select("case_id", "t", *AXES, F.posexplode(F.arrays_zip(*values)).alias("at", "cell"))
    place = {"y": F.floor(F.col("at") / F.size("x_mm")).cast("int"), "x": (F.col("at") % F.size("x_mm")).cast("int")}
    return cells.withColumns(place).select(
        "case_id", "t", "y", "x", F.col("y_mm")[F.col("y")].alias("y_mm"), F.col("x_mm")[F.col("x")].alias("x_mm"), *[F.col(f"cell.{v}").alias(v) for v in values]
    )


def lists_of(frames: DataFrame) -> DataFrame:
    """Native frames as rows for ``write_arrays``: a list per component, and lists of the coordinates."""
    size = {"ny": F.size("y_mm"), "nx": F.size("x_mm")}
    parts = [
        frames.select("case_id", "t", F.lit(v).alias("component"), *[c.alias(n) for n, c in size.items()], F.transform(v, lambda x: x.cast("float")).alias("data"))
        for v in components_of(frames)
    ]
    for dim in ("x", "y"):
        data = F.transform(f"{dim}_mm", lambda v: v.cast("float"))
        parts.append(frames.select("case_id", "t", F.lit(f"{dim}grid").alias("component"), F.lit(1).alias("ny"), F.size(f"{dim}_mm").alias("nx"), data.alias("data")))
    return reduce(DataFrame.unionByName, parts)
