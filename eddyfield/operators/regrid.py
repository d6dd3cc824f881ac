"""Interpolation onto other grids, and filling of gaps.

A rectilinear grid is handled one axis at a time. Every target coordinate is located in its
source axis by one sort of both, which gives two source indices and two weights per target
coordinate: a table as long as the axes, not as large as the mesh. The voxels meet the two
weight tables and the four products of a target are summed on the map side of one
aggregation, so the voxels themselves are never shuffled while the weight tables are small
enough to broadcast (Spark decides that from their stored size).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyfield.model import PIXEL
from eddyfield.session import settle


def locate(axis: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Cell of a source axis that holds each target coordinate.

    ``axis(*keys, idx, mm)``, ``targets(*keys, to, mm)``. Returns the lower and upper source
    index and coordinate, and whether the target lies inside the axis; a target beyond an end
    gets the end cell. The last point belongs to the last cell. The order of the axis does not
    matter, so a descending axis needs no flip.
    """
    line = Window.partitionBy(*keys).orderBy("mm")
    cells = (
        axis.withColumn("hi", F.lead(F.struct("mm", "idx")).over(line))
        .withColumn("before", F.lag(F.struct("mm", "idx")).over(line))
        .select(
            *keys,
            "mm",
            F.when(F.col("hi").isNull(), F.struct(F.col("before").alias("lo"), F.struct("mm", "idx").alias("hi")))
            .otherwise(F.struct(F.struct("mm", "idx").alias("lo"), F.col("hi").alias("hi")))
            .alias("cell"),
        )
    )
    cell_type = cells.schema["cell"].dataType
    both = cells.select(*keys, "mm", "cell", F.lit(None).cast("int").alias("to")).unionByName(
        targets.select(*keys, "mm", F.lit(None).cast(cell_type).alias("cell"), F.col("to").cast("int").alias("to"))
    )
    # points sort before targets at the same coordinate; before the first cell, take that one
    ordered = Window.partitionBy(*keys).orderBy("mm", F.col("to").isNotNull())
    below = F.last("cell", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    lowest = F.first("cell", ignorenulls=True).over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    found = both.withColumn("at", F.coalesce(below, lowest)).filter(F.col("to").isNotNull())
    lo, hi = F.col("at.lo"), F.col("at.hi")
    return found.select(
        *keys,
        "to",
        "mm",
        lo["idx"].alias("lo_idx"),
        lo["mm"].alias("lo_mm"),
        hi["idx"].alias("hi_idx"),
        hi["mm"].alias("hi_mm"),
        ((F.col("mm") >= lo["mm"]) & (F.col("mm") <= hi["mm"])).alias("inside"),
    )


def linear_weights(axis: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, to, from, weight, inside)``: two source indices per target coordinate."""
    share = (F.col("mm") - F.col("lo_mm")) / (F.col("hi_mm") - F.col("lo_mm"))
    pairs = F.array(
        F.struct(F.col("lo_idx").alias("from"), (1 - share).alias("weight")),
        F.struct(F.col("hi_idx").alias("from"), share.alias("weight")),
    )
    return (
        locate(axis, targets, keys)
        .select(*keys, "to", "inside", F.explode(pairs).alias("pair"))
        .select(*keys, "to", "inside", "pair.from", "pair.weight")
    )


def nearest_weights(axis: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """One source index per target coordinate; a tie goes to the lower coordinate."""
    share = (F.col("mm") - F.col("lo_mm")) / (F.col("hi_mm") - F.col("lo_mm"))
    return locate(axis, targets, keys).select(
        *keys,
        "to",
        "inside",
        F.when(share <= 0.5, F.col("lo_idx")).otherwise(F.col("hi_idx")).alias("from"),
        F.lit(1.0).alias("weight"),
    )


def regrid(
    voxel: DataFrame,
    axis: DataFrame,
    targets: DataFrame,
    values: list[str],
    *,
    method: str = "linear",
    fill: float | None = None,
    y_shift: float = 0.0,
) -> DataFrame:
    """Values of every frame on the target axes ``targets(case_id, dim, idx, mm)``.

    ``axis`` holds the source axes, either one pair per case or, with a column ``t``, one pair
    per frame. Targets outside the source get ``fill``; a missing corner makes the result
    missing, even at weight zero. ``y_shift`` is added to the source rows' coordinates.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown method {method}")
    weigh, corners = (linear_weights, 4) if method == "linear" else (nearest_weights, 1)
    keys = ["case_id", "t"] if "t" in axis.columns else ["case_id"]
    out = voxel.select("case_id", "t", "y", "x", *values)
    for dim in ("y", "x"):
        shift = y_shift if dim == "y" else 0.0
        points = axis.filter(F.col("dim") == dim).select(*keys, "idx", (F.col("mm") + F.lit(shift)).alias("mm"))
        wanted = targets.filter(F.col("dim") == dim).select("case_id", F.col("idx").alias("to"), "mm")
        if "t" in keys:
            wanted = wanted.join(points.select(*keys).distinct(), "case_id")
        weights = settle(weigh(points, wanted, keys), f"weights_{dim}").select(
            *keys,
            F.col("from").alias(dim),
            F.col("to").alias(f"to_{dim}"),
            F.col("weight").alias(f"w_{dim}"),
            F.col("inside").alias(f"in_{dim}"),
        )
        out = out.join(weights, [*keys, dim])
    share = F.col("w_y") * F.col("w_x")
    inside = F.col("in_y") & F.col("in_x")
    filled = F.lit(fill).cast("double")
    return out.groupBy("case_id", "t", F.col("to_y").alias("y"), F.col("to_x").alias("x")).agg(
        *[
            F.when(~F.bool_and(inside), filled)
            .otherwise(F.when(F.count(v) == corners, F.sum(share * F.col(v))))
            .alias(v)
            for v in values
        ]
    )


def _doubling(limit: int) -> list[int]:
    radii = [1]
    while radii[-1] < limit:
        radii.append(radii[-1] * 2)
    return radii


def fill_nearest(field: DataFrame, value: str) -> DataFrame:
    """Missing pixels take the value of the nearest present pixel (by index distance; ties by
    row, then column). A case without any present pixel stays as it is.

    First each pixel learns the nearest present pixel of its own row, by two windows. The
    nearest of all then lies in some row dy away, at distance dx^2 + dy^2 with that row's dx;
    rows are searched in rings of doubling dy, and a pixel leaves the search as soon as no
    further row can be nearer. Work is proportional to the gap size, not to all pairs.
    """
    field = settle(field.select(*PIXEL, value), "field")
    line = Window.partitionBy("case_id", "y")
    so_far = (Window.unboundedPreceding, 0)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("x").alias("sx"), F.col(value).alias("sv")))
    rows = (
        field.withColumn("left", F.last(here, ignorenulls=True).over(line.orderBy("x").rowsBetween(*so_far)))
        .withColumn("right", F.last(here, ignorenulls=True).over(line.orderBy(F.desc("x")).rowsBetween(*so_far)))
        .withColumn("dl", F.col("x") - F.col("left.sx"))
        .withColumn("dr", F.col("right.sx") - F.col("x"))
    )
    nearest = F.when(F.col("right").isNull() | (F.col("dl") <= F.col("dr")), F.col("left")).otherwise(F.col("right"))
    rows = settle(
        rows.withColumn("near", nearest)
        .filter(F.col("near").isNotNull())
        .select("case_id", F.col("y").alias("sy"), "x", F.abs(F.col("x") - F.col("near.sx")).alias("dx"), "near"),
        "rows",
    )
    solvable = rows.select("case_id").distinct()
    best_type = "struct<d2:bigint,sy:int,sx:int,sv:double>"
    open_pixels = (
        field.filter(F.col(value).isNull())
        .join(solvable, "case_id", "left_semi")
        .select(*PIXEL, F.lit(None).cast(best_type).alias("best"))
    )
    last_row = field.agg(F.max("y")).first()[0]
    if last_row is None:  # no field, nothing to fill
        return field
    n_rows = last_row + 1
    done: list[DataFrame] = []
    reach = -1
    for radius in _doubling(n_rows):
        ring = F.filter(F.sequence(F.lit(-radius), F.lit(radius)), lambda dy: F.abs(dy) > F.lit(reach))
        candidates = (
            open_pixels.select(*PIXEL, F.explode(ring).alias("dy"))
            .withColumn("sy", F.col("y") + F.col("dy"))
            .join(rows, ["case_id", "sy", "x"])
            .select(
                *PIXEL,
                F.struct(
                    (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("bigint").alias("d2"),
                    F.col("sy"),
                    F.col("near.sx").alias("sx"),
                    F.col("near.sv").alias("sv"),
                ).alias("best"),
            )
        )
        state = settle(
            open_pixels.unionByName(candidates).groupBy(*PIXEL).agg(F.min("best").alias("best")), "ring"
        )
        reach = radius
        settled = F.col("best").isNotNull() & (F.col("best.d2") < (reach + 1) * (reach + 1))
        last = reach >= n_rows
        done.append(state if last else state.filter(settled))
        open_pixels = state.filter(F.col("best").isNull() | ~settled)
        if last or open_pixels.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done).select(*PIXEL, F.col("best.sv").alias("_fill"))
    return field.join(found, PIXEL, "left").select(*PIXEL, F.coalesce(F.col(value), F.col("_fill")).alias(value))


CROWD = 64  # points that a cell may hold before the cells are made smaller


def regrid_curvilinear(
    points: DataFrame, targets: DataFrame, value: str, cell: float, fill: float | None = None
) -> DataFrame:
    """Value of the nearest valid scattered point: ``points(case_id, t, x_mm, y_mm, value)``
    onto ``targets(case_id, t, y, x, x_mm, y_mm)``; ties go to the smaller value.

    Points and targets meet in square cells and their eight neighbours; a match is final when
    it is no further than one cell side. ``cell`` is a first guess of the side: cells are halved
    until none holds more than 64 points, so a dense spot cannot make one target meet many
    points. Targets further from all points search down from large cells, see ``_descend``.
    A frame without valid points gets ``fill``.
    """
    frame, target = ["case_id", "t"], ["case_id", "t", "y", "x"]
    valid = (
        points.filter(F.col(value).isNotNull() & F.col("x_mm").isNotNull() & F.col("y_mm").isNotNull())
        .groupBy(*frame, F.col("x_mm").alias("px"), F.col("y_mm").alias("py"))
        .agg(F.min(value).alias("pv"))
    )
    valid = settle(valid, "points")
    targets = settle(targets.select(*target, "x_mm", "y_mm"), "targets")
    with_points = valid.select(*frame).distinct()
    dark = targets.join(with_points, frame, "left_anti").select(*target, F.lit(fill).cast("double").alias(value))
    lit = targets.join(with_points, frame, "left_semi")

    def of(coordinate: str, size: float) -> Column:
        return F.floor(F.col(coordinate) / F.lit(size)).cast("bigint")

    side = cell
    while True:
        housed = valid.withColumns({"cx": of("px", side), "cy": of("py", side)})
        crowd = housed.groupBy(*frame, "cx", "cy").count().agg(F.max("count")).first()[0] or 0
        if crowd <= CROWD:
            break
        side /= 2
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    spread = (
        lit.withColumn("dx", F.explode(near))
        .withColumn("dy", F.explode(near))
        .withColumns({"cx": of("x_mm", side) + F.col("dx"), "cy": of("y_mm", side) + F.col("dy")})
    )
    close = settle(_closest(spread, housed, target).filter(F.col("best.d2") <= side * side), "close")
    far = settle(lit.join(close, target, "left_anti"), "far")
    found = [dark, close.select(*target, F.col("best.pv").alias(value))]
    if not far.isEmpty():
        found.append(_descend(far, housed, side, target).select(*target, F.col("best.pv").alias(value)))
    return reduce(DataFrame.unionByName, found)


def _closest(spread: DataFrame, housed: DataFrame, target: list[str]) -> DataFrame:
    """Closest point of the cells listed for each target."""
    gap_x, gap_y = F.col("px") - F.col("x_mm"), F.col("py") - F.col("y_mm")
    return (
        spread.join(housed, ["case_id", "t", "cx", "cy"])
        .groupBy(*target)
        .agg(F.min(F.struct((gap_x * gap_x + gap_y * gap_y).alias("d2"), F.col("pv"))).alias("best"))
    )


def _descend(far: DataFrame, housed: DataFrame, side: float, target: list[str]) -> DataFrame:
    """Closest point of every target, from the largest cells down to those of ``side``.

    An occupied cell holds a point between the distance of its near edge and that of its far
    corner. On each level a target keeps the cells whose near edge is not beyond the nearest
    far corner, and passes on to their occupied quarters of quarters. So it meets only the rim
    of the points that faces it, and the points of a few small cells at the end.
    """
    frame = ["case_id", "t"]
    occupied = settle(housed.select(*frame, "cx", "cy").distinct(), "occupied")
    spans = occupied.agg(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).first()
    top = 0
    while (1 << top) <= max(spans):
        top += 2

    def cells(shift: int) -> DataFrame:
        shrunk = [F.shiftright(c, shift).alias(c) for c in ("cx", "cy")]
        return occupied.select(*frame, *shrunk).distinct()

    kept = far.join(cells(top), frame)
    for shift in range(top - 2, -1, -2):
        size = F.lit(side * (1 << shift))
        parts = cells(shift).select(
            *frame, F.shiftright("cx", 2).alias("cx"), F.shiftright("cy", 2).alias("cy"), F.col("cx").alias("kx"), F.col("cy").alias("ky")
        )
        low2, high2 = F.lit(0.0), F.lit(0.0)
        for k, p in (("kx", "x_mm"), ("ky", "y_mm")):
            left = F.col(p) - F.col(k) * size
            right = (F.col(k) + 1) * size - F.col(p)
            gap, reach = F.greatest(-left, -right, F.lit(0.0)), F.greatest(F.abs(left), F.abs(right))
            low2, high2 = low2 + gap * gap, high2 + reach * reach
        nearest = F.min("high2").over(Window.partitionBy(*target))
        kept = settle(
            kept.join(parts, [*frame, "cx", "cy"])
            .withColumns({"low2": low2, "high2": high2})
            .withColumn("bound", nearest * (1 + 1e-9))
            .filter("low2 <= bound")
            .select(*target, "x_mm", "y_mm", F.col("kx").alias("cx"), F.col("ky").alias("cy")),
            "descent",
        )
    return _closest(kept, housed, target)
