"""Differences between neighbours in x, y and t.

Neighbours are found inside tiles: blocks of frames, rows and columns whose edge cells are
also copied to the tiles next door. One shuffle on the tile serves the windows of all three
directions, no window is longer than a tile, and no case, frame or pixel can become a hot
group, because every tile holds at most ``T * Y * X`` cells plus its rim.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eddyfield.model import C_MIN, FRAME_TIME, GRADIENT_PITCH, PIXEL, VOXEL
from eddyfield.operators.select import frames
from eddyfield.session import settle


@dataclass(frozen=True)
class Tile:
    """Size of a tile in frames, rows and columns."""

    t: int = 32
    y: int = 128
    x: int = 128


TILE_KEYS = ["_tile_t", "_tile_y", "_tile_x"]


def with_rims(df: DataFrame, rim: dict[str, int], tile: Tile = Tile()) -> DataFrame:
    """Assign every cell to its tile and, within ``rim[dim]`` cells of an edge, to the tile
    beyond it. ``_own`` marks the copy in the cell's own tile."""
    own = F.lit(True)
    for dim in ("t", "y", "x"):
        if dim not in df.columns:
            continue
        size, key, at = getattr(tile, dim), f"_tile_{dim}", F.col(dim)
        home = F.floor(at / F.lit(size)).cast("int")
        reach = rim.get(dim, 0)
        if reach == 0:
            df = df.withColumn(key, home)
            continue
        first = F.floor((at - reach) / F.lit(size)).cast("int")
        last = F.floor((at + reach) / F.lit(size)).cast("int")
        df = df.withColumn(key, F.explode(F.sequence(first, last)))
        own = own & (F.col(key) == home)
    keys = [k for k in TILE_KEYS if k in df.columns]
    return df.withColumn("_own", own).repartition("case_id", *keys)


def line_along(df: DataFrame, dim: str) -> WindowSpec:
    """Window along one direction of a tile, through one cell of the other directions.

    The position of the line comes first as one number: rows of different lines then compare by
    a single long in the sort. The tile keys follow, so the tile's shuffle still serves.
    """
    keys = [k for k in TILE_KEYS if k in df.columns]
    others = [F.col(d).cast("bigint") for d in ("t", "y", "x") if d != dim and d in df.columns]
    line = others[0]
    for other in others[1:]:
        line = line * F.lit(1 << 32) + other
    return Window.partitionBy(line, "case_id", *keys).orderBy(dim)


def beside(value: str, dim: str, line: WindowSpec, step: int) -> Column:
    """``value`` of the cell ``step`` (1 or -1) along the line; NULL where that cell has no row."""
    ahead = F.lead if step > 0 else F.lag
    return F.when(ahead(dim).over(line) == F.col(dim) + step, ahead(value).over(line))


def _slope(value: str, dim: str, step: float, line: WindowSpec) -> Column:
    """Central difference inside, one-sided at the first and last cell of the grid.

    The edge is where no further *cell* exists. A neighbour that is missing its value, or its row
    inside the grid, makes the difference missing; ``model.densify`` puts rows in at the edges.
    """
    before, after = beside(value, dim, line, -1), beside(value, dim, line, 1)
    at_start, at_end = F.lag(dim).over(line).isNull(), F.lead(dim).over(line).isNull()
    here = F.col(value)
    return (
        F.when(at_start, (after - here) / F.lit(step))
        .when(at_end, (here - before) / F.lit(step))
        .otherwise((after - before) / F.lit(2.0 * step))
    )


def gradients(
    df: DataFrame, wanted: dict[str, tuple[str, str, float]], *, tile: Tile = Tile(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Several first differences at once: ``wanted[name] = (value, direction, step)``. Of the other columns those in ``keep``
    stay."""
    axes = [d for d in ("t", "y", "x") if d in df.columns]
    values = sorted({value for value, _, _ in wanted.values()})
    kept = [k for k in keep if k not in values]
    narrow = df.select("case_id", *axes, *values, *kept)
    tiled = with_rims(narrow, {dim: 1 for _, dim, _ in wanted.values()}, tile)
    tiled = tiled.withColumns({v: F.col(v).cast("double") for v in values})  # after the shuffle
    lines = {dim: line_along(tiled, dim) for _, dim, _ in wanted.values()}
    for name, (value, dim, step) in wanted.items():
        tiled = tiled.withColumn(name, _slope(value, dim, step, lines[dim]))
    return tiled.filter("_own").select("case_id", *axes, *values, *kept, *wanted)


def spatial_gradient(voxel: DataFrame, value: str = "c", dx: float = GRADIENT_PITCH, dy: float = GRADIENT_PITCH, tile: Tile = Tile()) -> DataFrame:
    """Slopes of a field along columns (d_dx) and rows (d_dy)."""
    return gradients(voxel, {"d_dx": (value, "x", dx), "d_dy": (value, "y", dy)}, tile=tile)


def temporal_gradient(voxel: DataFrame, value: str = "c", dt: float = FRAME_TIME, tile: Tile = Tile()) -> DataFrame:
    """Slope of a field over time."""
    return gradients(voxel, {"d_dt": (value, "t", dt)}, tile=tile)


def gradient_means(
    voxel: DataFrame,
    value: str = "c",
    dx: float = GRADIENT_PITCH,
    dy: float = GRADIENT_PITCH,
    dt: float = FRAME_TIME,
    tile: Tile = Tile(),
) -> DataFrame:
    """Means over time of the three slopes and of the products -d_dx d_dt and -d_dy d_dt."""
    slopes = gradients(
        voxel, {"d_dx": (value, "x", dx), "d_dy": (value, "y", dy), "d_dt": (value, "t", dt)}, tile=tile
    )
    return slopes.groupBy(*PIXEL).agg(
        F.avg("d_dx").alias("dx_mean"),
        F.avg("d_dy").alias("dy_mean"),
        F.avg("d_dt").alias("dt_mean"),
        F.avg(-F.col("d_dx") * F.col("d_dt")).alias("dx_dt_mean"),
        F.avg(-F.col("d_dy") * F.col("d_dt")).alias("dy_dt_mean"),
    )


def strain_rates(fluct: DataFrame, dx: float, tile: Tile = Tile()) -> DataFrame:
    """du'/d(row), dv'/d(column), and dw'/dz from continuity."""
    slopes = gradients(fluct, {"du": ("u", "y", dx), "dv": ("v", "x", dx)}, tile=tile)
    return slopes.withColumn("dw", -F.col("du") - F.col("dv")).drop("u", "v")


def motion_correlator(
    voxel: DataFrame,
    mean: DataFrame | None = None,
    c_min: float = C_MIN,
    t0: int = 0,
    all_pairs: bool = False,
    tile: Tile = Tile(),
) -> DataFrame:
    """Time-mean of a(p, t+1) a(q, t) - a(p, t) a(q, t+1), where q is the pixel before p along
    the columns (corr_x) or along the rows (corr_y) and a = c - mean, with c < c_min missing.

    Pairs of frames start at t0 + 1 unless ``all_pairs``. The mean field is constant in time,
    so it leaves the sum: with D = c(t+1) - c(t),
    E[...] = E[p1 q - p q1] - m_q E[D_p] + m_p E[D_q]; it joins the per-pixel sums only.
    """
    if mean is None:
        mean = voxel.groupBy(*PIXEL).agg(F.avg("c").alias("c"))
    mean = settle(mean.select(*PIXEL, "c"), "mean")  # joined three times
    masked = voxel.select(*VOXEL, F.when(F.col("c") >= c_min, F.col("c")).alias("c"))
    tiled = with_rims(masked, {"t": 1, "y": 1, "x": 1}, tile).withColumn("c", F.col("c").cast("double"))
    tiled = tiled.withColumn("c1", beside("c", "t", line_along(tiled, "t"), 1))
    for dim in ("x", "y"):
        line = line_along(tiled, dim)
        tiled = (
            tiled.withColumn(f"has_{dim}", F.lag(dim).over(line).isNotNull())
            .withColumn(f"q_{dim}", beside("c", dim, line, -1))
            .withColumn(f"q1_{dim}", beside("c1", dim, line, -1))
        )
    first = t0 if all_pairs else t0 + 1
    pairs = tiled.filter(F.col("_own") & F.col("has_x") & F.col("has_y")).withColumn(
        "counts", F.col("t") >= first
    )
    sums = []
    for dim in ("x", "y"):
        product = F.col("c1") * F.col(f"q_{dim}") - F.col("c") * F.col(f"q1_{dim}")
        used = F.col("counts") & product.isNotNull()
        sums += [
            F.avg(F.when(used, product)).alias(f"s_{dim}"),
            F.avg(F.when(used, F.col("c1") - F.col("c"))).alias(f"dp_{dim}"),
            F.avg(F.when(used, F.col(f"q1_{dim}") - F.col(f"q_{dim}"))).alias(f"dq_{dim}"),
        ]
    per_pixel = pairs.groupBy(*PIXEL).agg(*sums)
    m_p = mean.select(*PIXEL, F.col("c").alias("m_p"))
    m_x = mean.select("case_id", "y", (F.col("x") + 1).alias("x"), F.col("c").alias("m_x"))
    m_y = mean.select("case_id", (F.col("y") + 1).alias("y"), "x", F.col("c").alias("m_y"))
    joined = per_pixel.join(m_p, PIXEL, "left").join(m_x, PIXEL, "left").join(m_y, PIXEL, "left")
    return joined.select(
        *PIXEL,
        *[
            (
                F.col(f"s_{dim}") - F.col(f"m_{dim}") * F.col(f"dp_{dim}") + F.col("m_p") * F.col(f"dq_{dim}")
            ).alias(f"corr_{dim}")
            for dim in ("x", "y")
        ],
    )


def correlator_frame(voxel: DataFrame, t: int, value: str = "c", tile: Tile = Tile()) -> DataFrame:
    """The same difference along the columns for the frames t - 1 and t, without a mean."""
    if t < 1:
        raise IndexError("the correlator of a frame needs the frame before it")
    now = F.col("t") == t
    pair = frames(voxel, t - 1, t + 1).groupBy(*PIXEL).agg(
        F.max(F.when(now, F.col(value))).alias("c1"), F.max(F.when(~now, F.col(value))).alias("c0")
    )
    tiled = with_rims(pair, {"x": 1}, tile)
    line = line_along(tiled, "x")
    tiled = (
        tiled.withColumn("q0", beside("c0", "x", line, -1))
        .withColumn("q1", beside("c1", "x", line, -1))
        .withColumn("has", F.lag("x").over(line).isNotNull())
    )
    return tiled.filter(F.col("_own") & F.col("has")).select(
        *PIXEL, (F.col("c1") * F.col("q0") - F.col("c0") * F.col("q1")).alias("corr")
    )


def peak_shift_velocity(
    voxel: DataFrame,
    shape: DataFrame,
    along: str,
    pixels: int,
    mean: DataFrame | None = None,
    c_min: float = C_MIN,
    mm_per_px: float = 1.0,
    frames_per_s: float = 1.0,
) -> DataFrame:
    """Displacement of the scalar from frame to frame at sites ``pixels`` apart.

    Around a site, a is averaged over ``pixels`` cells across the direction ``along``; its
    product with the next frame is averaged over ``pixels`` cells for every shift of -pixels to
    pixels - 1 cells. The shift of the largest positive average counts unless it is -pixels.
    Returns the mean shift and velocity of every site from the third one on.

    Averaging comes first and shrinks the data ``pixels`` times before the shifts multiply it;
    every later group holds at most 2 ``pixels`` rows.
    """
    if pixels < 2 or pixels % 2:
        raise ValueError("pixels must be an even number")
    if mean is None:
        mean = voxel.groupBy(*PIXEL).agg(F.avg("c").alias("c"))
    across = "y" if along == "x" else "x"
    half = pixels // 2
    site = lambda position: F.floor((position + half) / F.lit(pixels)).cast("int")
    masked = F.when(F.col("c") >= c_min, F.col("c").cast("double"))

    def bands(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
        return df.groupBy(*keys, site(F.col(across)).alias("band"), F.col(along).alias("at")).agg(
            F.when(F.count(value) == pixels, F.avg(value)).alias(name)
        )

    level = bands(mean, ["case_id"], F.col("c"), "level")
    line = settle(
        bands(voxel, ["case_id", "t"], masked, "a")
        .join(level, ["case_id", "band", "at"])
        .select("case_id", "t", "band", "at", (F.col("a") - F.col("level")).alias("a")),
        "bands",
    )
    moved = line.select("case_id", (F.col("t") - 1).alias("t"), "band", F.col("at").alias("to"), F.col("a").alias("a1"))
    shifts = F.sequence(F.lit(-pixels), F.lit(pixels - 1))
    product = F.col("a") * F.col("a1")
    best = (
        line.withColumn("shift", F.explode(shifts))
        .withColumn("to", F.col("at") + F.col("shift"))
        .join(moved, ["case_id", "t", "band", "to"])
        .groupBy("case_id", "t", "band", site(F.col("at")).alias("site"), "shift")
        .agg(F.when(F.count(product) == pixels, F.avg(product)).alias("cov"))
        .filter("cov > 0")
        .groupBy("case_id", "t", "band", "site")
        .agg((-F.max(F.struct("cov", -F.col("shift"))).getField("col2")).alias("shift"))
        .filter(F.abs("shift") < pixels)
    )
    n_bands, n_sites = (F.floor((F.col(f"n{d}") - pixels) / pixels) for d in (across, along))
    inside = (F.col("band") >= 2) & (F.col("band") < n_bands) & (F.col("site") >= 2) & (F.col("site") < n_sites)
    return (
        best.join(shape.select("case_id", "ny", "nx"), "case_id")
        .filter(inside)
        .groupBy("case_id", (F.col("band") * pixels).alias(across), (F.col("site") * pixels).alias(along))
        .agg(F.avg("shift").alias("shift"), F.count("shift").alias("pairs"))
        .select(*PIXEL, "shift", (F.col("shift") * F.lit(mm_per_px * frames_per_s)).alias("velocity"), "pairs")
    )


def edge_padded(df: DataFrame, shape: DataFrame, pad: int) -> DataFrame:
    """Repeat the border cells ``pad`` times outwards. ``shape(case_id, ny, nx)`` is small and
    stored, so its join is a broadcast. ``_src_y``/``_src_x`` keep the original position."""
    out = df.join(shape.select("case_id", "ny", "nx"), "case_id")
    for dim, size in (("y", F.col("ny")), ("x", F.col("nx"))):
        low = F.when(F.col(dim) == 0, F.lit(-pad)).otherwise(F.col(dim))
        high = F.when(F.col(dim) == size - 1, F.col(dim) + pad).otherwise(F.col(dim))
        out = out.withColumn(f"_src_{dim}", F.col(dim)).withColumn(dim, F.explode(F.sequence(low, high)))
    return out.drop("ny", "nx")


def median_filter(df: DataFrame, value: str, k: int, shape: DataFrame, tile: Tile = Tile()) -> DataFrame:
    """k x k median of the values present, k odd, with the border repeated outwards.

    Two windows inside a tile gather the neighbourhood: k values along the row, then k such
    rows. Nothing is copied k^2 times through a shuffle.
    """
    if k < 1 or k % 2 == 0:
        raise ValueError("the median window must be an odd positive number")
    reach = k // 2
    axes = [d for d in ("t", "y", "x") if d in df.columns]
    padded = edge_padded(df.select("case_id", *axes, value), shape, reach)
    tiled = with_rims(padded, {"y": reach, "x": reach}, tile)
    row = line_along(tiled, "x").rangeBetween(-reach, reach)
    tiled = tiled.withColumn("_row", F.collect_list(value).over(row))
    column = line_along(tiled, "y").rangeBetween(-reach, reach)
    tiled = tiled.withColumn("_all", F.sort_array(F.flatten(F.collect_list("_row").over(column))))
    n = F.size("_all")
    middle = (F.element_at("_all", F.floor((n + 1) / 2).cast("int")) + F.element_at("_all", F.floor(n / 2).cast("int") + 1)) / 2
    inside = (F.col("y") == F.col("_src_y")) & (F.col("x") == F.col("_src_x"))
    return tiled.filter(F.col("_own") & inside).select(
        "case_id", *axes, F.when(n > 0, middle).alias(value)
    )
