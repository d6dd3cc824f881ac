"""Linear interpolation between scattered points: a Delaunay triangulation per frame as a table.

The plane of a frame is cut into square tiles. A task triangulates one tile with a rim of its neighbours' points and
hands out the triangles whose circumcircle has its centre in the tile and lies within the rim: no point outside can
change them. What is left, the hull and the rims of large gaps, belongs to the points on the border of the triangles
found; these few are triangulated once more per frame, and of that the part beyond the border is kept.

Points on one circle, as on any regular mesh, would leave the choice of a diagonal open. Every point is therefore
triangulated a millionth of the spacing away from its place, by a hash of its coordinates, so that all tiles agree.
Weights are worked out at the true places: nodes give their own values, and linear fields are exact.

Triangles and targets meet in square cells. A triangle lies in the cells of about its own size, four at most, and a
target looks into one cell per size in use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyfield.session import settle

FRAME = ["case_id", "t"]
TILE = 512  # points, on average over a frame
WHOLE = 2048  # points that are triangulated without tiles
RIM = 0.25  # of a tile's side
JITTER = 1e-6  # of the mean spacing
FLAT = 8  # jitters: a lower triangle is an artefact of the jitter
INSIDE = -1e-9  # least weight of a target that counts as inside
TRIANGLE = "case_id string, t int, a long, b long, c long"


def delaunay(x: list[float], y: list[float]) -> list[tuple[int, int, int]]:
    """Triangles, counter-clockwise, of points in general position. One point after the other, in strips: the triangles
    whose circumcircle it lies in are cleared and the hole is filled with a fan. Vertex -1 stands beyond the hull."""
    if len(x) < 3:
        return []
    apex: dict[tuple[int, int], int] = {}

    def turn(a: int, b: int, p: int) -> float:
        return (x[b] - x[a]) * (y[p] - y[a]) - (y[b] - y[a]) * (x[p] - x[a])

    def put(a: int, b: int, c: int) -> None:
        apex[a, b], apex[b, c], apex[c, a] = c, a, b

    def clear(a: int, b: int, c: int) -> None:
        del apex[a, b], apex[b, c], apex[c, a]

    def hit(a: int, b: int, c: int, p: int) -> bool:
        if a == -1:
            return turn(b, c, p) > 0
        if b == -1:
            return turn(c, a, p) > 0
        if c == -1:
            return turn(a, b, p) > 0
        ax, ay, bx, by, cx, cy = x[a] - x[p], y[a] - y[p], x[b] - x[p], y[b] - y[p], x[c] - x[p], y[c] - y[p]
        aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return ax * (by * cc - cy * bb) - ay * (bx * cc - cx * bb) + aa * (bx * cy - cx * by) > 0

    strips = max(1, int((len(x) / 2) ** 0.5))
    low, high = min(x), max(x)
    width = (high - low) / strips or 1.0
    strip = [min(strips - 1, int((v - low) / width)) for v in x]
    order = sorted(range(len(x)), key=lambda i: (strip[i], y[i] if strip[i] % 2 == 0 else -y[i]))
    a, b = order[:2]
    third = max(order[2:], key=lambda i: abs(turn(a, b, i)) / (1.0 + (x[i] - x[a]) ** 2 + (y[i] - y[a]) ** 2))
    if turn(a, b, third) == 0:
        return []
    if turn(a, b, third) < 0:
        a, b = b, a
    put(a, b, third)
    for u, v in ((b, a), (third, b), (a, third)):
        put(u, v, -1)
    at = (a, b)
    for p in order:
        if p in (a, b, third):
            continue
        u, v = at
        w = apex[u, v]
        while -1 not in (u, v, w):  # towards the point, until it lies in the triangle or beyond the hull
            if turn(u, v, p) < 0:
                u, v = v, u
            elif turn(v, w, p) < 0:
                u, v = w, v
            elif turn(w, u, p) < 0:
                u, v = u, w
            else:
                break
            w = apex[u, v]
        clear(u, v, w)
        rim = [(u, v), (v, w), (w, u)]
        while rim:
            u, v = rim.pop()
            w = apex[v, u]
            if hit(v, u, w, p):
                clear(v, u, w)
                rim += [(u, w), (w, v)]
            else:
                put(p, u, v)
                if -1 not in (u, v):
                    at = (p, u)
    return [(a, b, c) for (a, b), c in apex.items() if -1 < a < b and a < c]


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, from sorted batches, with the places where runs begin and the last one ends."""

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for key in keys:
            column = table.column(key).combine_chunks()
            values = (column.dictionary_encode().indices if pa.types.is_string(column.type) else column).to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    def joined(tables: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
        table = pa.concat_tables(tables)
        return table, begins(table)

    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        last = int(begins(table)[-2])
        if last:
            yield joined([*waiting, table.slice(0, last)])
            waiting = [table.slice(last)]
        elif waiting and any(waiting[-1].column(k)[-1] != table.column(k)[0] for k in keys):
            yield joined(waiting)
            waiting = [table]
        else:
            waiting.append(table)
    if waiting:
        yield joined(waiting)


def _named(table: pa.Table, corners: np.ndarray) -> pa.RecordBatch:
    """Triangles by the rows of their corners, as a batch with the numbers of their points."""
    at = pa.array(corners[:, 0])
    ids = table.column("id").to_numpy()
    columns = [table.column(k).take(at).combine_chunks() for k in FRAME] + [pa.array(ids[corners[:, k]]) for k in range(3)]
    return pa.RecordBatch.from_arrays(columns, names=[*FRAME, "a", "b", "c"])


def _turned(parts: list[np.ndarray]) -> np.ndarray:
    """The triangles of all parts, each from its smallest corner on."""
    corners = np.concatenate([np.zeros((0, 3), "int64"), *parts])
    rows, first = np.arange(len(corners)), corners.argmin(axis=1) if len(corners) else np.zeros(0, "int64")
    return np.column_stack([corners[rows, (first + k) % 3] for k in range(3)])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The triangles of each tile that no point beyond its rim can change; the points of a tile come by number."""
    for table, begins in _whole(batches, [*FRAME, "cx", "cy"]):
        x, y, side, cx, cy = (table.column(n).to_numpy() for n in ("px", "py", "side", "cx", "cy"))
        found = [(i, delaunay(x[i:j].tolist(), y[i:j].tolist())) for i, j in zip(begins[:-1], begins[1:])]
        corners = _turned([i + np.array(triangles, "int64") for i, triangles in found if triangles])
        home = corners[:, 0]
        ax, ay = x[corners[:, 0]], y[corners[:, 0]]  # from the smallest id on: the same numbers in every tile
        bx, by = x[corners[:, 1]] - ax, y[corners[:, 1]] - ay
        dx, dy = x[corners[:, 2]] - ax, y[corners[:, 2]] - ay
        double = 2 * (bx * dy - by * dx)
        with np.errstate(divide="ignore", invalid="ignore"):
            ux, uy = (dy * (bx * bx + by * by) - by * (dx * dx + dy * dy)) / double, (bx * (dx * dx + dy * dy) - dx * (bx * bx + by * by)) / double
            radius, mx, my, s = np.sqrt(ux * ux + uy * uy), ax + ux, ay + uy, side[home]
            left, low = cx[home] * s, cy[home] * s
            own = (np.floor(mx / s) == cx[home]) & (np.floor(my / s) == cy[home])
            room = np.minimum.reduce([mx - left, left + s - mx, my - low, low + s - my]) + RIM * s
            kept = own & (radius * (1 + 1e-9) < room)
        yield _named(table, corners[kept])


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The triangles of each frame beyond the border of those found; all where none was found. The points of a frame come
    by number, before its border, whose rows have no ``id``."""
    for table, begins in _whole(batches, FRAME):
        parts = []
        borders = table.column("id").is_null().to_numpy()
        x, y = table.column("px").to_numpy(), table.column("py").to_numpy()
        for i, j in zip(begins[:-1].tolist(), begins[1:].tolist()):
            k = j - int(borders[i:j].sum())
            found = delaunay(x[i:k].tolist(), y[i:k].tolist())
            if k < j:
                place = {name: n for n, name in enumerate(table.column("id").slice(i, k - i).to_pylist())}
                ends = (table.column(n).slice(k, j - k).to_pylist() for n in "uv")
                fence = {(place[u], place[v]) for u, v in zip(*ends)}
                of = {edge: n for n, (a, b, c) in enumerate(found) for edge in ((a, b), (b, c), (c, a))}
                reached, spread = set(), [of[v, u] for u, v in fence if (v, u) in of]
                while spread:
                    n = spread.pop()
                    if n not in reached:
                        reached.add(n)
                        a, b, c = found[n]
                        for u, v in ((a, b), (b, c), (c, a)):
                            if (v, u) not in fence and (v, u) in of:
                                spread.append(of[v, u])
                found = [found[n] for n in sorted(reached)]
            if found:
                parts.append(i + np.array(found, "int64"))
        yield _named(table.set_column(table.schema.get_field_index("id"), "id", table.column("id").fill_null(-1)), _turned(parts))


def _sorted(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The rows of equal keys together and in order, in as many tasks as there are shuffle partitions: the work on them, not
    their size, decides."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order)


def numbered(points: DataFrame, value: str) -> DataFrame:
    """The valid points with a number and a place to be triangulated at; of equal places the smaller value."""
    valid = points.filter(F.col(value).isNotNull() & F.col("x_mm").isNotNull() & F.col("y_mm").isNotNull())
    valid = valid.groupBy(*FRAME, F.col("x_mm").cast("double").alias("x"), F.col("y_mm").cast("double").alias("y")).agg(F.min(value).alias("value"))
    valid = settle(valid.withColumn("id", F.monotonically_increasing_id()), "points")
    area = F.greatest((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")), F.lit(0.0))
    extents = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    n = F.count(F.lit(1))
    spacing = F.greatest(F.sqrt(area / n), extents / n)  # points in a line have no area
    frames = settle(valid.groupBy(*FRAME).agg(n.alias("n"), spacing.alias("h")), "frames")

    def moved(place: str) -> Column:
        noise = F.pmod(F.xxhash64(F.lit(place), "x", "y"), F.lit(1 << 20)) / float(1 << 20) - 0.5
        return F.col(place) + F.lit(JITTER) * F.col("h") * noise

    return settle(valid.join(frames, FRAME).withColumns({"px": moved("x"), "py": moved("y")}), "placed")


def triangulate(placed: DataFrame, tile: int = TILE, whole: int = WHOLE) -> DataFrame:
    """``(case_id, t, a, b, c)``: the Delaunay triangles of every frame, by the numbers of their points."""
    kind = placed.schema["t"].dataType.simpleString()
    tiled = placed.filter(F.col("n") > whole).withColumn("side", F.col("h") * F.lit(float(tile) ** 0.5))
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    spread = tiled.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    inside = F.lit(True)
    for place, step, cell in (("px", "dx", "cx"), ("py", "dy", "cy")):
        spread = spread.withColumn(cell, F.floor(F.col(place) / F.col("side")).cast("long") + F.col(step))
        beyond = F.col(place) - F.col(cell) * F.col("side")
        inside = inside & (beyond >= -RIM * F.col("side")) & (beyond < (1 + RIM) * F.col("side"))
    sent = spread.filter(inside).select(*FRAME, "cx", "cy", "id", "px", "py", "side")
    shape = TRIANGLE.replace("t int", f"t {kind}")
    sent = sent.withColumn("case_id", F.col("case_id").cast("string"))
    found = settle(_sorted(sent, [*FRAME, "cx", "cy"], "id").mapInArrow(_tiles, shape), "found")
    edge = F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (("a", "b"), ("b", "c"), ("c", "a"))])
    edges = found.select(*FRAME, F.explode(edge).alias("e")).select(*FRAME, "e.u", "e.v")
    back = edges.select(*FRAME, F.col("v").alias("u"), F.col("u").alias("v"))
    border = settle(edges.join(back, [*FRAME, "u", "v"], "left_anti"), "border")
    ends = border.select(*FRAME, F.col("u").alias("id")).union(border.select(*FRAME, F.col("v").alias("id")))
    closed = edges.select(*FRAME, F.col("u").alias("id")).join(ends, [*FRAME, "id"], "left_anti").distinct()
    open_points = placed.join(closed, [*FRAME, "id"], "left_anti").select(*FRAME, "id", "px", "py")
    both = open_points.withColumn("case_id", F.col("case_id").cast("string")).unionByName(border, allowMissingColumns=True)
    rest = _sorted(both, FRAME, F.col("id").asc_nulls_last()).mapInArrow(_beyond, shape)
    return settle(found.unionByName(rest), "triangles")


def _cell(place: Column, level: Column) -> Column:
    return F.floor(place / F.pow(F.lit(2.0), level)).cast("long")


def housed(shaped: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Triangles ``(*keys, ax, ay ... cy, *names)``, counter-clockwise, in the cells that they touch, settled. The side of
    the cells is a power of two not below the triangle's own extent."""
    low = {d: F.least(*[f"{n}{d}" for n in "abc"]) for d in "xy"}
    high = {d: F.greatest(*[f"{n}{d}" for n in "abc"]) for d in "xy"}
    shaped = shaped.withColumn("size", F.greatest(high["x"] - low["x"], high["y"] - low["y"])).withColumn("level", F.ceil(F.log2("size")).cast("int"))
    for d in "xy":
        ends = [_cell(place, F.col("level")) for place in (low[d] - 1e-9 * F.col("size"), high[d] + 1e-9 * F.col("size"))]
        shaped = shaped.withColumn(f"g{d}", F.explode(F.sequence(*ends)))
    return settle(shaped.select(*keys, "level", "gx", "gy", *names, *[f"{n}{d}" for n in "abc" for d in "xy"], "double"), "cells")


def containing(wanted: DataFrame, cells: DataFrame, keys: list[str], target: list[str], names: list[str]) -> DataFrame:
    """``(*target, *names, wa, wb, wc)``: for each of ``wanted(*target, x_mm, y_mm)`` the triangle that holds it and the weights of
    its corners. On a common side the one with the larger names is taken."""
    levels = cells.select(*keys, "level").distinct()
    looking = wanted.join(levels, keys).withColumns({f"g{d}": _cell(F.col(f"{d}_mm"), F.col("level")) for d in "xy"})
    met = looking.join(cells, [*keys, "level", "gx", "gy"])

    def weight(u: str, v: str) -> Column:
        """Share of the triangle between the target and the side from u to v."""
        return ((F.col(f"{u}x") - F.col("x_mm")) * (F.col(f"{v}y") - F.col("y_mm")) - (F.col(f"{u}y") - F.col("y_mm")) * (F.col(f"{v}x") - F.col("x_mm"))) / F.col("double")

    met = met.withColumns({"wa": weight("b", "c"), "wb": weight("c", "a"), "wc": weight("a", "b")})
    least = F.least("wa", "wb", "wc")
    best = F.max(F.struct(F.least(least, F.lit(0.0)).alias("least"), *names, "wa", "wb", "wc"))
    held = met.filter(least >= INSIDE).groupBy(*target).agg(best.alias("in"))
    return held.select(*target, *[F.col(f"in.{n}").alias(n) for n in (*names, "wa", "wb", "wc")])


def twice_area() -> Column:
    return (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))


def regrid_triangles(
    points: DataFrame, targets: DataFrame, value: str, fill: float | None = None, tile: int = TILE, whole: int = WHOLE
) -> DataFrame:
    """Value of the scattered valid ``points(case_id, t, x_mm, y_mm, value)`` at ``targets(case_id, t, y, x, x_mm, y_mm)``,
    linear within the triangles. Targets outside all of them, and those of a frame without three points that are not
    in a line, get ``fill``."""
    placed = numbered(points, value)
    corner = {n: placed.select(*FRAME, F.col("id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"), *(["h"] if n == "a" else [])) for n in "abc"}
    shaped = triangulate(placed, tile, whole)
    for n in "abc":
        shaped = shaped.join(corner[n], [*FRAME, n])
    extent = F.greatest(*[F.greatest(*[f"{n}{d}" for n in "abc"]) - F.least(*[f"{n}{d}" for n in "abc"]) for d in "xy"])
    shaped = shaped.withColumn("double", twice_area()).filter(F.col("double") > F.lit(FLAT * JITTER) * F.col("h") * extent)
    cells = housed(shaped, FRAME, ["a", "b", "c"])
    target = [*FRAME, "y", "x"]
    wanted = settle(targets.select(*target, F.col("x_mm").cast("double").alias("x_mm"), F.col("y_mm").cast("double").alias("y_mm")), "targets")
    held = containing(wanted, cells, FRAME, target, ["a", "b", "c"])
    shares = F.array(*[F.struct(F.col(n).alias("id"), F.col(f"w{n}").alias("share")) for n in "abc"])
    parts = held.select(*target, F.explode(shares).alias("p")).select(*target, "p.id", "p.share")
    summed = parts.join(placed.select(*FRAME, "id", "value"), [*FRAME, "id"]).groupBy(*target).agg(F.sum(F.col("share") * F.col("value")).alias("value"))
    filled = F.lit(fill).cast("double")
    return wanted.join(summed, target, "left").select(*target, F.coalesce("value", filled).alias(value))
