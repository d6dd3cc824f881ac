"""Near duplicates by SimHash, compared exactly in tiles.

A text is its three-word shingles with repeats (ASCII letters lower-cased, words split at ASCII white
space; fewer words are one shingle). A bit of its fingerprint is 1 if it is set in over half of the
shingles' XXH64 (seed 42). Texts link when their fingerprints differ in at most ``RADIUS`` bits.

Equal fingerprints are one point, whatever the number of texts. The points lie in tiles by their population
counts, taken over ``PARTS`` equal parts of the 64 bits: each differing bit moves the count of one part by one, so
that tiles whose counts differ by more than the radius in total hold no link and never meet. A tile is
cut by hash into chunks of about ``CHUNK`` points. Chunks travel packed to the tiles within the radius, by an
equi-join on the tile, and are compared point by point with exclusive-or and bit counts. A task keeps,
of the links between two chunks, a star per connected group: families of near copies give as many rows as
they have members. Rounds of joins turn the stars into components.

The number of comparisons grows with the square of the distinct fingerprints, over a fixed factor: of
random points about one pair in fifty shares tiles within the radius.

A null, empty or blank text has the fingerprint zero and is linked like any other. Rows without a doc_id get a
fingerprint and the component of its other rows, of which they are never the smallest. Repeated ids count each by
itself. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyfield.llm.components import components
from eddyfield.session import settle

WIDTH = 3
SEED = 42
RADIUS = 3
PARTS = 4
CHUNK = 2048
HASHED_AT_ONCE = 65_536  # shingles


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The fingerprint as an unsigned number; shingles are hashed in runs of a bounded size."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[min(width, len(words)) - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, "int64")
    for low in range(0, len(ends), HASHED_AT_ONCE):
        run = [hashed(joined[a:b], SEED) for a, b in zip(starts[low:], ends[low : low + HASHED_AT_ONCE])]
        bits = np.unpackbits(np.array(run, "<u8").view("uint8").reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype="int64")
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(np.array(prints, "uint64").view("int64"))], ["doc_id", "fp"])


def _tile(fp: Column) -> list[Column]:
    """Population counts of the parts."""
    bits = 64 // PARTS
    part = F.lit((1 << bits) - 1)
    return [F.bit_count(F.shiftrightunsigned(fp, i * bits).bitwiseAND(part)) for i in range(PARTS)]


def _number(counts: list[Column]) -> Column:
    """A tile's counts as one number."""
    out = F.lit(0)
    for c in counts:
        out = out * F.lit(256) + c
    return out.cast("long")


def _steps() -> list[tuple[int, ...]]:
    """Ways from a tile to those within the radius; of a way and its opposite only one, and to itself."""
    every = itertools.product(range(-RADIUS, RADIUS + 1), repeat=PARTS)
    return [s for s in every if sum(map(abs, s)) <= RADIUS and s >= (0,) * PARTS]


def linked(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the connected groups between two chunks: (member, centre). ``same``: the two are one chunk."""
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= RADIUS)
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return a[:0], a[:0]
    nodes, ends = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    u, v = ends[: len(i)], ends[len(i) :]
    label = np.arange(len(nodes))
    while True:  # the smallest label spreads along the links, and along labels
        before = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        label = label[label]
        if (label == before).all():
            break
    member = label != np.arange(len(nodes))
    return nodes[member], nodes[label[member]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = [], []
        for mine, theirs, same in zip(*(c.to_pylist() for c in batch.columns)):
            member, centre = linked(np.frombuffer(mine, "<u8"), np.frombuffer(theirs, "<u8"), same)
            u.append(member.view("int64"))
            v.append(centre.view("int64"))
        if u:
            yield pa.record_batch([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["a", "b"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("points"))
        flat, cuts = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        held = [flat[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
        yield pa.record_batch([*batch.columns[:-1], pa.array(held, pa.binary())], [*batch.schema.names[:-1], "points"])


def chunks(points: DataFrame) -> DataFrame:
    """(tile, p0 ..., chunk, points): about ``CHUNK`` fingerprints each, packed, whatever a tile holds."""
    counts = [c.alias(f"p{i}") for i, c in enumerate(_tile(F.col("fp")))]
    placed = points.select("fp", *counts)
    names = [f"p{i}" for i in range(PARTS)]
    sizes = placed.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("pieces"))
    cut = placed.join(sizes, names).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("pieces")))
    gathered = cut.groupBy(*names, "chunk").agg(F.collect_list("fp").alias("points"))
    numbered = gathered.select(_number([F.col(n) for n in names]).alias("tile"), *names, "chunk", "points")
    shape = "tile long, " + ", ".join(f"{n} int" for n in names) + ", chunk long, points binary"
    return settle(numbered.mapInArrow(_packed, shape), "chunks")


def links(points: DataFrame) -> DataFrame:
    """(a, b) of fingerprints, which connect the same as all links between them do."""
    tiles = chunks(points)
    steps = F.array(*[F.array(*[F.lit(d) for d in s]) for s in _steps()])
    sent = tiles.withColumn("step", F.explode(steps))
    moved = [F.col(f"p{i}") + F.col("step")[i] for i in range(PARTS)]
    inside = F.lit(True)
    for m in moved:
        inside = inside & m.between(0, 64 // PARTS)
    sent = sent.filter(inside).select(_number(moved).alias("to"), F.col("tile").alias("from"), F.col("chunk").alias("part"), F.col("points").alias("mine"))
    met = sent.join(tiles.select("tile", "chunk", "points"), F.col("to") == F.col("tile"))
    met = met.filter((F.col("from") != F.col("tile")) | (F.col("part") <= F.col("chunk")))  # within a tile each pair of chunks once
    same = (F.col("from") == F.col("tile")) & (F.col("part") == F.col("chunk"))
    return met.select("mine", "points", same.alias("same")).mapInArrow(_compared, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component is its smallest doc_id."""
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    prints = settle(read.mapInArrow(_fingerprints, f"doc_id {kind}, fp long"), "fingerprints")
    points = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    groups = settle(components(settle(links(points), "stars")), "groups")
    whole = points.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    named = settle(whole.join(smallest, "component").select(F.col("fp").alias("point"), "component_id"), "named")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, F.col("fp") == F.col("point")).select("doc_id", shown.alias("fingerprint"), "component_id")
