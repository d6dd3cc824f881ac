"""Near duplicates by an exact Jaccard join of word shingles over a tree of count vectors.

A text is the set of its distinct five-word shingles (ASCII letters lower-cased, words split at
ASCII white space; fewer words are one shingle). Shingles are hashed into groups and a set is a
point whose coordinates are its counts per group. Two sets share at most the sum over all groups of
the smaller count, and a link of similarity s needs ``s * max(size)`` shared shingles.

A tree of nested boxes cannot separate such points: unrelated texts lie about as near to each
other in every few coordinates as related ones. The tree here has two levels instead.

* The directory works on the finest groups, the 64-bit shingle hashes, taken in one order: common
  ones last. A point is placed in the box of every coordinate among its first ``n - need + 1``. The
  sum of minima over the coordinates after those is below ``need``, so that points without a common
  box cannot link. The directory is a shuffle of packed arrays.
* Within a box, points meet in pairs; ``GROUPS`` coarse coordinates bound the overlap by the sum of
  minima. Pairs that pass meet again in fine coordinates, two to four times as many as the text has shingles: a
  coarse coordinate is the sum of the fine ones below it, so that texts of any two sizes compare at the finer
  level that both have. Unrelated texts, which coarse sums cannot tell apart when they are long, stay far
  below the need there. Only pairs that pass both bounds have their texts read and are verified on the full sets.

A box with more than ``PAIRED`` points is not paired out. Its points are compared with one pivot,
the point that lies in most of such boxes: of a family of copies that is the one with the fewest changes.
Those that are not connected with it get another pivot, for ``ROUNDS`` rounds. Whoever is alone after
that is compared with the rest, in the box of the first coordinate that two points share: what each has from there
on bounds what they share, so that points with many coordinates of their own before it do not meet. Links that cannot change a component are not verified. All of this
is exact: no candidate is dropped.

A null doc_id has no component (null) and links with nothing; rows of one doc_id are one document
if their texts are equal and link by either text if not. A null or empty text has no shingle and
is its own component. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from eddyfield.llm.common import sieve
from eddyfield.llm.components import components
from eddyfield.session import rows_per_batch, settle

WORDS_PER_SHINGLE = 5
PERCENT = 80
GROUPS = 64
PAIRED = 8
COMMON = 64  # a shingle in more texts than this is common ...
MOST_COMMON = 500_000  # ... or in so many that there cannot be more than this number of them
COUNTED_TOGETHER = 4_000_000  # shingles
KEYS_PER_TASK = 500_000
KEYS_PER_ROUND = 500_000  # leading coordinates that a task holds before it sends them
ROWS_PER_BATCH = 1000  # texts that go to Python at once
HELD = 16_000_000  # bytes of sets or counts that a task remembers
ROUNDS = 1

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype="uint64")


class _Hashes(dict):
    """Hashes of words, the first ``MOST`` remembered: the frequent ones are among them."""

    MOST = 50_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.MOST:
            self[word] = value
        return value


class _Held(dict):
    """Arrays by point, forgotten when they fill ``HELD`` bytes: pivots and neighbours in the sort come again soon."""

    size = 0

    def __setitem__(self, point: int, value: np.ndarray) -> None:
        if self.size + value.nbytes > HELD:
            self.clear()
            self.size = 0
        self.size += value.nbytes
        super().__setitem__(point, value)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, hashes: dict | None = None, width: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, "uint64")
    hashes = _Hashes() if hashes is None else hashes
    h = np.fromiter(map(hashes.__getitem__, words), "uint64", len(words))
    size = min(width, len(h))
    total = np.full(len(h) - size + 1, size, "uint64")
    for k in range(size):  # the hashes of words are mixed well; odd factors tell their places apart
        total += h[k : len(h) - size + 1 + k] * _ODD[k]
    return np.unique(_mixed(total))


def point_of(s: np.ndarray) -> int:
    """The identity of a set: one hash over all its shingles."""
    return int(np.bitwise_xor.reduce(_mixed(s + _ODD[3])).view("int64")) if len(s) else 0


class Common:
    """The common coordinates by their sorted short forms, with a sieve in front of the exact search,
    and how often each was counted."""

    def __init__(self, short: np.ndarray, times: np.ndarray):
        self.short, self.times = short, times
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[short >> np.uint32(12)] = True

    def frequency(self, s: np.ndarray) -> np.ndarray:
        """0 for coordinates that are not common."""
        out = np.zeros(len(s), "int64")
        if len(self.short):
            short = _short(s)
            maybe = np.flatnonzero(self.sieve[short >> np.uint32(12)])
            at = np.minimum(np.searchsorted(self.short, short[maybe]), len(self.short) - 1)
            out[maybe] = np.where(self.short[at] == short[maybe], self.times[at], 0)
        return out


def fine_counts(s: np.ndarray) -> bytes:
    """Counts per fine group, compressed; the groups are the lowest bits, as those of the coarse counts are. Empty
    when a count does not fit a byte: such a point passes."""
    groups = max(GROUPS, 1 << (2 * len(s)).bit_length())
    counts = np.bincount((s & np.uint64(groups - 1)).astype("int64"), minlength=groups)
    return zlib.compress(counts.astype("uint8").tobytes(), 1) if counts.max() < 256 else b""


def lead(n: int) -> int:
    """How many leading coordinates place a point of ``n`` shingles."""
    return n - (PERCENT * n + 99) // 100 + 1


def _leading(s: np.ndarray, common: Common | None = None) -> np.ndarray:
    """The leading coordinates of a point; the common ones come last, the commonest at the end."""
    if common is not None:
        times = common.frequency(s)
        if times.any():
            s = s[np.argsort(times, kind="stable")]
    return s[: lead(len(s))]


def _short(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(13)).astype("uint32")


def _texts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that come twice or more, in order, and how often each. Sorts ``keys`` in place: of millions of them
    nothing larger than they are is held beside them."""
    keys.sort()
    same = np.zeros(len(keys) + 1, bool)  # as the one before
    same[1:-1] = keys[1:] == keys[:-1]
    first = np.flatnonzero(~same[:-1] & same[1:])
    last = np.flatnonzero(same[:-1] & ~same[1:])
    return keys[first], last - first + 1


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows without one that hold, of the shingles of many documents together, the
    short forms that come twice or more (``counts``: how often, ``keys``: which)."""
    hashes, seen, waiting, size = _Hashes(), set(), [], 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n", "point", "counts", "fine", "keys"])

    def repeated() -> pa.RecordBatch:
        keys = np.concatenate([*waiting, np.zeros(0, "uint32")])
        waiting.clear()
        seen.clear()
        keys, times = _repeated(keys)
        return batch_of([(None, -1, None, times.tobytes(), None, keys.tobytes())])

    for ids, texts in _texts(batches):
        out = []
        for doc, text in zip(ids, texts):
            s = shingles(text, hashes)
            point = point_of(s)
            counts = np.bincount((s % np.uint64(GROUPS)).astype("int64"), minlength=GROUPS).astype("int32")
            out.append((doc, len(s), point, counts.tobytes(), fine_counts(s), None))
            if point not in seen:
                seen.add(point)
                waiting.append(_short(s))
                size += len(s)
            if size > COUNTED_TOGETHER:
                size = 0
                yield repeated()
        yield batch_of(out)
    yield repeated()


POINT = "doc_id long, n long, point long, counts binary, fine binary, keys binary"


def points(docs: DataFrame) -> DataFrame:
    """One settled row per document: size, identity of the set, coarse and fine counts; and the rows of
    repeated shingles, whose ``n`` is -1."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return settle(rows.mapInArrow(_points, POINT), "points")


def _packed(parts: list[tuple[np.ndarray, ...]], bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Columns of numbers, cut by bucket, as one row of bytes per bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    runs = np.split(order, edges) if len(order) else []
    arrays = [pa.array([int(bucket[r[0]]) for r in runs], pa.int32())]
    arrays += [pa.array([c[r].tobytes() for r in runs], pa.binary()) for c in parts]
    yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "keys", "ids", "places"])


def common_boxes(repeated: DataFrame, total: int) -> Common:
    """Short forms of the shingles that many texts hold, counted over all texts. One that is so common
    comes often in any few million shingles, and only what comes twice there is sent. They are at most
    ``MOST_COMMON``, and so may pass through the driver: the ``total`` shingles have no room for more."""
    least = max(COMMON, total // MOST_COMMON)

    def unpack(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "uint32").astype("int64")
            times = np.frombuffer(b"".join(batch.column(0).to_pylist()), "int64")
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], names=["key", "times"])

    sums = repeated.select("counts", "keys").mapInArrow(unpack, "key long, times long").groupBy("key").agg(F.sum("times").alias("times"))
    found = sums.filter(F.col("times") > least).toPandas().sort_values("key")
    return Common(found["key"].to_numpy(dtype="int64").astype("uint32"), found["times"].to_numpy(dtype="int64"))


def candidates(docs: DataFrame, common: Common, total: int) -> DataFrame:
    """Settled rows: pairs of points of small boxes (kind 0, a, b) and members of large ones
    (kind 1, box, point, place): the place of the box among the coordinates of the point."""
    buckets = max(1, -(-total // KEYS_PER_TASK))
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def send(batches):
        hashes, last = _Hashes(), shared.value
        seen, size = {}, 0

        def sent():
            keys = np.concatenate(list(seen.values()))
            ids = np.repeat(np.fromiter(seen, "int64", len(seen)), [len(v) for v in seen.values()])
            places = np.concatenate([np.arange(len(v), dtype="int32") for v in seen.values()])
            seen.clear()
            # common boxes are spread by point: they are not matched there
            by = np.where(last.frequency(keys) > 0, ids.view("uint64"), keys >> np.uint64(7))
            return _packed([keys, ids, places], (by % np.uint64(buckets)).astype("int32"))

        for _, texts in _texts(batches):
            for text in texts:
                s = shingles(text, hashes)
                point = point_of(s)
                if len(s) and point not in seen:
                    seen[point] = _leading(s, last).copy()  # not a view, which would hold all of the set
                    size += len(seen[point])
                if size > KEYS_PER_ROUND:
                    size = 0
                    yield from sent()
        if seen:
            yield from sent()

    def meet(batches):
        keys, ids, places = [], [], []
        for batch in batches:
            keys += batch.column(1).to_pylist()
            ids += batch.column(2).to_pylist()
            places += batch.column(3).to_pylist()
        key = np.frombuffer(b"".join(keys), "uint64")
        del keys
        point = np.frombuffer(b"".join(ids), "int64")
        del ids
        place = np.frombuffer(b"".join(places), "int32")
        del places
        order = np.lexsort((point, key))
        key, point = key[order], point[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (point[1:] != point[:-1])
        key, point, place = key[new], point[new], place[order[new]]
        del order, new
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, "int64")
        sizes = np.diff(np.append(begins, len(key)))
        size = np.repeat(sizes, sizes)
        large = (shared.value.frequency(key) > 0) | (size > PAIRED)
        pairs = []
        for d in range(1, PAIRED):
            i = np.flatnonzero((key[d:] == key[:-d]) & ~large[d:]) if len(key) > d else np.zeros(0, "int64")
            pairs.append(np.column_stack([point[i], point[i + d]]))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        members = np.column_stack([key[large].view("int64"), point[large]])
        kind = np.repeat([0, 1], [len(pairs), len(members)])
        both = np.concatenate([pairs, members])
        at = np.concatenate([np.zeros(len(pairs), "int32"), place[large]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(at)], names=["kind", "a", "b", "place"]
        )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL")
    packed = rows.mapInArrow(send, "bucket int, keys binary, ids binary, places binary").repartition(buckets, "bucket")
    return settle(packed.mapInArrow(meet, "kind int, a long, b long, place int"), "boxes")


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sum of coordinate minima reaches the required overlap."""
    for batch in batches:
        a, b, na, nb, ca, cb = (batch.column(i) for i in range(6))
        if not batch.num_rows:
            continue
        na, nb = na.to_numpy(), nb.to_numpy()
        ca, cb = (np.frombuffer(b"".join(c.to_pylist()), "int32").reshape(-1, GROUPS) for c in (ca, cb))
        most = np.minimum(ca, cb).sum(axis=1)
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(100 * most >= PERCENT * (na + nb - most)))


def _finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_bounded``, in the finer coordinates."""
    held = _Held()

    def of(point: int, packed: pa.Scalar) -> np.ndarray:
        if point not in held:
            held[point] = np.frombuffer(zlib.decompress(packed.as_py()), "uint8")
        return held[point]

    for batch in batches:
        a, b, na, nb, fa, fb = batch.columns
        keep = []
        for i, (p, q, n) in enumerate(zip(a.to_pylist(), b.to_pylist(), (na.to_numpy() + nb.to_numpy()).tolist())):
            if not len(fa[i].as_py()) or not len(fb[i].as_py()):
                keep.append(True)
                continue
            x, y = of(p, fa[i]), of(q, fb[i])
            groups = min(len(x), len(y))
            most = int(np.minimum(x.reshape(-1, groups).sum(axis=0, dtype="int32"), y.reshape(-1, groups).sum(axis=0, dtype="int32")).sum())
            keep.append(100 * most >= PERCENT * (n - most))
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def bounded(pairs: DataFrame, where: DataFrame) -> DataFrame:
    """The pairs (a, b) of points that pass both bounds, settled; ``where`` has (point, n, counts, fine)."""
    left = where.select(F.col("point").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    right = where.select(F.col("point").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    near = pairs.join(left.select("a", "na"), "a").join(right.select("b", "nb"), "b")
    near = near.filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")).select("a", "b")
    full = near.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ca", "cb")
    passed = settle(full.mapInArrow(_bounded, "a long, b long"), "coarse")
    left = where.select(F.col("point").alias("a"), F.col("n").alias("na"), F.col("fine").alias("fa"))
    right = where.select(F.col("point").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("fb"))
    full = passed.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "fa", "fb")
    # settled, so that no task runs the workers of this step and of the next one at once
    return settle(full.mapInArrow(_finely, "a long, b long"), "bounded")


def needed_texts(docs: DataFrame, found: DataFrame, reps: DataFrame, needed: DataFrame) -> DataFrame:
    """(doc_id, point, text), compressed, of the points that ``needed`` names and a few more, settled.
    The point is null where the doc_id has one text only, which then needs no hashing.

    A bitmap of fixed size keeps most other texts out, so that no text is shuffled here; the joins
    to come are exact."""
    wanted = settle(reps.join(needed, "point", "left_semi").select("doc_id"), "needed")
    several = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("point").alias("low"), F.max("point").alias("high")).filter("low <> high")

    def pack(batches):
        hashes = _Hashes()
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            own = [point_of(shingles(t, hashes)) if many else None for t, many in zip(raw, batch.column(2).to_pylist())]
            texts = [zlib.compress(t or b"", 1) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "point", "text"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    likely = rows.filter(sieve(wanted, "doc_id")(F.col("doc_id")) & F.col("doc_id").isNotNull())
    likely = likely.withColumn("many", sieve(several, "doc_id")(F.col("doc_id")))
    return settle(likely.mapInArrow(pack, "doc_id long, point long, text binary"), "texts")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, sets = _Hashes(), _Held()

    def of(point: int, text: pa.Scalar) -> np.ndarray:
        if point not in sets:
            sets[point] = shingles(zlib.decompress(text.as_py()), hashes)
        return sets[point]

    for batch in batches:
        a, b, ta, tb = batch.columns
        keep = []
        for i, (p, q) in enumerate(zip(a.to_pylist(), b.to_pylist())):
            x, y = of(p, ta[i]), of(q, tb[i])
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of points that link, each point read from the text that stands for it."""
    ids = reps.select("point", "doc_id")
    named = pairs.join(ids.withColumnsRenamed({"point": "a", "doc_id": "da"}), "a").join(ids.withColumnsRenamed({"point": "b", "doc_id": "db"}), "b")
    left = texts.select(F.col("doc_id").alias("da"), F.col("point").alias("pa"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("db"), F.col("point").alias("pb"), F.col("text").alias("tb"))
    # of a doc_id with several texts, only the one of the point
    both = named.join(left, "da").filter("pa IS NULL OR pa = a").join(right, "db").filter("pb IS NULL OR pb = b").select("a", "b", "ta", "tb")
    return settle(both.mapInArrow(_verified, "a long, b long"), "links")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) whose points are not in one component yet."""
    la = labels.select(F.col("node").alias("a"), F.col("component").alias("pa"))
    lb = labels.select(F.col("node").alias("b"), F.col("component").alias("pb"))
    known = pairs.join(la, "a", "left").join(lb, "b", "left")
    return known.filter(F.coalesce("pa", "a") != F.coalesce("pb", "b")).select("a", "b")


def _pivots(members: DataFrame) -> DataFrame:
    """(box, pivot): the heaviest member of each box."""
    return members.groupBy("box").agg(F.max_by("point", "w").alias("pivot"))


def _placed(leaves: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of large boxes with their component, and whether it is another than that of the pivot."""
    of_point = labels.select(F.col("node").alias("point"), F.col("component").alias("mine"))
    of_pivot = labels.select(F.col("node").alias("pivot"), F.col("component").alias("its"))
    both = leaves.join(of_point, "point", "left").join(of_pivot, "pivot", "left")
    of = F.coalesce("mine", "point")
    return both.select("box", "point", "place", "n", "w", of.alias("of"), (of != F.coalesce("its", "pivot")).alias("alone"))


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points of the documents, one row each, and (node, component) of the points that link."""
    with rows_per_batch(docs.sparkSession, ROWS_PER_BATCH):
        return _linked(docs)


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = points(docs)
    found = both.filter("n >= 0").drop("keys")
    linkable = found.filter("doc_id IS NOT NULL AND n > 0")
    total, leading = linkable.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.floor(F.col("n") * (100 - PERCENT) / 100) + 1), F.lit(0)).cast("long")
    ).first()
    members = linkable.groupBy("point").agg(F.min("doc_id").alias("doc_id"))
    reps = settle(found.join(members, ["point", "doc_id"]).dropDuplicates(["point"]), "reps")
    common = common_boxes(both.filter("n < 0"), total)
    boxes = candidates(docs, common, leading)

    inside = boxes.filter("kind = 1").select(F.col("a").alias("box"), F.col("b").alias("point"), "place")
    weights = inside.groupBy("point").agg(F.count(F.lit(1)).alias("w"))
    leaves = settle(inside.join(weights, "point").join(reps.select("point", "n"), "point"), "leaves")
    leaves = settle(leaves.join(_pivots(leaves), "box"), "pivots")
    stars = leaves.filter("point <> pivot").select(F.col("pivot").alias("a"), F.col("point").alias("b"))
    small = boxes.filter("kind = 0").select("a", "b")
    pairs = bounded(small.union(stars).distinct(), reps)

    named = pairs.select(F.col("a").alias("point")).union(pairs.select("b")).union(leaves.select("point")).distinct()
    texts = needed_texts(docs, found, reps, named)
    links = verified(pairs, reps, texts)  # few: the fine counts have left little but links
    labels = settle(components(links), "labels")
    for k in range(ROUNDS):
        placed = _placed(leaves, labels)
        again = _pivots(placed.filter("alone").withColumn("w", F.xxhash64("point", F.lit(k))))
        if again.isEmpty():
            break
        stars = placed.join(again.withColumnRenamed("pivot", "a"), "box").select("a", F.col("point").alias("b"))
        links = links.union(verified(bounded(_apart(stars.distinct(), labels), reps), reps, texts))
        labels = settle(components(links), "labels")
    # whoever is not with the first pivot now meets all the others of the box
    placed = settle(_placed(leaves, labels), "placed")
    # whose first common coordinate the box is: what both have from there on must be enough
    left = F.col("n") - F.col("place")
    lone = placed.filter("alone").select("box", F.col("point").alias("p"), F.col("of").alias("of_p"), F.col("n").alias("np"), left.alias("lp"))
    rest = placed.select("box", F.col("point").alias("q"), F.col("of").alias("of_q"), F.col("n").alias("nq"), left.alias("lq"), "alone")
    may = (F.col("of_p") != F.col("of_q")) & (~F.col("alone") | (F.col("p") < F.col("q")))
    enough = (100 + PERCENT) * F.least("lp", "lq") >= PERCENT * (F.col("np") + F.col("nq"))
    others = lone.join(rest, (lone["box"] == rest["box"]) & may & enough).select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()
    links = links.union(verified(bounded(others, reps), reps, texts))
    return found, settle(components(links), "labels")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    return _groups(*linked(docs))


def _groups(found: DataFrame, labels: DataFrame) -> DataFrame:
    linkable = found.filter("doc_id IS NOT NULL AND n > 0")
    # from points to documents: equal sets are one point, and a doc_id with several sets joins them
    of_point = linkable.select("doc_id", "point").join(labels, F.col("point") == F.col("node"), "left")
    of_point = of_point.select("doc_id", F.coalesce("component", "point").alias("cluster"))
    clusters = of_point.groupBy("cluster").agg(F.min("doc_id").alias("least"))
    placed = of_point.join(clusters, "cluster").select("doc_id", "least").distinct()
    several = placed.groupBy("doc_id").agg(F.min("least").alias("low"), F.max("least").alias("high")).filter("low <> high")
    joined = components(placed.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    least = placed.groupBy("doc_id").agg(F.min("least").alias("least"))
    final = least.join(joined, F.col("least") == F.col("node"), "left").select("doc_id", F.coalesce("component", "least").alias("component_id"))
    return (
        found.select("doc_id", "n")
        .join(final, "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id, in one row
    for each of its texts that are no near copies of each other; all rows without an id. The columns are
    those of ``docs``.

    Groups are folded to a list of ids to drop; only rows that repeat a doc_id need an order, which
    is taken among the few rows of such ids.
    """
    found, labels = linked(docs)
    groups = settle(_groups(found, labels).select(F.col("doc_id").alias("__near_id"), F.col("component_id").alias("_of")), "groups")
    ids = groups.filter("__near_id IS NOT NULL").groupBy("__near_id").agg(F.min("_of").alias("_of"), F.count(F.lit(1)).alias("_rows"))
    gone = settle(ids.filter("__near_id <> _of").select("__near_id"), "gone")
    # only texts whose id may be in the list are shuffled to it
    number = docs["doc_id"].cast("long")
    maybe = sieve(gone, "__near_id")(number)
    kept = docs.filter(~maybe).unionByName(docs.filter(maybe).join(gone, number == F.col("__near_id"), "left_anti"))
    repeated = settle(ids.filter("__near_id = _of AND _rows > 1").select("__near_id"), "repeated")
    if repeated.isEmpty():
        return kept
    # rows that share a doc_id are one document, of which the first row of every cluster of texts stays
    once = kept.join(repeated, kept["doc_id"].cast("long") == F.col("__near_id"), "left_anti")
    twice = kept.join(repeated, kept["doc_id"].cast("long") == F.col("__near_id"), "left_semi")
    named = twice.withColumn("__point", _point_of_text(F.col("text").cast("string")))
    named = named.join(labels, F.col("__point") == F.col("node"), "left").withColumn("__cluster", F.coalesce("component", "__point"))
    order = Window.partitionBy(F.col("doc_id").cast("long"), "__cluster").orderBy(F.col("text").cast("string"))
    first = named.withColumn("__place", F.row_number().over(order)).filter("__place = 1")
    return once.unionByName(first.select(*[first[c] for c in docs.columns]))


@F.pandas_udf(LongType())
def _point_of_text(texts: pd.Series) -> pd.Series:
    hashes = _Hashes()
    return pd.Series([point_of(shingles(t.encode() if t else None, hashes)) for t in texts], dtype="int64")
