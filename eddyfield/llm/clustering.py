"""K-means on whole numbers with a threshold search for the nearest centroid.

Every dimension has the list of all centroids in the order of their value there. A vector walks
each list outward from its own value, nearer side first. A centroid that turns up in any list gets its
exact distance. The squared gaps to the next entries, the frontier, add up to a bound below every
centroid that has not turned up yet; the walk stops when that sum strictly exceeds the best exact
distance, so that equally near centroids of a smaller number are still found.

The vectors are settled once as whole numbers; every round is one scan. Tasks hold the centroids (a few
thousand numbers), walk the lists for a thousand vectors at a time, and send one row of sums per
cluster and partition: no vector is shuffled, however large its cluster.

Vectors that are null, of another length, or with a null or non-finite component are left out and have
no row. Repeated rows and repeated ids count each by itself. A row without an id is clustered but does not
start a centroid. Fewer vectors than centroids: as many centroids as vectors with an id; none: no rows.
Components beyond 2^62 count as 2^62; distances and sums beyond a long are given as the largest long.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyfield.llm.vectors import MOST, finite, matrix, top, whole
from eddyfield.session import settle

AT_ONCE = 1024  # vectors that walk together
NARROW = 1 << 27  # below it, sums of squares of a few hundred components fit 64 bits


class Lists:
    """The centroids, and per dimension their values in order."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row, and how many distances were worked out."""
        who, best, looked = [], [], 0
        for start in range(0, len(vectors), AT_ONCE):
            w, b, n = self._walk(vectors[start : start + AT_ONCE])
            who.append(w)
            best.append(b)
            looked += n
        if not who:
            return np.zeros(0, "int64"), np.zeros(0, "int64"), 0
        return np.concatenate(who), np.concatenate(best), looked

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        k, width = self.centroids.shape
        kind = "int64" if top(x, self.centroids) <= NARROW and width <= 512 else object
        x, centroids, values = x.astype(kind), self.centroids.astype(kind), self.values.astype(kind)
        far = MOST if kind == "int64" else 1 << 200
        dims = np.arange(width)
        above = np.stack([np.searchsorted(values[:, j], x[:, j]) for j in dims], axis=1)
        below = above - 1
        who, best = np.zeros(len(x), "int64"), np.full(len(x), far, kind)
        seen, alive, looked = np.zeros((len(x), k), bool), np.arange(len(x)), 0
        while len(alive):
            up = np.where(above < k, values[np.minimum(above, k - 1), dims] - x, far)
            down = np.where(below >= 0, x - values[np.maximum(below, 0), dims], far)
            gap = np.minimum(up, down)
            going = (gap * gap).sum(axis=1) <= best[alive]
            if not going.all():
                alive, x, above, below, seen, up, down = (a[going] for a in (alive, x, above, below, seen, up, down))
                if not len(alive):
                    break
            lower = down <= up
            met = self.order[np.where(lower, below, above), dims]
            below, above = below - lower, above + ~lower
            fresh = np.zeros_like(seen)
            fresh[np.arange(len(alive))[:, None], met] = True
            fresh &= ~seen
            seen |= fresh
            row, number = np.nonzero(fresh)
            looked += len(row)
            table = np.full(seen.shape, far, kind)
            step = x[row] - centroids[number]
            table[row, number] = (step * step).sum(axis=1)
            nearest = table.argmin(axis=1)
            distance = table[np.arange(len(alive)), nearest]
            better = (distance < best[alive]) | ((distance == best[alive]) & (nearest < who[alive]))
            best[alive[better]], who[alive[better]] = distance[better], nearest[better]
            left = ~seen.all(axis=1)
            if not left.all():
                alive, x, above, below, seen = (a[left] for a in (alive, x, above, below, seen))
        return who, best, looked


def _sums(centroids: np.ndarray):
    """Per partition and cluster: how many vectors, and their sums by component."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        counts, totals = np.zeros(k, "int64"), np.zeros((k, width), object)
        for batch in batches:
            x = matrix(batch.column(0), width)
            who = lists.nearest(x)[0]
            counts += np.bincount(who, minlength=k)
            for start in range(0, len(x), AT_ONCE):  # a thousand numbers below 2^53 fit 64 bits
                part = x[start : start + AT_ONCE]
                kind = "int64" if top(part) < 1 << 53 else object
                sums = np.zeros((k, width), kind)
                np.add.at(sums, who[start : start + AT_ONCE], part.astype(kind))
                totals += sums.astype(object)
        held = np.flatnonzero(counts)
        yield pa.record_batch(
            [
                pa.array(held, pa.int32()),
                pa.array(counts[held], pa.int64()),
                pa.array([[Decimal(int(v)) for v in totals[i]] for i in held], pa.list_(pa.decimal128(38, 0))),
            ],
            ["cluster", "n", "total"],
        )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in batches:
            who, best, _ = lists.nearest(matrix(batch.column(1), centroids.shape[1]))
            held = np.minimum(best, MOST).astype("int64")
            yield pa.record_batch([batch.column(0), pa.array(who, pa.int32()), pa.array(held, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round. A row per cluster comes to the driver."""
    width = centroids.shape[1]
    partial = vectors.select("v").mapInArrow(_sums(centroids), "cluster int, n long, total array<decimal(38,0)>")
    sums = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)])
    after = centroids.copy()
    for row in sums.collect():
        after[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return after


def cluster(
    embeddings: DataFrame,
    centroids: int = 40,
    rounds: int = 5,
    width: int = 64,
    salt: str = "2:",
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Centroids start at the vectors whose ids have the smallest sha256 of ``salt`` and the id.
    """
    kept = embeddings.filter(finite(vector) & (F.size(vector) == width))
    vectors = settle(kept.select(F.col(key).alias("vec_id"), whole(vector).alias("v")), "vectors")
    drawn = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = vectors.filter(F.col("vec_id").isNotNull()).select(drawn.alias("h"), "v").orderBy("h", "v").limit(centroids).collect()
    held = np.array([row["v"] for row in first], "int64").reshape(len(first), width)
    for _ in range(rounds if len(first) else 0):
        after = _moved(vectors, held)
        if (after == held).all():  # further rounds give the same
            break
        held = after
    kind = vectors.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, cluster int, distance long"
    placed = vectors if len(first) else vectors.limit(0)
    placed = settle(placed.select("vec_id", "v").mapInArrow(_assigned(held), shape), "assigned")
    # one row per centroid: small by construction
    digests = [(i, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(held.tolist())]
    named = placed.sparkSession.createDataFrame(digests, "number int, centroid_sha256 string")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    every = sum(int(row["sum"]) for row in sums)
    totals = [(row["cluster"], min(int(row["sum"]), MOST), min(every, MOST)) for row in sums]
    totals = placed.sparkSession.createDataFrame(totals, "number int, cluster_inertia long, inertia long")
    return (
        placed.join(F.broadcast(totals.join(named, "number")), F.col("cluster") == F.col("number"))
        .select(F.col("vec_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    )
