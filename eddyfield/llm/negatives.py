"""Hard negatives of embedding vectors, by exact search with coordinate pruning in length buckets.

Rows lie in buckets by length (inner product with itself), at most ``BUCKET`` each; in a bucket the normalised
vectors are listed in order along every coordinate that is asked for. Anchors lie in blocks. A block meets every bucket, and
each anchor of it asks its *wishes*: the best k rows of the same or of another label whose score lies
between two bounds. A score of at least s needs a cosine of at least s over the two lengths, and with
that the value of a normalised vector at any coordinate lies within an angle of the anchor's own. The rows within
these ranges at the anchor's largest (focus) coordinates are intersected, and only they are scored
exactly, in whole numbers.

A first pass over the bucket of the longest rows gives each wish a score that its k-th best reaches at least; the
second pass, over all buckets, prunes by it. Positives come first; their scores bound the wishes for negatives.

Rows without an id, a label or a vector, or with a null or non-finite component, take no part. Shorter vectors count
as filled up with zeros. Repeated ids count each by itself (a second row of an anchor is an *other* row).
Anchors without a positive, and positives without a negative in range, give no rows; so does an empty table.
Scores beyond a long are given as the largest one. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyfield.llm.vectors import MOST, finite, products, top, whole
from eddyfield.session import settle

BUCKET = 4096
BLOCK = 256  # anchors
FOCUS = 6
SLACK = 1e-9  # more than the rounding of lengths, cosines and angles

WISH = "array<struct<anchor:long,wish:int,same:boolean,low:long,high:long,k:int,least:long>>"
FOUND = "anchor long, wish int, row long, vec_id long, score long"


class Bucket:
    """Rows of about the same length and their lists by coordinate."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, vectors
        self.plain, self.reach = vectors.astype("float64"), vectors.shape[1] * top(vectors)
        lengths = np.sqrt((self.plain * self.plain).sum(axis=1))
        self.longest, self.shortest = lengths.max(initial=0.0), lengths.min(initial=np.inf)
        self.unit = self.plain / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def along(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        if coordinate not in self.lists:
            order = np.argsort(self.unit[:, coordinate], kind="stable")
            self.lists[coordinate] = order, self.unit[order, coordinate]
        return self.lists[coordinate]

    def scores(self, places: np.ndarray | None, query: np.ndarray) -> np.ndarray:
        """Exact inner products of the rows at the places, or of all."""
        at = slice(None) if places is None else places
        if self.reach * top(query) < 1 << 53:  # exact in doubles
            return (self.plain[at] @ query.astype("float64")).astype("int64")
        return products(self.vectors[at], query)

    def feasible(self, query: np.ndarray, least: int | None) -> np.ndarray | None:
        """Places of the rows that can score ``least`` or more with the query; None for all of them."""
        length = np.sqrt((query.astype("float64") ** 2).sum())
        other = self.longest if least is not None and least > 0 else self.shortest
        if least is None or not length or not other:
            return self.rows[:0] if least is not None and least > 0 else None
        cosine = least / (length * other) * (1 - SLACK if least > 0 else 1 + SLACK)
        if cosine > 1:
            return np.zeros(0, "int64")
        if cosine <= -1:
            return None
        unit = np.clip(query / length, -1, 1)
        angle = np.arccos(cosine)
        hits = np.zeros(len(self.rows), "uint8")
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        used = 0
        for f in focus:
            own = np.arccos(unit[f])
            low, high = np.cos(min(np.pi, own + angle)) - SLACK, np.cos(max(0.0, own - angle)) + SLACK
            order, values = self.along(int(f))
            start, stop = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            if stop - start < len(order):  # a range of all rows prunes nothing
                hits[order[start:stop]] += 1
                used += 1
        return np.flatnonzero(hits == used) if used else None

    def answers(self, anchor: int, label: int, query: np.ndarray, wishes: list[dict]) -> Iterator[tuple[int, int, int]]:
        """(wish, place, score) of the best rows of this bucket for each wish of one anchor."""
        bounds = [max((x for x in (w["low"], w["least"]) if x is not None), default=None) for w in wishes]
        least = None if None in bounds else min(bounds)
        places = self.feasible(query, least)
        scores = self.scores(places, query)
        places = np.arange(len(self.rows)) if places is None else places
        same = self.labels[places] == label
        for w, bound in zip(wishes, bounds):
            fits = same & (self.rows[places] != anchor) if w["same"] else ~same
            if bound is not None:
                fits &= scores >= bound
            if w["high"] is not None:
                fits &= scores <= w["high"]
            at = np.flatnonzero(fits)
            if len(at) > w["k"]:  # all that reach the k-th best score; ties are broken by id
                edge = np.partition(scores[at], len(at) - w["k"])[len(at) - w["k"]]
                at = at[scores[at] >= edge]
            order = np.lexsort((self.rows[places[at]], self.ids[places[at]]))
            at = at[order]
            at = at[np.argsort(-scores[at], kind="stable")[: w["k"]]]
            yield from ((w["wish"], int(places[i]), int(scores[i])) for i in at)


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, width)


def _packing(names: list[str], size: int, width: int):
    """Rows in the order in which they come, packed by up to ``size``: the named columns, the vectors last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def out(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            vectors = np.zeros((len(rows), width), "<i8")
            for i, v in enumerate(rows["v"].to_pylist()):
                vectors[i, : len(v)] = v
            columns = [rows[n].to_numpy().astype("<i8") for n in names[:-1]]
            return pa.record_batch([pa.array([c.tobytes()], pa.binary()) for c in (*columns, vectors)], names)

        for batch in batches:
            waiting.append(batch)
            held += len(batch)
            while held >= size:
                table = pa.Table.from_batches(waiting)
                yield out(table.slice(0, size))
                waiting, held = table.slice(size).to_batches(), held - size
        if held:
            yield out(pa.Table.from_batches(waiting))

    return run


def _searching(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bucket = None, None
        for batch in batches:
            for pair in batch.to_pylist():
                if pair["bucket"] != number:
                    columns = [np.frombuffer(pair[c], "<i8") for c in ("rows", "ids", "labels")]
                    number, bucket = pair["bucket"], Bucket(*columns, _matrix(pair["vectors"], width))
                place = {int(r): i for i, r in enumerate(np.frombuffer(pair["anchors"], "<i8"))}
                labels, queries = np.frombuffer(pair["anchor_labels"], "<i8"), _matrix(pair["queries"], width)
                asked: dict[int, list[dict]] = {}
                for w in pair["wishes"]:
                    asked.setdefault(w["anchor"], []).append(w)
                found = [
                    (anchor, wish, int(bucket.rows[p]), int(bucket.ids[p]), max(-MOST, min(score, MOST)))
                    for anchor, wishes in asked.items()
                    for wish, p, score in bucket.answers(anchor, int(labels[place[anchor]]), queries[place[anchor]], wishes)
                ]
                if found:
                    yield pa.record_batch(
                        [pa.array(c, pa.int32() if n == "wish" else pa.int64()) for n, c in zip(("anchor", "wish", "row", "vec_id", "score"), zip(*found))],
                        ["anchor", "wish", "row", "vec_id", "score"],
                    )

    return run


class Index:
    """The rows in length buckets and the anchors in blocks, settled."""

    def __init__(self, rows: DataFrame, anchors: Column):
        measured = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
        self.width = max(measured["width"] or 0, 1)
        squared = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
        pieces = max(1, -(-measured["n"] // BUCKET))
        by_length = rows.withColumn("squared", squared).repartitionByRange(pieces, F.desc("squared"), F.xxhash64("row"))
        by_length = by_length.sortWithinPartitions(F.desc("squared"), "row")
        packed = by_length.select(F.col("row").alias("rows"), F.col("vec_id").alias("ids"), F.col("label").alias("labels"), "v").mapInArrow(
            _packing(["rows", "ids", "labels", "vectors"], BUCKET, self.width), "rows binary, ids binary, labels binary, vectors binary"
        )
        self.buckets = settle(packed.withColumn("bucket", F.monotonically_increasing_id()), "buckets")
        blocks = rows.filter(anchors).select(F.col("row").alias("anchors"), F.col("label").alias("anchor_labels"), "v").mapInArrow(
            _packing(["anchors", "anchor_labels", "queries"], BLOCK, self.width), "anchors binary, anchor_labels binary, queries binary"
        )
        self.blocks = settle(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
        self.members = settle(self.blocks.select("block", "anchors").mapInArrow(_members, "block long, anchor long"), "members")

    def search(self, wishes: DataFrame, buckets: DataFrame) -> DataFrame:
        """The best rows in the given buckets for (anchor, wish, same, low, high, k, least)."""
        asked = wishes.join(self.members, "anchor").groupBy("block").agg(
            F.collect_list(F.struct("anchor", "wish", "same", "low", "high", "k", "least")).alias("wishes")
        )
        blocks = self.blocks.join(asked.select(F.col("block").alias("at"), F.col("wishes").cast(WISH)), F.col("block") == F.col("at"))
        numbers = buckets.agg(F.collect_list("bucket").alias("numbers"))  # one number per some thousand rows
        sent = blocks.withColumn("to", F.explode(numbers.scalar()))
        pairs = sent.join(buckets, F.col("to") == F.col("bucket"))
        return pairs.select(
            "bucket", "rows", "ids", "labels", "vectors", "anchors", "anchor_labels", "queries", "wishes"
        ).mapInArrow(_searching(self.width), FOUND)

    def best(self, wishes: DataFrame) -> DataFrame:
        """(anchor, wish, row, vec_id, score, rank): the best k of each wish over all rows."""
        longest = self.buckets.filter(F.col("bucket") == self.buckets.agg(F.min("bucket")).scalar())
        ahead = self.search(wishes.withColumn("least", F.lit(None).cast("long")), longest)
        reached = ahead.groupBy("anchor", "wish").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("reached"))
        held = wishes.join(reached, ["anchor", "wish"], "left").withColumn("least", F.when(F.col("found") >= F.col("k"), F.col("reached")))
        found = self.search(held.drop("found", "reached"), self.buckets)
        order = Window.partitionBy("anchor", "wish").orderBy(F.desc("score"), "vec_id", "row")
        most = wishes.select("anchor", "wish", "k")
        ranked = found.withColumn("rank", F.row_number().over(order)).join(most, ["anchor", "wish"])
        return ranked.filter(F.col("rank") <= F.col("k")).drop("k")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, anchors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = np.frombuffer(anchors, "<i8")
            yield pa.record_batch([pa.array([block] * len(rows), pa.int64()), pa.array(rows)], ["block", "anchor"])


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: (vec_id, label, v) of whole numbers; ``anchors`` says which of them search. Negatives score between
    ``low`` and ``high`` per cent of the positive.
    """
    numbered = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "v").withColumn("row", F.monotonically_increasing_id())
    stored = settle(numbered, "rows")
    index = Index(stored, anchors)
    nothing = F.lit(None).cast("long")
    first = index.members.select(
        "anchor", F.lit(0).alias("wish"), F.lit(True).alias("same"), nothing.alias("low"), nothing.alias("high"), F.lit(positives).alias("k")
    )
    chosen = settle(index.best(first).select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(38,0)")
    share = {"low": F.ceil(score * low / 100), "high": F.floor(score * high / 100)}
    second = chosen.filter("positive_score >= 0").select(
        "anchor",
        F.col("rank").alias("wish"),
        F.lit(False).alias("same"),
        *[v.cast("long").alias(n) for n, v in share.items()],
        F.lit(negatives).alias("k"),
    )
    mined = index.best(second).select(
        "anchor", F.col("wish").alias("of"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    names = stored.filter(anchors).select(F.col("row").alias("at"), F.col("vec_id").alias("anchor_id"))
    return (
        mined.join(chosen.withColumnRenamed("rank", "of"), ["anchor", "of"])
        .join(names, F.col("anchor") == F.col("at"))
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def prepared(embeddings: DataFrame, shifted_every: int = 7, labels: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part; every seventh id has the next label."""
    usable = embeddings.filter(F.col(key).isNotNull() & F.col("label").isNotNull() & finite(vector))
    label = F.col("label").cast("long")
    moved = F.when(F.col(key) % shifted_every == 0, (label + 1) % labels).otherwise(label)
    return usable.select(F.col(key).cast("long").alias("vec_id"), moved.alias("label"), whole(vector).alias("v"))
