"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

A text is a row of words, lower-cased and without the marks around and in them. A seed is an
n-gram of a test item. An item searches with all of its seeds: how common a seed is says nothing
about the document at hand, as an edited item that many documents share has common seeds only.
Where a seed hits, the item is aligned with the words around, and the best local alignment is scored
against a full match. Where the words around hold too few of the item's for the least score, there is
no need to align. Items are taken in blocks of a bounded size, each block against all rows.

A null or empty text matches nothing; a null item text, or an item of fewer than ``SHORTEST`` words,
is not searched for. Items of one text are all reported. Texts are read whole. An empty corpus or
benchmark gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from eddyfield.llm.common import ROWS_PER_BATCH, digests_of, without_texts
from eddyfield.session import rows_per_batch, settle

SEED = 3  # words
SHORTEST = 5
LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
ITEMS_PER_BLOCK = 20_000
MOST_WORDS = 50_000  # words whose hashes a task remembers
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype="uint64")
_MARKS = re.compile(r"[\W_]+")


class _Words(dict):
    """Hash of each word without its marks, 0 if nothing is left; remembered up to a limit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        plain = _MARKS.sub("", word.decode("utf-8", "replace").lower())
        value = self[word] = xxhash.xxh64_intdigest(plain) or 1 if plain else 0
        return value


def words_of(text: bytes | None, table: dict) -> np.ndarray:
    raw = text.split() if text else []
    words = np.fromiter(map(table.__getitem__, raw), "uint64", len(raw))
    return words[words != 0]


def grams_of(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - SEED + 1)
    total = np.full(n, SEED, "uint64")
    for k in range(SEED):
        total = (total ^ words[k : n + k]) * _ODD[0]
        total = total ^ (total >> np.uint64(29))
    return total * _ODD[1]


@dataclass
class Block:
    """Items and the table of their seeds: ``seeds`` in order, with item and place of each."""

    ids: list
    items: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(ids: list, texts: list) -> Block:
        table = _Words()
        kept = [(i, w) for i, t in zip(ids, texts) if len(w := words_of(t.encode() if t else None, table)) >= SHORTEST]
        items = [w for _, w in kept]
        grams = [grams_of(w) for w in items]
        seeds = np.concatenate([*grams, np.zeros(0, "uint64")])
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, "int64")]).astype("int64")
        order = np.argsort(seeds, kind="stable")
        return Block([i for i, _ in kept], items, seeds[order], item[order], place[order])

    def sieve(self) -> np.ndarray:
        """By the upper 20 bits of a seed: whether there may be one."""
        table = np.zeros(1 << 20, bool)
        table[(self.seeds >> np.uint64(44)).astype("int64")] = True
        return table

    def hits(self, words: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the document and the range of seed rows that each of them hits."""
        grams = grams_of(words)
        at = np.flatnonzero(sieve[(grams >> np.uint64(44)).astype("int64")])
        first = np.searchsorted(self.seeds, grams[at], "left")
        last = np.searchsorted(self.seeds, grams[at], "right")
        real = last > first
        return at[real], first[real], last[real]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman with linear gaps: the best score and the place after its last word. A row of
    the matrix is one step; gaps along the row are a running maximum."""
    columns = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, "int64")
    best, end = 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(words == w, MATCH, MISMATCH), row[1:] + GAP)
        new = np.maximum(new, 0)
        row = np.maximum.accumulate(new - GAP * columns) + GAP * columns
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def bound(item: np.ndarray, words: np.ndarray) -> int:
    """At least the score of any local alignment: a word of the item that is not among ``words``
    is a mismatch or a gap of it."""
    total = np.cumsum(np.where(np.isin(item, words), MATCH, max(MISMATCH, GAP)))
    return int((total - np.minimum.accumulate(np.minimum(0, total))).max())


def leaks(words: np.ndarray, block: Block, sieve: np.ndarray, least: float) -> list[tuple]:
    """(item, score, start, stop) of every item that the document holds, its best place each;
    start and stop count words that have letters or digits."""
    at, first, last = block.hits(words, sieve)
    if not len(at):
        return []
    rows = np.concatenate([np.arange(a, b) for a, b in zip(first, last)])
    of = block.item[rows]
    begin = np.repeat(at, last - first) - block.place[rows]
    order = np.lexsort((begin, of))
    of, begin = of[order], begin[order]
    found: dict[int, tuple] = {}
    for begins, i in zip(np.split(begin, cuts := np.flatnonzero(np.diff(of)) + 1), of[[0, *cuts]]):
        item = block.items[i]
        reach = len(item) // 2 + 1
        for cluster in np.split(begins, np.flatnonzero(np.diff(begins) > reach) + 1):
            low, high = max(0, cluster[0] - reach), cluster[-1] + len(item) + reach
            if bound(item, words[low:high]) / (MATCH * len(item)) < least:
                continue
            score, end = align(item, words[low:high])
            share = score / (MATCH * len(item))
            if share >= least and share > found.get(i, (0, 0.0))[1]:
                _, back = align(item[::-1], words[low : low + end][::-1])
                found[i] = (block.ids[i], share, int(low + end - back), int(low + end))
    return [found[i] for i in sorted(found)]


def blocks_of(benchmark: DataFrame, size: int = ITEMS_PER_BLOCK) -> Iterator[Block]:
    """The items in blocks of at most ``size``; the driver holds one block at a time."""
    rows = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    parts = max(1, -(-rows.count() // size))
    for k in range(parts):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else rows
        items = sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        yield Block.of([r["item_id"] for r in items], [r["text"] for r in items])


FOUND = ArrayType(
    StructType([StructField("item_id", LongType()), StructField("score", DoubleType()), StructField("start", IntegerType()), StructField("stop", IntegerType())])
)


def leaks_in(docs: DataFrame, block: Block, least: float = LEAST_SCORE, text: str = "text") -> Column:
    """array<struct(item_id, score, start, stop)> of a text column: the items of the block in it."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block, table = shared.value, _Words()
        sieve = block.sieve()
        for texts in batches:
            rows = [leaks(words_of(t.encode("utf-8", "replace") if t else None, table), block, sieve, least) for t in texts]
            yield pd.Series([[dict(zip(("item_id", "score", "start", "stop"), f)) for f in r] for r in rows], dtype=object)

    return find(F.col(text).cast("string"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, start, stop): every document with every item that leaked into it."""
    out = None
    for block in blocks_of(benchmark):
        with rows_per_batch(docs.sparkSession, ROWS_PER_BATCH):
            rows = docs.select("doc_id", F.explode(leaks_in(docs, block)).alias("leak")).select("doc_id", "leak.*")
            rows = settle(rows, "leaks")
        out = rows if out is None else out.union(rows)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak."""
    gone = None
    for block in blocks_of(benchmark):
        found = digests_of(docs, F.size(leaks_in(docs, block)) > 0)
        gone = found if gone is None else gone.union(found)
    return without_texts(docs, gone)
