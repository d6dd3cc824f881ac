"""URL filters: rules first, then a list of blocked entries as a sorted array of digests.

An entry is a host, which blocks its subdomains too, or a host with a path. The list is kept as an
array of 64-bit xxhash keys in order, with the full strings beside it. Tasks memory-map the array,
probe it by vectorised binary search, and compare the stored strings before they believe a hit,
so that a collision of digests blocks nothing.

A null url, or one without ``://``, has an empty host and path, fits no rule and no entry, and is
allowed. Null and repeated entries are dropped from the list; an empty list blocks nothing.
Rows of the table of pages are judged one by one: repeated rows, empty tables and extra columns
need no care.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyfield.session import new_path

# Rules as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
# Names of the default list, each under every ending.
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
ENDINGS = ["example.com", "example.net", "example.org"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str) -> tuple[Column, Column]:
    """Host and path columns."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        inside = (host == rule_host) | host.endswith("." + rule_host)
        fits = inside & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def default_entries(spark) -> DataFrame:
    return spark.createDataFrame([(f"{n}.{e}",) for n in BLOCKED_NAMES for e in ENDINGS], "entry string")


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted entries of one partition as one row of arrays."""
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.concat_tables(tables)
    digests = table.column("digest").to_numpy()
    strings = [s.encode() for s in table.column("entry").to_pylist()]
    ends = np.cumsum([len(s) for s in strings], dtype="int64")
    yield pa.RecordBatch.from_arrays(
        [pa.array([int(digests[0])]), *(pa.array([b], pa.binary()) for b in (digests.tobytes(), ends.tobytes(), b"".join(strings)))],
        names=["first", "digests", "ends", "strings"],
    )


def build_index(entries: DataFrame, segments: int = 1) -> list[str]:
    """Sort the entries by digest, in ``segments`` ranges, into files in the shared folder, and have
    Spark fetch them to every executor that asks. Returns the names to open them by, in order. The
    list is never gathered by the driver; an executor needs local disk for it, not memory."""
    spark = entries.sparkSession
    path = new_path(spark, "digests")
    keyed = entries.filter("entry IS NOT NULL").distinct().select(F.xxhash64("entry").alias("digest"), "entry")
    (
        keyed.repartitionByRange(segments, "digest")
        .sortWithinPartitions("digest", "entry")
        .mapInArrow(_segment, "first long, digests binary, ends binary, strings binary")
        .write.parquet(path)
    )
    files = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").collect()]
    for file in files:
        spark.sparkContext.addFile(file)
    return sorted(os.path.basename(f) for f in files)


class Index:
    """The memory-mapped arrays of one executor. Its worker processes share them; whoever comes first
    lays them out, a segment at a time, and moves them into place in one step."""

    def __init__(self, names: list[str]):
        root = SparkFiles.getRootDirectory()
        folder = os.path.join(root, f"index-{xxhash.xxh64_hexdigest('|'.join(names))}")
        if not os.path.isdir(folder):
            mine = f"{folder}-{uuid.uuid4().hex}"
            os.makedirs(mine)
            self._lay_out([SparkFiles.get(n) for n in names], mine)
            with contextlib.suppress(OSError):  # another worker was first
                os.rename(mine, folder)
        self.digests, self.ends = self._map(folder, "digests", "int64"), self._map(folder, "ends", "int64")
        self.strings = self._map(folder, "strings", "uint8")

    @staticmethod
    def _lay_out(files: list[str], folder: str) -> None:
        shift = 0
        with contextlib.ExitStack() as stack:
            digests, ends, strings = (stack.enter_context(open(os.path.join(folder, n), "wb")) for n in ("digests", "ends", "strings"))
            for file in files:
                for row in pq.read_table(file).to_pylist():
                    places = np.frombuffer(row["ends"], "int64") + shift
                    shift = int(places[-1])
                    digests.write(row["digests"])
                    ends.write(places.tobytes())
                    strings.write(row["strings"])

    @staticmethod
    def _map(folder: str, name: str, kind: str) -> np.ndarray:
        path = os.path.join(folder, name)
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)

    def find(self, digests: np.ndarray, strings: np.ndarray) -> np.ndarray:
        """Which of the strings are entries."""
        found = np.zeros(len(digests), bool)
        at = np.searchsorted(self.digests, digests)
        inside = np.flatnonzero(at < len(self.digests))
        for i in inside[self.digests[at[inside]] == digests[inside]]:
            k, wanted = at[i], strings[i].encode()
            while k < len(self.digests) and self.digests[k] == digests[i] and not found[i]:
                start = self.ends[k - 1] if k else 0
                found[i] = self.strings[start : self.ends[k]].tobytes() == wanted
                k += 1
        return found


def candidates(host: Column, path: Column) -> Column:
    """The strings that would block a url: host with path, host, and the domains above it."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.concat(F.array(F.concat(host, path)), above)


def blocked_by(files: list[str], names: Column) -> Column:
    """The first of an array of strings that the list has; null if it has none of them."""

    @F.pandas_udf("string")
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        index = Index(files)
        for digests, strings in batches:
            sizes = np.array([len(s) for s in strings], dtype="int64")
            owner = np.repeat(np.arange(len(sizes)), sizes)
            words = np.concatenate([*strings, np.zeros(0, object)])
            keys = np.concatenate([*digests, np.zeros(0, "int64")]).astype("int64")
            hits = np.flatnonzero(index.find(keys, words))
            rows, first = np.unique(owner[hits], return_index=True)
            out = np.full(len(sizes), None, dtype=object)
            out[rows] = words[hits[first]]
            yield pd.Series(out, dtype=object)

    return probe(F.transform(names, lambda s: F.xxhash64(s)), names)


def judge(pages: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed), one row per page."""
    files = build_index(default_entries(pages.sparkSession) if entries is None else entries)
    host, path = split_url("url")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    listed = blocked_by(files, candidates(F.col("host"), F.col("path")))
    return urls.withColumn("listed", listed).select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )
