"""Exact duplicates by progressive refinement: length, hash of a prefix, hash of the whole text.

Two texts are equal when they are identical after every run of ASCII white space is replaced by
one space. A null text counts as empty, so null and empty texts are one group. Of equal texts the
row with the smallest doc_id stays; a null doc_id comes after all others; of rows that agree in
doc_id and text exactly one stays. An empty table gives an empty result. Other columns of the
table are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyfield.llm.common import WHITESPACE, text_of
from eddyfield.session import settle

PREFIX = 256  # characters


def exact_groups(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row per row of ``docs``.

    Length and prefix hash come from one narrow read and group in one shuffle. Whole texts are
    hashed only where another row agrees in both; ``digest`` is null elsewhere unless
    ``digest_all`` asks for it. Groups are aggregates and joins, never gathered: a group of any
    size is folded to (doc_id, copies) before it is shuffled, and a skewed join is split by AQE.
    """
    texts = docs.select(
        F.col("doc_id"), F.regexp_replace(text_of(), WHITESPACE, " ").alias("norm")
    ).withColumns({"n": F.length("norm"), "head": F.xxhash64(F.substring("norm", 1, PREFIX))})
    alike = (
        texts.groupBy("n", "head").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("n", "head", F.lit(True).alias("alike"))
    )
    digest = F.sha2("norm", 256)
    if not digest_all:
        digest = F.when(F.col("alike"), digest)
    rows = settle(
        texts.join(alike, ["n", "head"], "left")
        .select("n", "head", F.unhex(digest).alias("digest"), "doc_id")
        .groupBy("n", "head", "digest", "doc_id")
        .agg(F.count(F.lit(1)).alias("copies")),
        "exact_rows",
    )
    groups = rows.groupBy("n", "head", "digest").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = groups.select(
        F.col("n").alias("gn"), F.col("head").alias("ghead"), F.col("digest").alias("gdigest"), "keep_id", "group_size"
    )
    same = (F.col("n") == F.col("gn")) & (F.col("head") == F.col("ghead")) & F.col("digest").eqNullSafe(F.col("gdigest"))
    return (
        rows.join(groups, same)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("digest"),
        )
    )
