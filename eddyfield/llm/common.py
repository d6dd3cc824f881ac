"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyfield.session import rows_per_batch, settle

WHITESPACE = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 4096
ROWS_PER_BATCH = 500  # texts that go to Python at once

# Documents of this remainder of crc32(doc_id as text) by 3 are never learned from.
HELD_OUT = 1


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(column: str = "doc_id") -> Column:
    """True for the documents that no model may learn from; a null id counts as the text ``''``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 3 == HELD_OUT


def id_hash(*columns: Column) -> Column:
    """A uniform number below 2^60 that other engines compute alike: the head of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15), 16, 10).cast("long")


def running_total(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same ``key`` that come
    before in ``order``, a uniform hash below 2^60.

    No key is gathered in one task: the range of the hash is cut into buckets of about
    ``ROWS_PER_BUCKET`` rows, the sums of the buckets are added up, and only within a bucket are
    rows put in order. A null key is a key of its own.
    """
    per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).select(F.col(key).alias("_key"), "_rows")
    cut = rows.join(per_key, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_value", value.cast("long"))
    buckets = F.ceil(F.col("_rows") / ROWS_PER_BUCKET)
    cut = cut.withColumn("_bucket", F.floor(F.col(order) / F.lit(float(1 << 60)) * buckets)).drop("_rows", "_key")
    sums = cut.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_b")).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(key, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b")))
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_bucket", "_b", "_key", "_value", "_within", "_before")
    )


SIEVE_BITS = 1 << 23  # 1 MB, whatever the input


def sieve(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that is true for every value of ``key`` and for few others, as a bitmap of fixed size.

    It goes in front of an exact join, so that rows without a partner are not shuffled. When the
    keys outgrow it, it lets more rows through, and the join after it stays exact.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(SIEVE_BITS))
    one = F.expr("shiftleft(1L, cast(place % 64 as int))")
    words = keys.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).alias("id")).agg(F.bit_or(one).alias("bits"))
    every = keys.sparkSession.range(0, SIEVE_BITS // 64, numPartitions=1).join(words, "id", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("s"))
    bitmap = row.select(F.transform("s", lambda s: s["bits"]).alias("bitmap")).scalar()

    def passes(column: Column) -> Column:
        at = F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS))
        return F.getbit(F.element_at(bitmap, (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int")) == 1

    return passes


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("string"), 256))


def digests_of(docs: DataFrame, judged: Column) -> DataFrame:
    """The digests, settled, of the texts that a function of the text, judged in Python, is true for. Nothing but the
    texts waits for Python there, few at once."""
    with rows_per_batch(docs.sparkSession, ROWS_PER_BATCH):
        return settle(docs.select("text").filter(judged).select(_digest().alias("__digest")), "digests")


def without_texts(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not among ``digests``; a null text stays. A bitmap of fixed size keeps most
    texts out of the exact join."""
    maybe = sieve(digests, "__digest")(_digest())
    return docs.filter(~maybe).unionByName(docs.filter(maybe).join(digests, _digest() == F.col("__digest"), "left_anti"))
