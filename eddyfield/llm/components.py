"""Connected components of a table of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyfield.session import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``links``; the component is its smallest node.

    Large-star and small-star rounds: each node's neighbours are tied to the smallest of them
    instead. Minima are pre-aggregated and neighbours are never gathered, so that a node of any
    degree is only a skewed join. Links to itself or to null are dropped. Every round is written to
    the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    edges = settle(edges.filter("u <> v").distinct(), "edges")
    before = None
    while True:
        print_of = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if print_of == before or not print_of["n"]:
            break
        before = print_of
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = (
            both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = settle(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
    roots = edges.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("root"))
    return nodes.join(roots, F.col("node") == F.col("at"), "left").select("node", F.coalesce("root", "node").alias("component"))
