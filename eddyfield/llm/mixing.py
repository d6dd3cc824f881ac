"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens (words) to the power of an exponent, normalised.
The exponent is bisected: it is the one at which the weights reach the target entropy, or the
smallest that keeps every source within the repetition limit if that is larger. Quotas of
the token budget are then filled from permutations: whole epochs of a source and the head of one
more, each epoch in an order of its own, dealt to blocks that all have the target weights.

Without a budget the mix takes the smallest one that uses every document at least once, so no
document is lost. A null source is a source of its own. A null or empty text has no tokens; a
source without tokens is used once. A null doc_id is drawn like any other id, and rows of one
doc_id are drawn together. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyfield.llm.common import WORDS, id_hash, running_total, text_of
from eddyfield.session import settle

LEVELS = 5  # halvings of the bracket that one job decides
JOBS = 5
DIGITS = 6  # of the exponent; weights have three more


@dataclass(frozen=True)
class Mix:
    entropy_share: float = 0.95  # of the entropy of equal weights
    max_epochs: float = 4.0  # repetition limit
    budget: int | None = None  # tokens
    block_tokens: int = 1 << 20
    seed: int = 7


def tokens() -> F.Column:
    return F.regexp_count(text_of(), F.lit(WORDS)).cast("long")


def exponent(shares: DataFrame, mix: Mix) -> float:
    """Bisection between 0 (equal weights) and 1 (weights as the shares are). Entropy falls and
    repetition falls as the exponent rises. A job evaluates all points that the next ``LEVELS``
    halvings can ask for and returns a row for each of them."""
    known = shares.filter("share > 0")
    sources = known.count()
    if sources < 2:
        return 1.0
    goal = mix.entropy_share * math.log(sources)

    def evaluate(points: list[float]) -> dict[float, tuple[float, float]]:
        at = known.withColumn("a", F.explode(F.array(*[F.lit(p) for p in points]))).withColumn("p", F.pow("share", "a"))
        rows = at.groupBy("a").agg(
            F.sum("p").alias("z"),
            F.sum(F.col("p") * F.col("a") * F.log("share")).alias("plogp"),
            F.max(F.col("p") / F.col("tokens")).alias("densest"),
            F.min(F.col("p") / F.col("tokens")).alias("thinnest"),
        )
        out = {}
        for r in rows.collect():
            entropy = math.log(r["z"]) - r["plogp"] / r["z"]
            epochs = r["densest"] / (r["thinnest"] if mix.budget is None else r["z"] / mix.budget)
            out[r["a"]] = (entropy, epochs)
        return out

    # the fixed points: the limits may hold, or fail, at both ends
    def bisect(fits) -> float:
        low, high = 0.0, 1.0
        for _ in range(JOBS):
            step = (high - low) / (1 << LEVELS)
            points = [low + step * i for i in range((1 << LEVELS) + 1)]
            values = evaluate(points)
            first, last = 0, 1 << LEVELS
            if fits(*values[points[first]]):
                return points[first]
            while last - first > 1:
                middle = (first + last) // 2
                if fits(*values[points[middle]]):
                    last = middle
                else:
                    first = middle
            low, high = points[first], points[last]
        return high

    by_entropy = bisect(lambda entropy, epochs: entropy <= goal)
    by_epochs = bisect(lambda entropy, epochs: epochs <= mix.max_epochs)
    return round(max(by_entropy, by_epochs), DIGITS)


def plan(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (doc_id, source, tokens) and, per source, what is drawn from it:
    (source, source_tokens, weight, quota, epochs, rest, cut). All documents are drawn in the
    first ``epochs`` epochs and those whose hash of the next epoch is below ``cut`` once more."""
    rows = settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), tokens().alias("tokens")), "mix_rows")
    sums = settle(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix_sources")
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    shares = sums.withColumn("share", F.col("tokens") / float(max(total, 1)))
    alpha = exponent(shares, mix)
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(alpha))).otherwise(0.0)
    powers = shares.withColumn("power", power)
    sizes = powers.agg(
        F.sum("power").alias("z"), F.max(F.when(F.col("power") > 0, F.col("tokens") / F.col("power"))).alias("least")
    ).first()
    z = sizes["z"] or 1.0
    budget = mix.budget if mix.budget is not None else round((sizes["least"] or 0.0) * z)
    quota = F.round(F.round(F.col("power") / z, DIGITS + 3) * budget).cast("long")
    if mix.budget is None:  # rounding must not lose the last document of a source
        quota = F.greatest(quota, F.col("tokens"))
    one = F.when(F.col("tokens") == 0, F.lit(int(mix.budget is None))).otherwise(F.floor(F.col("quota") / F.col("tokens")))
    sources = (
        powers.withColumn("weight", F.round(F.col("power") / z, DIGITS + 3))
        .withColumn("quota", quota)
        .withColumn("epochs", one.cast("long"))
        .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))
        .select("source", F.col("tokens").alias("source_tokens"), "weight", "quota", "epochs", "rest")
    )
    sources = settle(sources, "mix_plan")
    drawn = rows.join(sources.select(F.col("source").alias("s"), "epochs", "rest"), F.col("source").eqNullSafe(F.col("s")))
    drawn = drawn.withColumn("u", permuted(F.col("epochs"), mix)).drop("s")
    begun = running_total(drawn, "source", "u", F.col("tokens"), "start")
    cuts = begun.filter("start >= rest").groupBy(F.col("source").alias("s")).agg(F.min("u").alias("cut"))
    with_cut = sources.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return rows, settle(with_cut, "mix_cuts")


def permuted(epoch, mix: Mix):
    """Place of a document in the permutation of an epoch: a hash of seed, epoch and id."""
    return id_hash(F.lit(mix.seed), epoch, F.col("doc_id"))


def draw(rows: DataFrame, sources: DataFrame, mix: Mix = Mix(), epoch: str = "epoch") -> DataFrame:
    """``rows``, which have doc_id and source, repeated as often as they are drawn, with the number of the
    ``epoch``. The table of sources is joined by its real size: a broadcast unless there are very many."""
    table = sources.select(F.col("source").alias("__of"), F.col("epochs").alias("__whole"), F.col("cut").alias("__cut"))
    more = (F.col("__cut").isNull() | (permuted(F.col("__whole"), mix) < F.col("__cut"))).cast("long")
    joined = rows.join(table, rows["source"].cast("string").eqNullSafe(F.col("__of")))
    times = joined.withColumn("__times", F.col("__whole") + more).filter("__times > 0")
    return times.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1))).drop("__of", "__whole", "__cut", "__times")


def blocks(rows: DataFrame, sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, source, epoch, tokens, start, block, place): every drawn document, the tokens of its
    source before it, the block it goes to, and its place in the order of the block."""
    drawn = draw(rows, sources, mix).withColumn("u", permuted(F.col("epoch"), mix))
    stream = drawn.withColumn("stream", F.concat_ws("|", "epoch", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))))
    begun = running_total(stream, "stream", "u", F.col("tokens"), "within")
    table = sources.select(F.col("source").alias("_source"), "source_tokens", "weight")
    start = F.col("epoch") * F.col("source_tokens") + F.col("within")
    quota = F.greatest(F.col("weight") * F.lit(float(mix.block_tokens)), F.lit(1.0))
    return (
        begun.join(table, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("start", start)
        .withColumn("block", F.floor(F.col("start") / quota))
        .withColumn("place", id_hash(F.lit(mix.seed), F.col("block"), F.col("epoch"), F.col("doc_id")))
        .select("doc_id", "source", "epoch", "tokens", "start", "block", "place")
    )
