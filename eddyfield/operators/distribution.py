"""Histograms, quantiles and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyfield.functions.missing import complete
from eddyfield.functions.scalar import lgamma
from eddyfield.session import discard, settle

# The quantiles of a field report and of a noise report, in percent.
FIELD_QUANTILES = [0, 10, 25, 50, 75, 90, 100]
NOISE_QUANTILES = [0.1, 5, 25, 50, 90, 95, 99, 99.9, 100]
SUB_BINS = 4096


def concentration_pdf(samples: DataFrame, keys: list[str], width: float, low: float = 0.0, value: str = "c") -> DataFrame:
    """Probability density of the samples present, per group of ``keys``: one row per bin.

    Bins start at ``low`` and go on up to the largest sample; they are closed below and open
    above, the last one closed. Samples below ``low`` do not count. When rounding leaves the
    regular edges below the largest sample, a shorter last bin reaches up to it.

    The samples are scanned once and reduced to one count per bin before the shuffle, so one
    group may hold any share of the rows; the rest works on the counts.
    """
    c = F.col(value)
    guess = F.floor((c - F.lit(low)) / F.lit(width)).cast("int")
    # the quotient may round across an edge: compare with the edges themselves
    exact = (
        F.when(c < F.lit(low) + guess * F.lit(width), guess - 1)
        .when(c >= F.lit(low) + (guess + 1) * F.lit(width), guess + 1)
        .otherwise(guess)
    )
    counts = settle(
        samples.filter(c >= low).groupBy(*keys, exact.alias("bin")).agg(F.count(value).alias("n"), F.max(value).alias("max")),
        "counts",
    )
    regular = F.ceil((F.max("max") + F.lit(width) - F.lit(low)) / F.lit(width)).cast("int") - 1
    edges = (
        counts.groupBy(*keys)
        .agg(F.max("max").alias("max"), regular.alias("regular"), F.sum("n").alias("total"))
        .withColumn("last", F.lit(low) + F.col("regular") * F.lit(width))
        .withColumn("n_bins", F.when(F.col("last") < F.col("max"), F.col("regular") + 1).otherwise(F.col("regular")))
        .withColumn("top", F.greatest("last", "max"))
        .select(*keys, "regular", "total", "n_bins", "top")
    )
    # the largest sample may sit on the last edge, which belongs to the last bin
    closed = (
        counts.join(edges.select(*keys, "n_bins"), keys)
        .groupBy(*keys, F.least(F.col("bin"), F.col("n_bins") - 1).alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    left = F.lit(low) + F.col("bin") * F.lit(width)
    right = F.when(F.col("bin") < F.col("regular"), F.lit(low) + (F.col("bin") + 1) * F.lit(width)).otherwise(F.col("top"))
    return (
        edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)))
        .join(closed, [*keys, "bin"], "left")
        .withColumns({"n": F.coalesce("n", F.lit(0).cast("bigint")), "left": left, "right": right})
        .select(
            *keys,
            "bin",
            "left",
            "right",
            (F.lit(0.5) * (F.col("left") + F.col("right"))).alias("center"),
            "n",
            (F.col("n") / F.col("total") / (F.col("right") - F.col("left"))).alias("pdf"),
        )
    )



def pdf_by_bins(
    samples: DataFrame, keys: list[str], bins: int = 100, value_range: tuple[float, float] | None = None, value: str = "c"
) -> DataFrame:
    """Probability density in ``bins`` even bins over a range, by default from the smallest to the largest sample of
    each group of ``keys``: one row per group and bin.

    Bins are closed below and open above, the last one closed; samples outside the range do not count. A range
    without width is widened by a half on both sides. A group without any sample in range keeps its rows, with a
    count of 0 and no density; without a range given, also no edges.
    """
    if bins < 1:
        raise ValueError("at least one bin is needed")
    if value_range is not None and not value_range[0] <= value_range[1]:
        raise ValueError("the range must not be reversed")
    v = F.when(~F.isnan(value), F.col(value))
    low, high = (F.min(v), F.max(v)) if value_range is None else (F.lit(float(b)) for b in value_range)
    groups = samples.groupBy(*keys).agg(F.count(v).alias("present"), low.cast("double").alias("low"), high.cast("double").alias("high"))
    half = F.when(F.col("low") == F.col("high"), 0.5).otherwise(0.0)
    groups = settle(groups.select(*keys, (F.col("low") - half).alias("low"), (F.col("high") + half).alias("high")), "groups")

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("high")).otherwise(F.col("low") + i * ((F.col("high") - F.col("low")) / F.lit(float(bins))))

    named = groups.withColumnsRenamed({k: f"_{k}" for k in keys})
    placed = samples.select(*keys, v.cast("double").alias("_v")).join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    placed = placed.select(*keys, "_v", "low", "high").filter((F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high")))
    guess = F.least(F.floor((F.col("_v") - F.col("low")) / ((F.col("high") - F.col("low")) / F.lit(float(bins)))).cast("int"), F.lit(bins - 1))
    # the quotient may round across an edge: compare with the edges themselves
    exact = F.when(F.col("_v") < edge(guess), guess - 1).when((F.col("_v") >= edge(guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)
    counts = settle(placed.groupBy(*keys, exact.alias("bin")).agg(F.count(F.lit(1)).alias("n")), "counts")
    rows = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))

    def beside(left: DataFrame, right: DataFrame, names: list[str], more: list[str]) -> DataFrame:
        right = right.withColumnsRenamed({k: f"_{k}" for k in names})
        return left.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names], "left").select(*left.columns, *more)

    whole = beside(beside(rows, counts, [*keys, "bin"], ["n"]), totals, keys, ["total"])
    left, right = edge(F.col("bin")), edge(F.col("bin") + 1)
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return whole.select(
        *keys, "bin", left.alias("left"), right.alias("right"), (F.lit(0.5) * (left + right)).alias("center"), n.alias("n"), (n / F.col("total") / (right - left)).alias("pdf")
    )


def histogram_density(samples: DataFrame, keys: list[str], edges: list[float], value: str = "c") -> DataFrame:
    """Density histogram over explicit, possibly uneven edges; the last bin is closed."""
    if sorted(edges) != edges or len(set(edges)) != len(edges):
        raise ValueError("edges must increase")
    c = F.col(value)
    # binary search in the plan: depth log2(bins), no join
    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c < edges[mid], search(lo, mid)).otherwise(search(mid, hi))

    n = len(edges) - 1
    counted = (
        samples.filter((c >= edges[0]) & (c <= edges[-1]))
        .groupBy(*keys, search(0, n).alias("bin"))
        .agg(F.count(value).alias("n"))
    )
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("left"), F.lit(edges[i + 1]).alias("right")) for i in range(n)])
    group = Window.partitionBy(*keys)
    return (
        samples.select(*keys)
        .distinct()
        .select(*keys, F.explode(bins).alias("b"))
        .select(*keys, "b.*")
        .join(counted, [*keys, "bin"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
        .select(
            *keys, "bin", "left", "right", "n",
            F.try_divide(F.try_divide(F.col("n"), F.sum("n").over(group)), F.col("right") - F.col("left")).alias("pdf"),
        )
    )


def gamma_fit(samples: DataFrame, keys: list[str], points: int, low: float, high: float, value: str = "c") -> DataFrame:
    """Gamma density with the mean and variance of the samples, on ``points`` even values.

    With intensity i = std / mean and k = i^-2:
    p(c) = k^k / Gamma(k) (c / mean)^(k - 1) exp(-k c / mean) / mean, through logarithms.
    """
    moments = samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    shaped = moments.withColumn("intensity", F.try_divide(F.col("std"), F.col("mean"))).withColumn(
        "k", F.when((F.col("intensity") > 0) & (F.col("mean") > 0), 1.0 / (F.col("intensity") * F.col("intensity")))
    )
    step = (high - low) / (points - 1)
    k, z = F.col("k"), F.try_divide(F.col("value"), F.col("mean"))
    log_pdf = k * F.log(k) - lgamma(k) + (k - 1.0) * F.log(z) - k * z - F.log("mean")
    at_zero = F.when(k > 1, 0.0).when(k == 1, F.try_divide(F.lit(1.0), F.col("mean"))).otherwise(F.lit(float("inf")))
    pdf = F.when(F.col("value") < 0, 0.0).when(F.col("value") == 0, at_zero).otherwise(F.exp(log_pdf))
    return (
        shaped.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .withColumn("value", F.lit(low) + F.col("point") * F.lit(step))
        .select(*keys, "mean", "std", "intensity", "k", "point", "value", F.when(k.isNotNull(), pdf).alias("pdf"))
    )


def order_statistics(samples: DataFrame, keys: list[str], value: str, percents: list[float]) -> DataFrame:
    """Exact quantiles of groups of any size, with linear interpolation between ranks.

    Every wanted rank keeps a bracket of values that must hold it. Each pass counts the values
    in 4096 equal parts of every bracket (one counter per part leaves a task, however many
    rows it saw) and keeps the one part that holds the rank, shrunk to its smallest and largest
    member. A few passes end with all brackets closed on one value. No group is sorted or
    gathered, and equal values cost nothing extra. The passes read the one column from the shared folder; what made
    it is worked out once.
    """
    v = F.col(value)
    present = settle(samples.filter(v.isNotNull()).select(*keys, v.alias("_v")), "present")
    totals = present.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    share = F.array(*[F.lit(float(p)) for p in percents])
    position = F.col("percent") / 100.0 * (F.col("n") - 1)
    wanted = settle(
        totals.withColumn("percent", F.explode(share))
        .withColumn("position", position)
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position"))))),
        "wanted",
    )
    ranked = settle(
        wanted.select(*keys, "rank", "lo", "hi", F.lit(0).cast("bigint").alias("below")).distinct(), "ranked"
    )
    closed = []
    while True:
        closed.append(ranked.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("at_rank")))
        still_open = ranked.filter("lo < hi")
        if still_open.isEmpty():
            break
        # ranks often share a bracket; brackets of a group do not overlap
        brackets = still_open.select(*keys, "lo", "hi", "below").distinct()
        part = F.least(
            F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(SUB_BINS)), F.lit(SUB_BINS - 1)
        )
        running = Window.partitionBy(*keys, "bracket").orderBy("part")  # at most SUB_BINS rows
        parts = (
            present.join(brackets, keys)
            .filter(F.col("_v").between(F.col("lo"), F.col("hi")))
            .groupBy(*keys, F.col("lo").alias("bracket"), "below", part.alias("part"))
            .agg(F.count("_v").alias("n"), F.min("_v").alias("new_lo"), F.max("_v").alias("new_hi"))
            .withColumn("end", F.col("below") + F.sum("n").over(running))
            .drop("below")
        )
        ranked = settle(
            still_open.withColumnRenamed("lo", "bracket")
            .join(parts, [*keys, "bracket"])
            .filter((F.col("end") > F.col("rank")) & (F.col("end") - F.col("n") <= F.col("rank")))
            .select(
                *keys, "rank", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), (F.col("end") - F.col("n")).alias("below")
            ),
            "ranked",
        )
    discard(present)  # all that follows is settled
    ranks = closed[0]
    for more in closed[1:]:
        ranks = ranks.unionByName(more)
    return (
        wanted.join(ranks, [*keys, "rank"])
        .groupBy(*keys, "percent", "position")
        .agg(F.min("at_rank").alias("a"), F.max("at_rank").alias("b"))
        .select(
            *keys,
            "percent",
            (F.col("a") + (F.col("b") - F.col("a")) * (F.col("position") - F.floor("position"))).alias("value"),
        )
    )


def _named(values: list[float], of: str) -> list[Column]:
    return [F.element_at(of, i + 1).alias(f"p{str(p).replace('.', '_')}") for i, p in enumerate(values)]


def field_report(field: DataFrame, *metrics: str) -> DataFrame:
    """Mean, median, quantiles and number of the pixels present, per case and metric.

    A field has one row per sensor pixel, which bounds what one quantile aggregate holds.
    """
    return region_report(field, *metrics, region=None)


def region_report(field: DataFrame, *metrics: str, region: str | None = "inside") -> DataFrame:
    """The field report of the whole field (``region`` NULL) and of both sides of a flag."""
    long = field.unpivot(
        ["case_id"] + ([region] if region else []), list(metrics), "metric", "value"
    )
    at = F.array(*[F.lit(q / 100.0) for q in FIELD_QUANTILES])
    aggregates = [
        F.count("value").alias("pixels"),
        F.avg("value").alias("mean"),
        F.percentile("value", at).alias("_q"),
    ]
    if region:
        grouped = long.groupingSets(
            [[F.col("case_id"), F.col("metric")], [F.col("case_id"), F.col("metric"), F.col(region)]],
            F.col("case_id"), F.col("metric"), F.col(region),
        ).agg(*aggregates)
        keys = ["case_id", "metric", region]
    else:
        grouped, keys = long.groupBy("case_id", "metric").agg(*aggregates), ["case_id", "metric"]
    median = F.element_at("_q", FIELD_QUANTILES.index(50) + 1).alias("median")
    return grouped.select(*keys, "pixels", "mean", median, *_named(FIELD_QUANTILES, "_q"))


def noise_report(samples: DataFrame, value: str = "c") -> DataFrame:
    """Quantiles (to 4 digits), rms, mean, variance and standard deviation of the background of
    every case; all missing when any sample is."""
    v = F.col(value)
    ok = complete(v)
    moments = settle(
        samples.groupBy("case_id").agg(
            ok.alias("ok"),
            F.sqrt(F.avg(v * v)).alias("rms"),
            F.avg(v).alias("mean"),
            F.var_pop(v).alias("variance"),
            F.stddev_pop(v).alias("std"),
        ),
        "moments",
    )
    ranked = order_statistics(samples, ["case_id"], value, NOISE_QUANTILES)
    names = {str(float(p)): f"p{str(p).replace('.', '_')}" for p in NOISE_QUANTILES}
    wide = ranked.groupBy("case_id").agg(
        *[F.round(F.max(F.when(F.col("percent") == float(p), F.col("value"))), 4).alias(n) for p, n in names.items()]
    )
    columns = ["rms", "mean", "variance", "std", *names.values()]
    return moments.join(wide, "case_id", "left").select(
        "case_id", *[F.when(F.col("ok"), F.col(c)).alias(c) for c in columns]
    )


def field_extent(field: DataFrame, value: str) -> DataFrame:
    """Smallest, largest, mean and median value of a field, and the pixel of the smallest."""
    at = F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(value), F.col("y"), F.col("x"))))
    return (
        field.groupBy("case_id")
        .agg(
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.avg(value).alias("mean"),
            F.percentile(value, F.lit(0.5)).alias("median"),
            at.alias("_at"),
        )
        .select("case_id", "min", "max", "mean", "median", F.col("_at.y").alias("min_y"), F.col("_at.x").alias("min_x"))
    )


def symmetric_limits(field: DataFrame, *values: str) -> DataFrame:
    """Colour range [-m, m] with m the largest magnitude over several fields of a case."""
    largest = F.max(F.greatest(*[F.abs(F.col(v)) for v in values])) if len(values) > 1 else F.max(F.abs(F.col(values[0])))
    m = F.greatest(F.coalesce(largest, F.lit(1.0)), F.lit(1e-12))
    return field.groupBy("case_id").agg((-m).alias("vmin"), m.alias("vmax"))


def positive_limits(field: DataFrame, value: str) -> DataFrame:
    """Colour range of a logarithmic scale: 1st and 99th percentile of the positive values."""
    positive = F.when(F.col(value) > 0, F.col(value))
    return field.groupBy("case_id").agg(
        F.percentile(positive, F.lit(0.01)).alias("vmin"), F.percentile(positive, F.lit(0.99)).alias("vmax")
    )


def value_limits(field: DataFrame, value: str) -> DataFrame:
    """Smallest and largest value of a field."""
    return field.groupBy("case_id").agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))

