"""Gaussian fits of lateral profiles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyfield.model import COLLAPSE_POINTS, COLLAPSE_REACH
from eddyfield.operators.regrid import locate
from eddyfield.session import settle

MIN_SIGMA = 1e-6
FIT_TOLERANCE = 1e-12  # of the last step, against the parameters
FIT_WIDEST = 1000.0  # widths of the profile: a wider bell is flat over it, and its height and centre mean nothing
FIT_DAMPING = 1e12  # no direction gets smaller squares: the minimum to rounding
LINE = ["case_id", "target"]


def _usable(profile: DataFrame, x_range: tuple[float, float] | None) -> DataFrame:
    points = profile.filter(F.col("x_mm").isNotNull() & F.col("value").isNotNull() & ~F.isnan("x_mm") & ~F.isnan("value"))
    return points if x_range is None else points.filter(F.col("x_mm").between(*x_range))


def gaussian_moments(profile: DataFrame, x_range: tuple[float, float] | None = None) -> DataFrame:
    """Height, centre and width of every profile from its moments, NULL when it has fewer than
    three usable points or no positive value. When the values do not sum to a positive number the
    plain mean and variance of x stand in."""
    x, y = F.col("x_mm"), F.col("value")
    every = profile.select(*LINE).distinct()
    sums = every.join(_usable(profile, x_range), LINE, "left").groupBy(*LINE).agg(
        F.count(y).alias("n"),
        F.max(y).alias("top"),
        F.sum(y).alias("s0"),
        F.sum(x * y).alias("s1"),
        F.sum(x * x * y).alias("s2"),
        F.avg(x).alias("x_avg"),
        F.var_pop(x).alias("x_var"),
    )
    weighted = F.col("s0") > 0
    mu = F.when(weighted, F.col("s1") / F.col("s0")).otherwise(F.col("x_avg"))
    spread = F.when(weighted, F.greatest(F.col("s2") / F.col("s0") - mu * mu, F.lit(0.0))).otherwise(F.col("x_var"))
    ok = (F.col("n") >= 3) & (F.col("top") > 0)
    return sums.select(
        *LINE,
        F.when(ok, F.col("top")).alias("amp"),
        F.when(ok, mu).alias("mu"),
        F.when(ok, F.greatest(F.sqrt(spread), F.lit(MIN_SIGMA))).alias("sigma"),
    )


STEPS_AT_ONCE = 25  # of the fit between two settled rounds
FIT = "struct<amp:double,mu:double,sigma:double,damping:double,sse:double,b0:double,b1:double,b2:double,b3:double,b4:double,g0:double,g1:double,g2:double,status:string>"
POWERS = ["b0", "b1", "b2", "b3", "b4"]  # sums of bell^2 z^k
SLOPES = ["g0", "g1", "g2"]  # sums of bell z^k residual


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bell_sums(points: Column, p: Column) -> Column:
    """Sums over the points from which the normal equations at the parameters ``p`` are made."""
    z = F.transform(points, lambda q: F.struct(F.try_divide(q["x"] - p["mu"], p["sigma"]).alias("z"), q["y"].alias("y")))
    bells = F.transform(z, lambda q: F.struct(q["z"].alias("z"), F.exp(F.lit(-0.5) * q["z"] * q["z"]).alias("b"), q["y"].alias("y")))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ["sse", *POWERS, *SLOPES]])

    def add(total: Column, q: Column) -> Column:
        z, b = q["z"], q["b"]
        residual = p["amp"] * b - q["y"]
        square, slope = b * b, b * residual
        terms = [residual * residual]
        for k in range(len(POWERS)):
            terms.append(square)
            square = square * z
        for k in range(len(SLOPES)):
            terms.append(slope)
            slope = slope * z
        return F.struct(*[(total[n] + term).alias(n) for n, term in zip(["sse", *POWERS, *SLOPES], terms)])

    return F.aggregate(bells, zero, add)


def _trial(s: Column) -> Column:
    """The next parameters to try: the damped normal equations solved by cofactors, within bounds."""
    k = F.try_divide(s["amp"], s["sigma"])
    n11, n12, n13 = s["b0"], k * s["b1"], k * s["b2"]
    n22, n23, n33 = k * k * s["b2"], k * k * s["b3"], k * k * s["b4"]
    grown = [n + s["damping"] * F.greatest(n, F.lit(1e-30)) for n in (n11, n22, n33)]
    terms = F.struct(
        *[c.alias(n) for n, c in zip("abcdefuvw", (grown[0], n12, n13, grown[1], n23, grown[2], -s["g0"], -k * s["g1"], -k * s["g2"]))]
    )

    def solved(m: Column) -> Column:
        a, b, c, d, e, f, u, v, w = (m[n] for n in "abcdefuvw")
        c11, c12, c13 = d * f - e * e, c * e - b * f, b * e - c * d
        c22, c23, c33 = a * f - c * c, b * c - a * e, a * d - b * b
        det = a * c11 + b * c12 + c * c13
        steps = (c11 * u + c12 * v + c13 * w, c12 * u + c22 * v + c23 * w, c13 * u + c23 * v + c33 * w)
        amp, mu, sigma = (F.try_divide(x, det) for x in steps)
        return F.struct(
            F.greatest(s["amp"] + amp, F.lit(0.0)).alias("amp"),
            (s["mu"] + mu).alias("mu"),
            F.greatest(s["sigma"] + sigma, F.lit(MIN_SIGMA)).alias("sigma"),
        )

    return _let(terms, solved)


def _fit_step(points: Column, s: Column) -> Column:
    """One damped step of a fit that is still running; others stay as they are."""
    names = ["sse", *POWERS, *SLOPES]

    def judged(at: Column) -> Column:
        trial, sums = at["p"], at["sums"]
        better = F.coalesce((sums["sse"] <= s["sse"]) & ~F.isnan(sums["sse"]), F.lit(False))
        moved = F.greatest(*[F.abs(trial[n] - s[n]) for n in ("amp", "mu", "sigma")])
        size = F.greatest(*[F.abs(trial[n]) for n in ("amp", "mu", "sigma")])
        damping = F.when(better, s["damping"] * 0.3).otherwise(s["damping"] * 10.0)
        ended = F.when(better, moved <= F.lit(FIT_TOLERANCE) * (1 + size)).otherwise(damping > FIT_DAMPING)
        wide = better & (trial["sigma"] > F.lit(FIT_WIDEST) * (F.element_at(points, -1)["x"] - points[0]["x"]))
        kept = [F.when(better, trial[n]).otherwise(s[n]).alias(n) for n in ("amp", "mu", "sigma")]
        kept += [damping.alias("damping"), *[F.when(better, sums[n]).otherwise(s[n]).alias(n) for n in names]]
        status = F.when(wide, "unbounded").when(ended, "converged").otherwise("running")
        return F.struct(*kept, status.alias("status")).cast(FIT)

    tried = _let(_trial(s), lambda p: F.struct(p.alias("p"), _bell_sums(points, p).alias("sums")))
    return F.when(s["status"] == "running", _let(tried, judged)).otherwise(s)


def gaussian_fit(profile: DataFrame, x_range: tuple[float, float] | None = None, max_steps: int = 200) -> DataFrame:
    """Least-squares Gaussian of every profile (amp >= 0, sigma >= 1e-6), from its moments on.

    All profiles take damped Gauss-Newton steps together, as expressions: a step sums the terms of the normal
    equations over the points, solves the three equations by cofactors, and stays where it is, with more
    damping, when the squares do not get smaller. A profile, at most as many points as the sensor has
    columns, is one row. Every ``STEPS_AT_ONCE`` steps the profiles still running are settled, so that the lineage
    stays short and finished ones are left alone.

    Every profile has a row; ``status`` is converged, unbounded (no bell of a finite width fits best, as for a
    profile without a peak), unusable or not converged, and the parameters are NULL unless it is the first.
    """
    line = F.sort_array(F.collect_list(F.struct(F.col("x_mm").cast("double").alias("x"), F.col("value").cast("double").alias("y"))))
    points = _usable(profile, x_range).groupBy(*LINE).agg(line.alias("points"))
    start = gaussian_moments(profile, x_range)
    first = start.join(points, LINE, "left").withColumn("p", F.struct("amp", "mu", "sigma"))
    usable = F.col("amp").isNotNull() & ~F.isnan("amp") & ~F.isnan("mu") & ~F.isnan("sigma")
    sums = F.when(usable, _bell_sums(F.col("points"), F.col("p")))
    fields = [*[F.col(n) for n in ("amp", "mu", "sigma")], F.lit(1e-3).alias("damping"), *[F.col("sums")[n].alias(n) for n in ["sse", *POWERS, *SLOPES]]]
    state = F.struct(*fields, F.when(usable, "running").otherwise("unusable").alias("status")).cast(FIT)
    running = settle(first.withColumn("sums", sums).select(*LINE, "points", state.alias("s")), "fit")
    ended = [running.filter("s.status <> 'running'")]
    for done in range(0, max_steps, STEPS_AT_ONCE):
        open_fits = running.filter("s.status = 'running'")
        if open_fits.isEmpty():
            break
        steps = F.sequence(F.lit(1), F.lit(min(STEPS_AT_ONCE, max_steps - done)))
        stepped = F.aggregate(steps, F.col("s"), lambda s, _: _fit_step(F.col("points"), s))
        running = settle(open_fits.select(*LINE, "points", stepped.alias("s")), "fit")
        ended.append(running if done + STEPS_AT_ONCE >= max_steps else running.filter("s.status <> 'running'"))
    every = reduce(DataFrame.unionByName, ended)
    good = F.col("s.status") == "converged"
    status = F.when(F.col("s.status") == "running", "not converged").otherwise(F.col("s.status"))
    return every.select(*LINE, *[F.when(good, F.col(f"s.{n}")).alias(n) for n in ("amp", "mu", "sigma")], status.alias("status"))


def gaussian_collapse(
    profile: DataFrame,
    params: DataFrame,
    x_range: tuple[float, float] | None = None,
    points: int = COLLAPSE_POINTS,
    reach: float = COLLAPSE_REACH,
) -> DataFrame:
    """Mean over the cases of the fitted Gaussians, each scaled to its peak, on ``points`` even
    values z = (x - mu) / sigma in [-reach, reach]: ``(target, point, z, value)``.

    A Gaussian counts where its own points reach, linearly interpolated between them. Targets
    with a failed fit in any case are left out.
    """
    failed = params.filter(F.col("mu").isNull()).select("target").distinct()
    nodes = settle(
        _usable(profile, x_range)
        .join(params.join(failed, "target", "left_anti"), LINE)
        .select(*LINE, "amp", F.col("x").alias("idx"), ((F.col("x_mm") - F.col("mu")) / F.col("sigma")).alias("mm")),
        "nodes",
    )
    z = F.col("mm")
    peaks = nodes.groupBy(*LINE).agg(F.max("amp").alias("amp"), F.max(F.exp(F.lit(-0.5) * z * z)).alias("peak"))
    step = 2.0 * reach / (points - 1)
    grid = peaks.filter("amp > 0").select(*LINE, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("to")).withColumn(
        "mm", F.lit(-reach) + F.col("to") * F.lit(step)
    )
    found = locate(nodes.select(*LINE, "idx", "mm"), grid, LINE).filter("inside").join(peaks, LINE)

    def bell(at: str):
        return F.exp(F.lit(-0.5) * F.col(at) * F.col(at)) / F.col("peak")

    share = (F.col("mm") - F.col("lo_mm")) / (F.col("hi_mm") - F.col("lo_mm"))
    value = bell("lo_mm") + (bell("hi_mm") - bell("lo_mm")) * share
    averaged = found.groupBy("target", F.col("to").alias("point")).agg(F.avg(value).alias("value"))
    whole = grid.select("target", F.col("to").alias("point"), F.col("mm").alias("z")).distinct()
    return whole.join(averaged, ["target", "point"], "left").select("target", "point", "z", "value")

