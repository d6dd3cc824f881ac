"""Histograms and quantiles, against NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from eddyfield.operators import distribution, profile, select


def samples_of(spark, values, group="a"):
    return spark.createDataFrame([(group, None if np.isnan(v) else float(v)) for v in values], "g string, c double")


@pytest.mark.parametrize("width", [0.1, 0.07, 0.25])
def test_pdf_matches_numpy(spark, width):
    values = np.concatenate([np.random.default_rng(2).random(500), [0.1, 0.2, 0.3, 0.7, 1.0, -0.4, np.nan]])
    present = values[~np.isnan(values)]
    edges = np.arange(0, present.max() + width, width)
    if edges[-1] < present.max():
        edges = np.append(edges, present.max())
    want, _ = np.histogram(present, bins=edges, density=True)
    rows = distribution.concentration_pdf(samples_of(spark, values), ["g"], width).orderBy("bin").collect()
    assert [r["pdf"] for r in rows] == pytest.approx(want.tolist())
    assert sum(r["pdf"] * (r["right"] - r["left"]) for r in rows) == pytest.approx(1.0)


def test_pdf_of_a_constant(spark):
    rows = distribution.concentration_pdf(samples_of(spark, np.full(7, 0.3)), ["g"], 0.1).collect()
    assert sum(r["n"] for r in rows) == 7


def test_uneven_histogram(spark):
    edges = [-0.5, 0.0, 0.1, 0.5, 0.6, 1.0]
    values = np.concatenate([np.random.default_rng(4).random(300), [1.0, 0.1, 0.6, 1.2, -0.6]])
    want, _ = np.histogram(values, bins=edges, density=True)
    rows = distribution.histogram_density(samples_of(spark, values), ["g"], edges).orderBy("bin").collect()
    assert [r["pdf"] for r in rows] == pytest.approx(want.tolist())
    with pytest.raises(ValueError):
        distribution.histogram_density(samples_of(spark, values), ["g"], [0.0, 0.0, 1.0])


@pytest.mark.parametrize("kind", ["normal", "hot value", "wide range", "one", "two"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(9)
    values = {
        "normal": rng.normal(size=5001),
        "hot value": np.concatenate([np.full(3000, 0.25), rng.random(2000)]),
        "wide range": np.concatenate([rng.random(2000) * 1e-9, rng.random(50) * 1e9, [np.nan]]),
        "one": np.array([4.0]),
        "two": np.array([1.0, 2.0]),
    }[kind]
    percents = [0, 0.1, 5, 33.3, 50, 90, 99.9, 100]
    got = distribution.order_statistics(samples_of(spark, values), ["g"], "c", percents).collect()
    want = np.percentile(values[~np.isnan(values)], percents)
    assert {r["percent"]: r["value"] for r in got} == pytest.approx(dict(zip(map(float, percents), want)), rel=1e-12)


def test_report_of_an_empty_field(spark):
    empty = spark.createDataFrame([("a", 0, 0, None)], "case_id string, y int, x int, f double")
    row = distribution.field_report(empty, "f").first()
    assert row["pixels"] == 0 and row["mean"] is None and row["p50"] is None


def test_zscore_of_a_constant_field(spark):
    flat = spark.createDataFrame([("a", 0, i, 2.0) for i in range(4)], "case_id string, y int, x int, f double")
    assert [r["f"] for r in select.zscore_field(flat, "f").collect()] == [0.0] * 4


def test_minmax_refuses_a_flat_profile(spark):
    flat = spark.createDataFrame([("a", float(i), 2.0) for i in range(4)], "case_id string, pos double, value double")
    with pytest.raises(Exception, match="zero range"):
        select.minmax_profile(flat, ["case_id"]).collect()


def line_of(spark, values):
    rows = [("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "case_id string, pos int, value double")


@pytest.mark.parametrize("k", [1, 2, 3, 4, 7])
def test_moving_average(spark, k):
    values = np.random.default_rng(1).random(9)
    values[4] = np.nan
    want = np.convolve(np.pad(values, k // 2, mode="edge"), np.ones(k) / k, mode="valid") if k > 1 else values
    rows = profile.moving_average(line_of(spark, values), k).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(len(want)))
    assert np.allclose([np.nan if r["value"] is None else r["value"] for r in rows], want, equal_nan=True)


@pytest.mark.parametrize("n, m", [(9, 1), (9, 2), (9, 5), (9, 11), (28, 50), (1, 4)])
def test_even_sample(spark, n, m):
    want = np.unique(np.linspace(0, n - 1, m, dtype=int))
    rows = profile.even_sample(line_of(spark, np.arange(float(n))), m).collect()
    assert sorted(r["pos"] for r in rows) == want.tolist()
