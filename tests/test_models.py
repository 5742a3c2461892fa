from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricecast.functions import gauss
from pricecast.operators import models, sampling, scaling


def test_least_squares_equals_numpy_also_without_full_rank(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for product in ("A", "B"):
        x = rng.normal(1e4, 3, (80, 3))
        if product == "B":
            x[:, 2] = x[:, 0] + x[:, 1]  # dependent columns: the minimum-norm solution
        y = x @ [2.0, -1.0, 0.5] + 7 + rng.normal(0, 0.1, 80)
        centred = x - x.mean(0)
        want[product] = np.linalg.lstsq(centred, y - y.mean(), rcond=1e-10)[0]
        rows += [(product, 1, *map(float, xs), float(v)) for xs, v in zip(x, y)]
    df = spark.createDataFrame(rows, "product string, hour int, a double, b double, c double, y double")
    got = {r["product"]: r for r in models.train(df, ["a", "b", "c"], "y").collect()}
    for product, slope in want.items():
        np.testing.assert_allclose(got[product]["coefficients"], slope, rtol=1e-4)
        assert got[product]["metrics"]["r2"] > 0.99
    scored = models.predict(df, models.train(df, ["a", "b", "c"], "y"), ["a", "b", "c"])
    error = scored.select(F.max(F.abs(F.col("point_forecast") - F.col("y")))).first()[0]
    assert error < 1.0


def test_nulls_in_training_data_are_an_error(spark):
    df = spark.createDataFrame([("A", 1, 1.0, 2.0), ("A", 1, None, 3.0)], "product string, hour int, a double, y double")
    with pytest.raises(Exception, match="nulls in training data"):
        models.train(df, ["a"], "y").collect()


@pytest.mark.parametrize("method", scaling.METHODS)
def test_scalers_invert(spark, method):
    rng = np.random.default_rng(2)
    rows = [("k", float(a), 3.0, None) for a in rng.normal(10, 4, 101)]
    df = spark.createDataFrame(rows, "key string, a double, flat double, empty double")
    scalers = scaling.fit(df, ["a", "flat", "empty", "key"], method, ["key"])
    assert sorted(r["column"] for r in scalers.collect()) == ["a", "flat"]
    there = scaling.apply(df, scalers, ["a", "flat"], ["key"])
    back = scaling.invert(there, scalers, ["a", "flat"], ["key"])
    a = np.sort([r["a"] for r in df.collect()])
    np.testing.assert_allclose(np.sort([r["a"] for r in back.collect()]), a)
    if method == "robust":
        q1, q2, q3 = np.quantile(a, [0.25, 0.5, 0.75])
        np.testing.assert_allclose(np.sort([r["a"] for r in there.collect()]), (a - q2) / (q3 - q1))
    if method == "standard":
        got = [r["a"] for r in there.collect()]
        assert abs(np.mean(got)) < 1e-9 and np.std(got) == pytest.approx(1.0)


@pytest.mark.parametrize("name", list(sampling.DISTRIBUTIONS))
def test_samples_repeat_and_keep_their_shape(frame, at, name):
    rows = frame("product string, timestamp string, point_forecast double, std double", [("DALMP", at(n), 50.0, 5.0) for n in range(40)] + [("RRS", at(0), 1.0, 5.0)])
    first = sampling.draw(rows, 100, default=name)
    again = sampling.draw(rows.repartition(5), 100, default=name)
    assert first.exceptAll(again).count() == 0
    drawn = {}
    for r in first.collect():
        drawn.setdefault(r["product"], []).extend(r["samples"])
    energy = np.array(drawn["DALMP"])
    assert min(drawn["RRS"]) >= 0.0
    if name == "truncated_normal":
        assert energy.min() >= 35.0 and energy.max() <= 65.0
    if name in ("normal", "truncated_normal"):
        assert energy.mean() == pytest.approx(50, abs=0.4) and energy.std() == pytest.approx(5, abs=0.4)
    if name == "lognormal":
        assert energy.mean() == pytest.approx(50, abs=0.4) and energy.std() == pytest.approx(5, abs=0.4)
    if name == "skewed_normal":
        assert energy.mean() > 52


def test_unusable_rows_are_rejected(frame, at):
    rows = frame("product string, timestamp string, point_forecast double, std double", [("DALMP", at(0), 50.0, 5.0), ("DALMP", at(1), float("nan"), 5.0), ("DALMP", at(2), 50.0, 0.0), ("X", at(3), 50.0, 1.0), ("DALMP", at(4), None, 1.0)])
    good, bad = sampling.split_inputs(rows)
    assert good.count() == 1 and bad.count() == 4


def test_normal_columns_equal_the_standard_library(spark):
    unit = NormalDist()
    p = [1e-300, 1e-15, 1e-9, 1e-6, 0.001, 0.02, 0.074, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.9999, 1 - 1e-12]
    x = [-38.0, -12.0, -7.1, -7.07, -3.0, -0.5, 0.0, 1e-9, 0.3, 2.0, 5.0, 7.2, 9.0]
    got = spark.createDataFrame([(v,) for v in p], "p double").select("p", gauss.quantile(F.col("p"))).collect()
    assert all(q == pytest.approx(unit.inv_cdf(v), rel=1e-13, abs=1e-15) for v, q in got)
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", gauss.below(F.col("x"))).collect()
    assert all(q == pytest.approx(unit.cdf(v), rel=1e-9, abs=1e-15) for v, q in got)


def test_truncated_samples_lie_between_their_bounds(spark):
    rows = spark.createDataFrame([("a", 10.0, 2.0, 9.0, 10.5), ("b", -5.0, 1.0, 0.0, 3.0)], "k string, p double, s double, lo double, hi double")
    drawn = rows.select("*", sampling.truncated(F.col("p"), F.col("s"), F.col("k"), 3, 400, F.col("lo"), F.col("hi")).alias("x"))
    assert "Python" not in drawn._jdf.queryExecution().toString()
    for r in drawn.collect():
        unit = NormalDist(r.p, r.s)
        a, b = unit.cdf(r.lo), unit.cdf(r.hi)
        spread = np.sort([(unit.cdf(v) - a) / (b - a) for v in r.x])
        assert r.lo <= min(r.x) and max(r.x) <= r.hi
        # Back in probabilities the samples are even: the greatest distance from the diagonal stays small.
        assert np.abs(spread - (np.arange(400) + 0.5) / 400).max() < 0.09


@pytest.mark.parametrize("k, dependent", [(7, ()), (9, (3, 8)), (60, ()), (60, (10, 11, 59))])
def test_many_features_equal_numpy(spark, k, dependent):
    rng = np.random.default_rng(k)
    rows, want = [], {}
    for hour in range(3):
        x = rng.normal(0, 1, (4 * k, k)) * rng.uniform(0.1, 1e4, k) + rng.uniform(-1e5, 1e5, k)
        for d in dependent:
            x[:, d] = x[:, 0] - 2 * x[:, 1] if d % 2 else 7.0  # a combination of others, or a constant
        y = x @ rng.normal(0, 1, k) / 100 + rng.normal(0, 1, len(x))
        centred, target = x - x.mean(0), y - y.mean()
        want[hour] = np.linalg.lstsq(centred, target, rcond=1e-9)[0], x, y
        rows += [("P", hour, *map(float, xs), float(v)) for xs, v in zip(x, y)]
    names = [f"f{i}" for i in range(k)]
    df = spark.createDataFrame(rows, ["product", "hour", *names, "y"])
    trained = models.train(df, names, "y")
    assert "Python" not in trained._jdf.queryExecution().executedPlan().toString()
    for r in trained.collect():
        slope, x, y = want[r.hour]
        np.testing.assert_allclose(r.coefficients, slope, rtol=1e-4, atol=1e-7)
        left = y - x @ np.array(r.coefficients) - r.intercept
        assert r.metrics["rmse"] == pytest.approx(np.sqrt((left**2).mean()), rel=1e-5)
        # Residuals are orthogonal to every feature.
        assert np.abs(((x - x.mean(0)) / (x.std(0) + 1e-9) * left[:, None]).mean(0)).max() < 1e-5
