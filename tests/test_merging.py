"""Merged forecasts, histograms, the search for earlier forecasts and scales, against numpy and plain Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricecast.operators import aggregates, joins, scaling
from pricecast.sources.scratch import settle


@pytest.fixture(scope="module")
def copies(spark):
    rng = np.random.default_rng(2)
    rows = []
    for hour, n in enumerate((1, 2, 7, 40)):
        for c in range(n):
            samples = [None if rng.random() < 0.2 else float(x) for x in rng.normal(0, 5, 6).round(3)]
            rows.append(("P", dt.datetime(2024, 1, 1, hour), float(c), samples, c == 3))
    return spark.createDataFrame(rows, "product string, timestamp timestamp, point_forecast double, samples array<double>, is_fallback boolean")


@pytest.mark.parametrize("how", ["mean", "median"])
@pytest.mark.parametrize("most, keep", [(1000, lambda df: df), (1000, settle), (5, settle), (5, lambda df: df), (0, settle)])
def test_merged_forecasts_do_not_depend_on_the_block(copies, how, most, keep):
    got = {r.timestamp.hour: r for r in aggregates.aggregate_forecasts(copies, how, keep, most).collect()}
    rows = copies.collect()
    assert sorted(got) == [0, 1, 2, 3]
    for hour, r in got.items():
        mine = [x for x in rows if x.timestamp.hour == hour]
        pick = np.mean if how == "mean" else np.median
        assert r.point_forecast == pytest.approx(pick([x.point_forecast for x in mine]))
        for p in range(6):
            known = [x.samples[p] for x in mine if x.samples[p] is not None]
            assert r.samples[p] == (pytest.approx(pick(known)) if known else None)
        assert r.is_fallback == any(x.is_fallback for x in mine)


def test_histogram_counts_every_sample(spark):
    rng = np.random.default_rng(3)
    rows = [("P", i, [float(x) for x in rng.normal(0, 1, n).round(2)]) for i, n in enumerate((1, 2, 50, 333))] + [("P", 9, [4.0] * 7)]
    df = spark.createDataFrame(rows, "product string, timestamp long, samples array<double>")
    got = {}
    for r in aggregates.histogram(df, 10).orderBy("timestamp", "bin").collect():
        got.setdefault(r.timestamp, []).append((r.sample_count, r.density))
    for _, i, samples in rows:
        low, width = min(samples), (max(samples) - min(samples)) / 10
        places = [min(int((x - low) // width), 9) if width else 0 for x in samples]
        counts = [n for n, _ in got[i]]
        assert sum(counts) == len(samples)
        # A value on an edge may be a rounding error away from it in the one or the other computation.
        assert np.abs(np.array(counts) - np.bincount(places, minlength=10)).sum() <= 2
        assert [d for _, d in got[i]] == ([None] * 10 if width == 0 else [pytest.approx(n / (len(samples) * width)) for n in counts])


@pytest.mark.parametrize("back", [1, 7, 365])
@pytest.mark.parametrize("keep", [None, settle])
def test_the_newest_earlier_forecast(spark, back, keep):
    day = dt.date(2024, 1, 1)
    rng = np.random.default_rng(back)
    index = [("a", day + dt.timedelta(int(d)), int(d)) for d in rng.choice(800, 60, replace=False)] + [(None, day, 1), ("c", day, 5)]
    targets = [(p, day + dt.timedelta(int(d))) for p in ("a", "b") for d in rng.integers(-5, 900, 120)] + [(None, day + dt.timedelta(1)), ("c", day)]
    found = joins.days_back(
        spark.createDataFrame(targets + targets[:9], "product string, target_date date"),
        spark.createDataFrame(index, "product string, forecast_date date, number long"),
        back,
        **({"settle": keep} if keep else {}),
    )
    want = set()
    for p, d in set(targets):
        ages = [((d - f).days, f, n) for q, f, n in index if p is not None and q == p and 1 <= (d - f).days <= back]
        if ages:
            want.add((p, d, *min(ages)))
    rows = [tuple(r) for r in found.select("product", "target_date", "age_days", "forecast_date", "number").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_the_search_costs_the_same_for_any_look_back(spark):
    targets = spark.createDataFrame([("a", dt.date(2024, 1, 9))], "product string, target_date date")
    index = spark.createDataFrame([("a", dt.date(2024, 1, 2))], "product string, forecast_date date")
    plans = [joins.days_back(targets, index, n)._jdf.queryExecution().optimizedPlan().toString() for n in (7, 3650)]
    assert all("Generate" not in p for p in plans)
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())


def test_a_scale_of_rounding_errors_counts_as_one(spark):
    near = [1.0, 1.0 - 2**-53, 1.0 + 2**-52] * 50
    df = spark.createDataFrame([(x, 0.0, float(i)) for i, x in enumerate(near)], "near double, zero double, real double")
    for method in ("standard", "minmax", "robust"):
        scale = {r["column"]: r["scale"] for r in scaling.fit(df, ["near", "zero", "real"], method).collect()}
        assert scale["near"] == scale["zero"] == 1.0 and scale["real"] > 10
    scaled = scaling.apply(df, scaling.fit(df, ["near"]), ["near"])
    assert scaled.agg(F.max(F.abs("near"))).first()[0] < 1e-12
