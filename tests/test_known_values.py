"""Small frames with answers worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pricecast.functions import arrays, calendar
from pricecast.operators import aggregates, align, features, intervals, joins, metrics, normalize, present, topk, uncertainty, validate


def one(df):
    return df.collect()[0].asDict()


def test_metrics_of_a_constant_offset(frame):
    pairs = frame("actual double, forecast double", [(float(n), n + 0.5) for n in range(1, 6)])
    got = one(metrics.accuracy(pairs))
    assert got["rmse"] == pytest.approx(0.5) and got["mae"] == pytest.approx(0.5) and got["bias"] == pytest.approx(0.5)
    assert got["r2"] == pytest.approx(1 - 1.25 / 10)
    losses = one(pairs.agg(*[metrics.pinball(F.col("actual"), F.col("forecast"), q).alias(str(q)) for q in (0.1, 0.5, 0.9)]))
    assert losses["0.1"] == pytest.approx(0.45) and losses["0.5"] == pytest.approx(0.25) and losses["0.9"] == pytest.approx(0.05)


def test_metric_edge_rules(frame):
    zero = frame("actual double, forecast double", [(0.0, 1.0), (2.0, 2.0)])
    assert one(metrics.accuracy(zero))["mape"] is None
    flat = frame("actual double, forecast double", [(2.0, 2.0), (2.0, 2.0)])
    assert one(metrics.accuracy(flat))["r2"] == 1.0
    assert one(metrics.accuracy(flat.withColumn("forecast", F.lit(3.0))))["r2"] == 0.0
    assert one(metrics.accuracy(flat.limit(1)))["r2"] is None
    with pytest.raises(ValueError):
        metrics.pinball(F.col("actual"), F.col("forecast"), 1.0)


def test_step_quantile_takes_the_91st_of_100(frame):
    rows = frame("samples array<double>", [([float(n) for n in range(100, 0, -1)],)])
    assert one(rows.select(arrays.step_quantile(F.col("samples"), 0.9).alias("q")))["q"] == 91.0


def test_resampling_keeps_empty_bins(frame):
    rows = frame(
        "key string, timestamp string, x double",
        [("a", f"2024-01-01 {t}", v) for t, v in (("01:15:00", 10.0), ("02:30:00", 20.0), ("03:45:00", 30.0), ("05:00:00", 40.0))],
    )
    got = align.resample(rows, ["key"], "1 hour", {"mean": ("x", "avg"), "total": ("x", "sum")}).orderBy("timestamp")
    assert [(r["timestamp"].hour, r["mean"], r["total"]) for r in got.collect()] == [
        (1, 10.0, 10.0), (2, 20.0, 20.0), (3, 30.0, 30.0), (4, None, 0.0), (5, 40.0, 40.0),
    ]


def test_alignment_repeats_the_end_and_leaves_the_start(frame, at):
    a = frame("timestamp string, x double", [(at(1), 10.0), (at(2), 20.0), (at(3), 30.0)])
    b = frame("timestamp string, x double", [(at(2), 15.0), (at(3), 25.0), (at(4), 35.0)])
    got = align.align({"a": (a, ()), "b": (b, ())})
    assert [r["x"] for r in got["a"].orderBy("timestamp").collect()] == [10.0, 20.0, 30.0, 30.0]
    assert [r["x"] for r in got["b"].orderBy("timestamp").collect()] == [None, 15.0, 25.0, 35.0]


def test_range_ending_at_midnight_includes_the_day(frame, at):
    rows = frame("timestamp string, x double", [(at(n), 1.0) for n in (0, 23, 24, 47)] + [(at(48), 1.0)])
    when = lambda s: F.lit(s).cast("timestamp")
    assert present.by_date_range(rows, when(at(0)), when(at(24))).count() == 4
    assert present.by_date_range(rows, when(at(0)), when("2024-01-02 00:00:01")).count() == 3


def test_ratio_floor_and_cap(frame):
    rows = frame("load_mw double, total_generation double", [(100.0, 0.0), (9.0, 0.9), (10.0, 20.0)])
    got = [r["r"] for r in rows.select(features.load_generation_ratio().alias("r")).collect()]
    assert got == [10.0, 10.0, 0.5]


def test_fuel_mix_diversity(frame):
    rows = frame("a double, b double", [(5.0, 5.0), (5.0, 0.0), (0.0, 0.0), (5.0, None), (3.0, 1.0)])
    got = [r["d"] for r in rows.select(features.mix_entropy(["a", "b"]).alias("d")).collect()]
    assert got[:4] == [pytest.approx(1.0), 0.0, 0.0, 0.0]
    assert got[4] == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)) / math.log(2))


def test_load_features_of_a_short_series(frame, at):
    rows = frame("timestamp string, load_mw double", [(at(0), 100.0), (at(1), 150.0), (at(2), None), (at(3), 300.0)])
    got = features.load_features(rows).orderBy("timestamp").collect()
    assert [r["load_rate_of_change"] for r in got] == [pytest.approx(50.0), pytest.approx(50.0), 0.0, pytest.approx(100.0)]
    assert [r["load_mw"] for r in got] == [100.0, 150.0, 300.0, 300.0]
    assert got[0]["load_daily_peak"] == pytest.approx(1 / 3)


def test_lags_need_positive_whole_periods(frame, at):
    rows = frame("timestamp string, x double", [(at(n), float(n)) for n in range(3)])
    assert [r["x_lag_2"] for r in features.lags(rows, ["x"], [2]).orderBy("timestamp").collect()] == [None, None, 0.0]
    with pytest.raises(ValueError):
        features.lags(rows, ["x"], [0])


def test_hour_categories_and_feature_lists(spark):
    got = {r["h"]: r["c"] for r in spark.range(24).select(F.col("id").alias("h"), features.hour_categories(F.col("id")).alias("c")).collect()}
    assert got[3] == ["off_peak_hours"] and got[16] == ["peak_hours", "solar_hours", "evening_ramp"] and got[23] == ["off_peak_hours"]
    listed = features.feature_list("RTLMP", 12, ["load_mw", "solar_generation", "hour"])
    assert listed == ["load_mw", "hour", "solar_generation"]


def test_sample_statistics_edges(frame):
    rows = frame("samples array<double>", [([1.0, 3.0],), ([2.0, 2.0, 2.0, 2.0],), ([0.0, 0.0, 0.0, 4.0],)])
    got = rows.select(*[c.alias(n) for n, c in arrays.statistics(F.col("samples")).items()]).collect()
    assert (got[0]["skew"], got[0]["kurtosis"], got[0]["std"]) == (0.0, 0.0, 1.0)
    assert (got[1]["skew"], got[1]["kurtosis"]) == (0.0, 0.0)
    assert got[2]["skew"] == pytest.approx(1.1547005) and got[2]["kurtosis"] == pytest.approx(-0.6666667)


def test_wide_and_array_samples_round_trip(spark, frame):
    from pricecast.operators import reshape

    rows = frame("id int, samples array<double>", [(1, [float(x) for x in range(12)])])
    wide = reshape.array_to_wide(rows, 12)
    assert wide.columns == ["id", *[f"sample_{n:03d}" for n in range(1, 13)]]
    assert one(reshape.wide_to_array(wide))["samples"] == [float(x) for x in range(12)]


def test_percentiles_rise_with_the_level(frame):
    rows = frame("samples array<double>", [([3.0, 1.0, 2.0, 10.0],)])
    got = one(intervals.percentile_columns(rows, (0, 10, 50, 90, 100)))
    found = [got[f"p{q}"] for q in (0, 10, 50, 90, 100)]
    assert found == sorted(found) and found[0] == 1.0 and found[2] == 2.5 and found[-1] == 10.0


def test_products_match_in_any_case(frame):
    rows = frame("timestamp string, product string, price string, node string", [("2024-01-01 00:00:00", p, "1.5", "hb") for p in ("regup", "REGDOWN", "other")])
    assert sorted(r["product"] for r in normalize.normalize(rows, "price").collect()) == ["RegDown", "RegUp"]


def test_bad_records_are_kept_apart(frame):
    raw = frame("Timestamp string, load_mw string, region string", [("2024-01-01 00:00:00", "5", "a"), ("never", "5", "a"), ("2024-01-01 00:00:00", "x", "a"), ("2024-01-01 00:00:00", "-1", "a"), ("2024-01-01 00:00:00", "5", " ")])
    good, bad = normalize.split_records(raw, "load")
    assert good.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == ["bad timestamp", "bad value", "empty region", "load not positive"]


def test_missing_columns_fail_before_any_job(frame):
    with pytest.raises(ValueError):
        validate.load_feed(frame("timestamp string, load_mw double", []))


def test_completeness_kinds(frame, at):
    # Products A, B, C over hours 0..2: C is absent, hour 2 is absent for all, A lacks hour 1.
    rows = frame("product string, timestamp string", [("A", at(0)), ("B", at(0)), ("B", at(1))])
    starts = frame("timestamp string", [(at(0),)]).withColumnRenamed("timestamp", "start")
    got = validate.completeness(rows, starts, "start", ["A", "B", "C"], 3)
    kinds = sorted((r["kind"], r["product"], r["timestamp"].hour) for r in got.collect())
    assert [k for k in kinds if k[0] == "missing_products"] == [("missing_products", "C", h) for h in range(3)]
    assert [k for k in kinds if k[0] == "missing_timestamps"] == [("missing_timestamps", p, 2) for p in "ABC"]
    assert [k for k in kinds if k[0] == "partial_missing"] == [("partial_missing", "A", 1), ("partial_missing", "A", 2), ("partial_missing", "B", 2)]


def forecast(frame, rows):
    return frame("product string, timestamp string, point_forecast double", rows)


def test_equal_prices_break_the_order(frame, at):
    rows = forecast(frame, [("DALMP", at(0), 10.0), ("RegUp", at(0), 10.0), ("RTLMP", at(1), 9.0), ("RRS", at(1), None)])
    got = sorted(r["message"] for r in validate.product_order(rows).collect())
    assert got == ["DALMP greater_than RegUp does not hold", "RTLMP greater_than RRS does not hold"]


def test_smoothness_skips_a_previous_zero(frame, at):
    rows = forecast(frame, [("A", at(0), 100.0), ("A", at(1), 131.0), ("A", at(2), 0.0), ("A", at(3), 50.0)])
    got = [(r["timestamp"].hour, r["value"]) for r in validate.smoothness(rows).orderBy("timestamp").collect()]
    assert got == [(1, pytest.approx(0.31)), (2, pytest.approx(1.0))]


def test_one_row_has_no_outlier_and_ranges_count_nulls(frame, at):
    assert validate.forecast_outliers(forecast(frame, [("DALMP", at(0), 5.0)])).count() == 0
    got = validate.value_ranges(forecast(frame, [("RRS", at(0), None), ("RRS", at(1), 501.0), ("X", at(0), -9e9)]))
    assert got.count() == 2


def test_point_must_lie_near_its_samples(frame, at):
    rows = frame("product string, timestamp string, point_forecast double, samples array<double>", [("A", at(0), 89.0, [100.0, 120.0]), ("A", at(1), 90.0, [100.0, 120.0]), ("A", at(2), -100.0, [-100.0, -90.0])])
    assert [r["timestamp"].hour for r in validate.sample_bounds(rows).orderBy("timestamp").collect()] == [0, 2]
    assert [r["timestamp"].hour for r in validate.sample_bounds(rows, absolute=True).collect()] == [0]


def test_error_trend_rules(frame):
    rows = frame("product string, hour int, timestamp string, residual double, pct_error double", [("A", 0, f"2024-01-0{d}", 2.0, 0.1) for d in (1, 2, 3)] + [("B", 0, f"2024-01-0{d}", float(d), 0.1) for d in range(1, 7)])
    from pricecast.operators import models

    summary = models.residual_summary(rows)
    points = frame("product string, hour int, point_forecast double", [("A", 0, 10.0), ("B", 0, 10.0), ("C", 0, 10.0)])
    flat = {p: 1.0 for p in "ABC"}
    got = {r["product"]: r["std"] for r in uncertainty.estimate(points, summary, default="adaptive", factors=flat).collect()}
    plain = {r["product"]: r["std"] for r in uncertainty.estimate(points, summary, default="residuals", factors=flat).collect()}
    assert got["A"] == plain["A"] == pytest.approx(0.5)  # no spread: 5 % of the point; too few errors for a trend
    assert got["B"] == pytest.approx(plain["B"] * (1 + (5 - 2) / 2))
    assert got["C"] == pytest.approx(1.0)  # no history: 10 %


def test_nearest_prefers_the_earlier_of_two(frame, at):
    rows = frame("product string, timestamp string, x double", [("A", at(0), 1.0), ("A", at(2), 2.0), ("A", at(5), 3.0)])
    targets = frame("product string, target string", [("A", at(1)), ("A", at(4)), ("A", at(99)), ("A", at(0)), ("B", at(0))])
    got = {(r["product"], r["target"].day, r["target"].hour): r["x"] for r in joins.nearest(targets, rows, ["product"], "x").collect()}
    assert got == {("A", 1, 1): 1.0, ("A", 1, 4): 3.0, ("A", 5, 3): 3.0, ("A", 1, 0): 1.0, ("B", 1, 0): None}


def test_merge_needs_a_suffix_per_frame(frame, at):
    a = frame("timestamp string, x double", [(at(0), 1.0)])
    assert joins.merge_frames([a, a, a], suffixes=["b", "c"]).columns == ["timestamp", "x", "x_b", "x_c"]
    with pytest.raises(ValueError):
        joins.merge_frames([a, a], suffixes=[])


def test_best_by_absolute_bias(frame):
    rows = frame("method string, bias double", [("a", -3.0), ("b", 2.0), ("c", None)])
    assert one(topk.best(rows, "bias", "method"))["method"] == "b"


@pytest.mark.parametrize("day, length", [("2024-03-10", 23), ("2024-06-01", 24), ("2024-11-03", 25)])
def test_clock_changes(spark, day, length):
    ends = spark.sql(f"select timestamp_ntz'{day} 00:00:00' a, timestamp_ntz'{day} 00:00:00' + interval 1 day b")
    got = one(ends.select((calendar.localize(F.col("b")) - calendar.localize(F.col("a"))).alias("d")))["d"]
    assert got == dt.timedelta(hours=length)


def test_prices_as_text(frame):
    rows = frame("x double, signed boolean", [(1234.5, True), (-5.0, True), (-5.0, False), (None, True)])
    got = [r["t"] for r in rows.select(calendar.money(F.col("x"), F.col("signed")).alias("t")).collect()]
    assert got == ["$1234.50", "$-5.00", "$0.00", "-"]


def test_forecasts_are_merged_elementwise(frame, at):
    rows = frame("product string, timestamp string, point_forecast double, samples array<double>, is_fallback boolean", [("A", at(0), 1.0, [1.0, 10.0], False), ("A", at(0), 2.0, [2.0, 20.0], True), ("A", at(0), 6.0, [6.0, 90.0], False)])
    mean = one(aggregates.aggregate_forecasts(rows, "mean"))
    assert mean["point_forecast"] == 3.0 and mean["samples"] == [3.0, 40.0] and mean["is_fallback"]
    assert one(aggregates.aggregate_forecasts(rows, "median"))["samples"] == [2.0, 20.0]
