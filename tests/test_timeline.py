"""Split series against an unsplit computation in pandas, with chunks small enough to split everything."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricecast.functions import timeline
from pricecast.functions.quantiles import exact_quantiles
from pricecast.sources.scratch import settle

HOUR = 3600


@pytest.fixture(scope="module")
def series():
    """Two series with gaps and nulls; one holds most of the rows."""
    rng = np.random.default_rng(5)
    parts = []
    for key, hours in (("hot", 400), ("cold", 60)):
        kept = np.sort(rng.choice(hours, int(hours * 0.7), replace=False))
        x = rng.normal(50, 20, len(kept)).round(2)
        x[rng.random(len(kept)) < 0.3] = np.nan
        parts.append(pd.DataFrame({"key": key, "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(kept, "h"), "x": x}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def df(spark, series):
    raw = spark.createDataFrame(series.astype({"timestamp": "datetime64[us]"}))
    return raw.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def collected(df, *columns):
    out = df.toPandas().sort_values(["key", "timestamp"]).reset_index(drop=True)
    return out[list(columns)].astype(float).to_numpy()


def expected(series, f):
    ordered = series.sort_values(["key", "timestamp"])
    return pd.concat([f(g.set_index("timestamp")["x"]) for _, g in ordered.groupby("key")]).to_numpy(dtype=float)


@pytest.mark.parametrize("chunk", [5 * HOUR, 24 * HOUR, timeline.CHUNK_SECONDS])
def test_fill_does_not_depend_on_the_chunk(df, series, chunk):
    forward = timeline.fill(df, ["key"], "timestamp", ["x"], chunk_seconds=chunk)
    both = timeline.fill(df, ["key"], "timestamp", ["x"], ("backward", "forward"), chunk_seconds=chunk)
    np.testing.assert_allclose(collected(forward, "x")[:, 0], expected(series, lambda s: s.ffill()))
    np.testing.assert_allclose(collected(both, "x")[:, 0], expected(series, lambda s: s.bfill().ffill()))


@pytest.mark.parametrize("chunk", [7 * HOUR, timeline.CHUNK_SECONDS])
def test_interpolation_is_linear_in_time(df, series, chunk):
    got = timeline.interpolate(df, ["key"], "timestamp", ["x"], chunk_seconds=chunk)
    np.testing.assert_allclose(collected(got, "x")[:, 0], expected(series, lambda s: s.interpolate("time")))


@pytest.mark.parametrize("blocks", [1, 2, 64])
def test_trailing_windows_match_time_based_rolling(df, series, blocks, monkeypatch):
    monkeypatch.setattr(timeline, "BLOCK_LOOKBACKS", blocks)
    got = timeline.trailing(
        df,
        ["key"],
        "timestamp",
        {"mean_24": (24 * HOUR, lambda: F.avg("x")), "std_5": (5 * HOUR, lambda: F.stddev_samp("x"))},
    )
    assert got.count() == len(series)
    values = collected(got, "mean_24", "std_5")
    np.testing.assert_allclose(values[:, 0], expected(series, lambda s: s.rolling("24h").mean()))
    np.testing.assert_allclose(values[:, 1], expected(series, lambda s: s.rolling("5h").std()), atol=1e-9)


@pytest.mark.parametrize("chunk", [1 * HOUR, 3 * HOUR, 30 * HOUR, timeline.CHUNK_SECONDS])
def test_row_lags_and_frames_cross_chunks(df, series, chunk):
    got = timeline.row_windows(
        df,
        ["key"],
        "timestamp",
        12,
        lambda w: {"lag_1": F.lag("x", 1).over(w()), "lag_12": F.lag("x", 12).over(w()), "std_8": F.stddev_samp("x").over(w(8))},
        ["x"],
        chunk_seconds=chunk,
    )
    assert got.count() == len(series)
    values = collected(got, "lag_1", "lag_12", "std_8")
    np.testing.assert_allclose(values[:, 0], expected(series, lambda s: s.shift(1)))
    np.testing.assert_allclose(values[:, 1], expected(series, lambda s: s.shift(12)))
    np.testing.assert_allclose(values[:, 2], expected(series, lambda s: s.rolling(8, min_periods=1).std()), atol=1e-9)


def test_same_result_under_one_and_many_partitions(df):
    shift = {"before": ("x", 3)}
    one = timeline.shift_rows(df.coalesce(1), ["key"], "timestamp", shift)
    many = timeline.shift_rows(df.repartition(8), ["key"], "timestamp", shift)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    data = {
        "wide": rng.lognormal(3, 2, 3001),
        "ties": rng.integers(-3, 4, 500).astype(float),
        "mixed": np.concatenate([rng.normal(0, 1e-7, 50), rng.normal(0, 1e7, 51)]),
        "one": np.array([4.5]),
    }
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("wide", None)]
    qs = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.975, "q10": 1.0}
    got = exact_quantiles(spark.createDataFrame(rows, "key string, v double"), ["key"], "v", qs)
    found = {r["key"]: [r[n] for n in qs] for r in got.collect()}
    for key, vs in data.items():
        np.testing.assert_allclose(found[key], np.quantile(vs, list(qs.values())), rtol=1e-12)


@pytest.fixture(scope="module")
def dense(spark):
    """One key with all rows of a day, many of them at the same times, and another with one row a month."""
    rng = np.random.default_rng(9)
    seconds = np.sort(rng.integers(0, 86_400, 4000))
    hot = pd.DataFrame({"key": "hot", "timestamp": pd.Timestamp("2024-03-05") + pd.to_timedelta(seconds, "s")})
    cold = pd.DataFrame({"key": "cold", "timestamp": pd.date_range("2023-01-01", periods=24, freq="30D")})
    both = pd.concat([hot, cold], ignore_index=True)
    both["id"] = np.arange(len(both))
    both["x"] = np.where(rng.random(len(both)) < 0.4, np.nan, rng.normal(0, 10, len(both)).round(3))
    df = spark.createDataFrame(both.astype({"timestamp": "datetime64[us]"})).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return df.repartition(3)


def same(a, b, *columns):
    left, right = (d.select("id", *columns).toPandas().sort_values("id").reset_index(drop=True) for d in (a, b))
    pd.testing.assert_frame_equal(left, right, check_exact=False, rtol=1e-9)


def test_a_dense_day_is_cut_by_counts(dense):
    chunks = timeline.Chunks.by_count(dense, ["key"], "timestamp", settle, rows=200)
    sizes = {(r["key"], r["_chunk"]): r["count"] for r in chunks.place(dense, ["key"], "timestamp").groupBy("key", "_chunk").count().collect()}
    hot = [n for (key, _), n in sizes.items() if key == "hot"]
    assert len(hot) >= 15 and max(hot) <= 300
    placed = chunks.place(dense, ["key"], "timestamp")
    ordered = placed.where("key = 'hot'").groupBy("_chunk").agg(F.min("_t"), F.max("_t")).orderBy("_chunk").collect()
    assert all(a[2] < b[1] for a, b in zip(ordered, ordered[1:]))
    assert timeline.Chunks.by_count(dense, ["key"], "timestamp", settle).cuts is None
    assert timeline.Chunks.by_count(dense.limit(0), ["key"], "timestamp", settle).cuts is None


def test_results_do_not_depend_on_cuts_by_count(dense, monkeypatch):
    chunks = timeline.Chunks.by_count(dense, ["key"], "timestamp", settle, rows=200)
    for strict in (False, True):
        # Rows of one time have no order among themselves, so only times with one row are compared.
        once = dense.dropDuplicates(["key", "timestamp"])
        plain = timeline.neighbours(once, ["key"], "timestamp", ["x"], strict=strict, times=True)
        split = timeline.neighbours(once, ["key"], "timestamp", ["x"], strict=strict, times=True, chunks=chunks)
        same(plain, split, "prev_x", "next_x", "prev_x_at", "next_x_at")
    same(timeline.interpolate(once, ["key"], "timestamp", ["x"]), timeline.interpolate(once, ["key"], "timestamp", ["x"], chunks=chunks), "x")
    wanted = {"before": ("x", 3), "long_before": ("x", 70)}
    plain = timeline.shift_rows(dense, ["key"], "timestamp", wanted, ["id"])
    monkeypatch.setattr(timeline, "ROWS_PER_CHUNK", 200)
    monkeypatch.setattr(timeline, "BLOCK_LOOKBACKS", 2)
    same(plain, timeline.shift_rows(dense, ["key"], "timestamp", wanted, ["id"], settle=settle), "before", "long_before")


@pytest.mark.parametrize("blocks", [2, 64])
def test_trailing_windows_in_dense_blocks(dense, blocks, monkeypatch):
    exprs = {"mean": (3600, lambda: F.avg("x")), "n": (600, lambda: F.count("x")), "most": (3600, lambda: F.max("x"))}
    plain = timeline.trailing(dense, ["key"], "timestamp", exprs)
    monkeypatch.setattr(timeline, "BLOCK_LOOKBACKS", blocks)
    for rows in (1, 150, 10_000):
        same(plain, timeline.trailing(dense, ["key"], "timestamp", exprs, settle, rows=rows), "mean", "n", "most")
