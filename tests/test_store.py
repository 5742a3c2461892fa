"""Round trips through the store, fallback, a whole run, streams and feed files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricecast import schemas
from pricecast.config import RunSettings
from pricecast.operators import models, validate
from pricecast.plans import daily
from pricecast.sources import feeds, scratch, store
from pricecast.streaming import feeds as streams


def when(text):
    return F.lit(text).cast("timestamp")


@pytest.fixture
def stored(spark, frame, tmp_path):
    """Two products on three dates, 24 hours each; RRS is missing on the last date."""
    rows = [
        (f"2024-01-0{d} {h:02d}:00:00", p, float(d * 100 + h), [float(d), float(h)], f"2024-01-0{d} 07:00:00", False, f"2024-01-0{d}")
        for d in (1, 2, 3)
        for h in range(24)
        for p in ("DALMP", "RRS")
        if (d, p) != (3, "RRS")
    ]
    df = frame("timestamp string, product string, point_forecast double, samples array<double>, generation_timestamp string, is_fallback boolean, forecast_date string", rows)
    path = str(tmp_path / "store")
    store.write(df.withColumn("forecast_date", F.col("forecast_date").cast("date")), path, when("2024-01-04"))
    return path


def test_a_rewrite_replaces_only_its_partition(spark, stored):
    before = store.read(spark, stored).count()
    one = store.read_one(store.read(spark, stored), F.lit("2024-01-02").cast("date"), "RRS")
    assert one.count() == 24
    store.write(one.drop(*validate.STORED_FIELDS).where("hour(timestamp) < 5"), stored, when("2024-01-05"))
    after = store.read(spark, stored)
    assert after.count() == before - 19
    info = {(str(r["forecast_date"]), r["product"]): str(r["storage_timestamp"]) for r in store.stored_metadata(after).collect()}
    assert info[("2024-01-02", "RRS")].startswith("2024-01-05") and info[("2024-01-02", "DALMP")].startswith("2024-01-04")


def test_delete_and_retention_drop_partitions(spark, stored):
    assert store.delete(spark, stored, [("2024-01-01", "RRS"), ("2030-01-01", "RRS")]) == 1
    assert store.read(spark, stored).where("product = 'RRS'").count() == 24
    assert store.clean(spark, stored, when("2024-01-04"), 2) == 1
    assert sorted({str(r[0]) for r in store.read(spark, stored).select("forecast_date").collect()}) == ["2024-01-02", "2024-01-03"]
    with pytest.raises(ValueError):
        store.read_range(store.read(spark, stored), "2024-01-03", "2024-01-01")
    with pytest.raises(ValueError):
        store.retained(store.read(spark, stored), when("2024-01-04"), 0)


def test_folder_names_are_escaped_as_spark_does(spark, tmp_path):
    value = "a=b/c:d%e'f[g]"
    spark.createDataFrame([(1, value)], "x int, product string").write.partitionBy("product").parquet(str(tmp_path / "t"))
    assert (tmp_path / "t" / f"product={store.folder_name(value)}").is_dir()


def test_reads_prune_partitions(spark, stored):
    one = store.read_one(store.read(spark, stored), F.lit("2024-01-02").cast("date"), "RRS")
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "forecast_date" in filters and "product" in filters


def test_failed_products_get_the_newest_earlier_forecast(spark, stored, frame):
    settings = RunSettings(products=["DALMP", "RRS"], sample_count=2, horizon_hours=24)
    earlier = store.read(spark, stored).drop(*validate.STORED_FIELDS)
    runs = frame("generation_timestamp string", [("2024-01-02 07:00:00",)]).withColumnRenamed("generation_timestamp", "run_time")
    fresh = earlier.where("forecast_date = '2024-01-03'")
    final, without = daily.with_fallback(fresh, runs, earlier, settings)
    rows = final.where("product = 'RRS'").orderBy("timestamp").collect()
    assert len(rows) == 24 and all(r["is_fallback"] for r in rows)
    assert str(rows[0]["timestamp"]) == "2024-01-03 00:00:00" and rows[0]["point_forecast"] == 200.0
    assert final.where("product = 'DALMP' and not is_fallback").count() == 24
    assert without.count() == 0


def test_a_run_stores_valid_forecasts_and_falls_back(spark, frame, at, tmp_path):
    hours = range(0, 24 * 14)
    load = frame("timestamp string, load_mw double", [(at(n), 100.0 + n % 24 + n % 7) for n in hours])
    prices = frame("timestamp string, product string, price double", [(at(n), p, b + n % 24) for n in range(24 * 10) for p, b in (("DALMP", 50.0), ("RRS", 5.0))])
    generation = frame("timestamp string, fuel_type string, generation_mw double", [(at(n), f, 40.0 + n % 5) for n in hours for f in ("wind", "gas")])
    settings = RunSettings(products=["DALMP", "RRS"], fuels=["wind", "gas"], sample_count=10)
    table = daily.feature_table(daily.Feeds(load, prices, generation), settings)
    trained = daily.train(table, ["load_mw"], settings)
    history = frame("product string, hour int, timestamp string, residual double, pct_error double", [("DALMP", h, at(h), 1.0, 0.1) for h in range(24)])
    summary = models.residual_summary(history)
    path = str(tmp_path / "run")

    def run(day, fitted):
        runs = frame("generation_timestamp string", [(f"{day} 07:00:00",)]).withColumnRenamed("generation_timestamp", "run_time")
        return daily.run(spark, path, runs, table, fitted, summary, ["load_mw"], settings, when("2024-02-01"))

    found = {r["category"]: r["violations"] for r in run("2024-01-09", trained)[0].collect()}
    assert found["schema"] == 0 and found["completeness"] == 0
    rows = store.read(spark, path)
    assert rows.count() == 2 * 72 and rows.where("is_fallback").count() == 0
    # The next day the models of one product are gone: its forecast is the one of the day before, moved.
    _, without = run("2024-01-10", trained.where("product = 'DALMP'"))
    assert without.count() == 0
    second = store.read(spark, path).where("forecast_date = '2024-01-11'")
    assert second.where("product = 'RRS' and is_fallback").count() == 72
    assert second.where("product = 'DALMP' and not is_fallback").count() == 72


def test_runs_are_checked_each_on_its_own(spark, frame, at):
    """Two overlapping constant forecasts, the second lacking a day: 24 missing cells and no jumps."""
    rows = [("2024-01-01", at(n), 10.0) for n in range(72)] + [("2024-01-02", at(n + 24), 20.0) for n in range(48)]
    df = frame("forecast_date string, timestamp string, point_forecast double", rows).withColumns(
        {"forecast_date": F.to_date("forecast_date"), "product": F.lit("RRS"), "samples": F.array(F.col("point_forecast")), "is_fallback": F.lit(False), "generation_timestamp": F.col("timestamp")}
    )
    starts = df.groupBy("forecast_date").agg(F.min("timestamp").alias("start"))
    found = validate.forecast(df, starts, "start", None, 1, ["RRS"], 72, ["forecast_date"])
    counts = {(str(r.forecast_date), r.category): r.violations for r in validate.summary(found, keys=["forecast_date"], forecasts=starts).collect()}
    cells = found.where("category = 'completeness' AND check = 'partial_missing'").groupBy("forecast_date").count().collect()
    assert [(str(r[0]), r[1]) for r in cells] == [("2024-01-02", 24)]
    assert counts[("2024-01-01", "all")] == 0 and counts[("2024-01-02", "consistency")] == 0


def test_feeds_read_from_files(spark, tmp_path):
    (tmp_path / "load.json").write_text(json.dumps({"data": [{"timestamp": "2024-01-01T05:00:00Z", "load_mw": 5.5, "region": "r"}] * 3}))
    assert feeds.read_envelope(spark, str(tmp_path / "load.json"), schemas.LOAD).count() == 3
    (tmp_path / "load.csv").write_text("timestamp,load_mw,region\n2024-01-01 05:00:00,5.5,r\n")
    row = feeds.read(spark, str(tmp_path / "load.csv"), schemas.LOAD, "csv").first()
    assert row["load_mw"] == 5.5 and row["timestamp"].hour == 5


def test_a_feed_lands_once(spark, frame, tmp_path):
    rows = [("2024-01-01 00:00:00", "regup", 1.0, "hb", 1), ("2024-01-01 00:00:00", "regup", 1.0, "hb", 1), ("2024-01-01 01:00:00", "nope", 1.0, "hb", 2)]
    df = frame("timestamp string, product string, price double, node string, id long", rows)
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.read(spark, str(tmp_path / "in"), df.schema)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    for _ in range(2):  # a second run finds nothing new
        streams.land(stream, "price", ["id"], good, bad, str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.option("recursiveFileLookup", True).parquet(good).count() == 1
    assert spark.read.option("recursiveFileLookup", True).parquet(bad).first()["reason"] == "unknown product"


def test_late_rows_are_kept_apart(spark, frame, tmp_path):
    """A second batch brings a new row, a repetition of the first batch and a row nine days old."""
    schema = "timestamp string, product string, price double, node string, id long"
    first = frame(schema, [("2024-01-10 00:00:00", "regup", 1.0, "hb", 1)])
    first.write.parquet(str(tmp_path / "in"))
    stream = streams.read(spark, str(tmp_path / "in"), first.schema)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")

    def land():
        streams.land(stream, "price", ["id"], good, bad, str(tmp_path / "checkpoint")).awaitTermination()

    land()
    more = [("2024-01-10 00:00:00", "regup", 1.0, "hb", 1), ("2024-01-10 01:00:00", "regup", 2.0, "hb", 2), ("2024-01-01 00:00:00", "regup", 3.0, "hb", 3)]
    frame(schema, more).write.mode("append").parquet(str(tmp_path / "in"))
    land()
    assert sorted(r["id"] for r in spark.read.parquet(good).collect()) == [1, 2]
    assert [(r["id"], r["reason"]) for r in spark.read.parquet(bad).collect()] == [(3, "late")]


def test_export_leaves_out_samples(spark, stored, tmp_path):
    store.export_range(store.read(spark, stored), str(tmp_path / "csv"), "2024-01-02", "2024-01-02", "DALMP")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 24 and "samples" not in back.columns and "Forecast Value" in back.columns


def test_broken_lines_are_rejected_with_their_place(spark, tmp_path):
    good = "2024-01-01 05:00:00,5.5,r"
    lines = [good, "soon,5.5,r", "2024-01-01 06:00:00,much,r", "2024-01-01 06:00:00", f"{good},more", '"2024-01-01 07:00:00",1.0,"a,b"', ",,"]
    (tmp_path / "load.csv").write_text("\n".join(["timestamp,load_mw,region", *lines]) + "\n")
    records, rejected = feeds.read_records(spark, str(tmp_path / "load.csv"), schemas.LOAD, "csv")
    assert sorted(r["region"] or "" for r in records.collect()) == ["", "a,b", "r"]
    found = rejected.collect()
    assert sorted(r["record"] for r in found) == sorted(lines[1:5])
    assert {r["reason"] for r in found} == {"malformed record"} and all(r["file"].endswith("load.csv") and r["block_start"] == 0 for r in found)
    # Counting alone does not let the parser skip columns.
    assert records.count() == 3 and rejected.count() == 4

    rows = ['{"timestamp": "2024-01-01T05:00:00", "load_mw": 5.5, "region": "r"}', '{"load_mw": "x"}', '{"load_mw": 1.0', "[]", "{}"]
    (tmp_path / "load.json").write_text("\n".join(rows))
    records, rejected = feeds.read_records(spark, str(tmp_path / "load.json"), schemas.LOAD, "json")
    assert {r["record"] for r in rejected.collect()} >= {rows[1], rows[2]}
    assert records.where("load_mw = 5.5").count() == 1 and records.where("load_mw = 1.0").count() == 0
    clean, refused = feeds.read_clean(spark, str(tmp_path / "load.csv"), "load", schemas.LOAD, "csv")
    assert clean.count() == 2 and {r["reason"] for r in refused.collect()} == {"malformed record", "bad timestamp"}
    (tmp_path / "none.csv").write_text("timestamp,load_mw,region\n")
    assert [d.count() for d in feeds.read_clean(spark, str(tmp_path / "none.csv"), "load", schemas.LOAD, "csv")] == [0, 0]


def test_tables_of_a_passing_block_are_dropped(spark):
    before = {p.name for p in Path(scratch.shared_folder(spark).removeprefix("file:")).glob("table-*")}
    with scratch.passing(spark) as keep:
        inner = scratch.settle(spark.range(5))
        with scratch.passing(spark) as keep_inner:
            scratch.settle(inner)
            nested = keep_inner(inner)
        kept = keep(inner.join(nested, "id"))
        assert inner.count() == 5
    after = {p.name for p in Path(scratch.shared_folder(spark).removeprefix("file:")).glob("table-*")}
    assert kept.count() == nested.count() == 5 and len(after - before) == 2
    assert scratch.settle(kept).count() == 5
