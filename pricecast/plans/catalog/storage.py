"""The forecast store and its index."""

from pyspark.sql import functions as F

from pricecast.plans.registry import query
from pricecast.sources import store
from pricecast.sources.scratch import new_folder

_AS_OF = "2024-02-15 12:00:00"


def _as_of():
    return F.lit(_AS_OF).cast("timestamp")


@query(
    "stored_forecast",
    "S-08",
    sql="""
    SELECT product, timestamp, point_forecast, '1.0.0' AS schema_version FROM v_stored
    WHERE forecast_date = TIMESTAMP '2024-01-10' AND product = 'RegUp'""",
    doubles="point_forecast",
)
def _(i):
    rows = store.read_one(i.stored, F.lit("2024-01-10").cast("date"), "RegUp")
    return rows.select("product", "timestamp", "point_forecast", "schema_version")


@query(
    "latest_forecast",
    "S-09",
    sql="""
    SELECT product, timestamp, point_forecast, generation_timestamp FROM v_stored
    QUALIFY rank() OVER (PARTITION BY product ORDER BY generation_timestamp DESC) = 1""",
    doubles="point_forecast",
)
def _(i):
    return store.read_latest(i.kept("stored")).select("product", "timestamp", "point_forecast", "generation_timestamp")


@query(
    "latest_forecast_by_index",
    "S-09",
    sql="""
    SELECT product, timestamp, point_forecast, generation_timestamp FROM v_stored
    QUALIFY rank() OVER (PARTITION BY product ORDER BY generation_timestamp DESC) = 1""",
    doubles="point_forecast",
)
def _(i):
    found = store.read_latest(i.kept("stored"), store.index_of(i.kept("stored")))
    return found.select("product", "timestamp", "point_forecast", "generation_timestamp")


@query(
    "forecasts_in_dates",
    "S-10",
    sql="""
    SELECT forecast_date, product, timestamp, point_forecast FROM v_stored
    WHERE forecast_date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND product = 'DALMP'""",
    doubles="point_forecast",
)
def _(i):
    rows = store.read_range(i.stored, "2024-01-05", "2024-01-12", "DALMP")
    return rows.select("forecast_date", "product", "timestamp", "point_forecast")


@query(
    "forecasts_to_compare",
    "S-12",
    sql="SELECT product, timestamp, point_forecast FROM v_stored WHERE product IN ('DALMP', 'RTLMP', 'NSRS')",
    doubles="point_forecast",
)
def _(i):
    return store.read_products(i.stored, ["DALMP", "RTLMP", "NSRS"]).select("product", "timestamp", "point_forecast")


@query(
    "storage_metadata_added",
    "W-02",
    sql=f"""
    SELECT product, timestamp, TIMESTAMP '{_AS_OF}' AS storage_timestamp, '1.0.0' AS storage_version,
           '1.0.0' AS schema_version FROM v_stored""",
)
def _(i):
    rows = store.add_metadata(i.stored.select("product", "timestamp"), _as_of())
    return rows.select("product", "timestamp", "storage_timestamp", "storage_version", "schema_version")


@query(
    "storage_metadata_read",
    "W-03",
    sql=f"""
    SELECT forecast_date, product, TIMESTAMP '{_AS_OF}' AS storage_timestamp, '1.0.0' AS storage_version,
           '1.0.0' AS schema_version, max(generation_timestamp) AS generation_timestamp,
           bool_or(is_fallback) AS is_fallback, count(*) AS row_count FROM v_stored GROUP BY ALL""",
)
def _(i):
    return store.stored_metadata(store.add_metadata(i.stored, _as_of()))


@query(
    "forecasts_existing",
    "W-04",
    sql="""
    SELECT DISTINCT product, forecast_date + INTERVAL 5 DAY AS forecast_date FROM v_stored
    INTERSECT SELECT product, forecast_date FROM v_stored""",
)
def _(i):
    wanted = i.kept("stored").select("product", F.date_add("forecast_date", 5).alias("forecast_date")).distinct()
    return store.exists(store.index_of(i.kept("stored")), wanted)


@query(
    "schema_upgraded",
    "W-06",
    sql="""
    SELECT event_id, '1.0.0' AS schema_version, NULL::DOUBLE AS quality,
           event_id % 3 = 1 AS compatible FROM v_ticks""",
)
def _(i):
    from pricecast.operators.validate import version_compatible

    # Stored versions: same major, other major, none.
    version = F.when(F.col("event_id") % 3 == 1, "1.4.2").when(F.col("event_id") % 3 == 2, "0.9.0")
    rows = i.ticks.select("event_id", version.alias("schema_version"))
    judged = rows.withColumn("compatible", version_compatible(F.col("schema_version")))
    return store.upgrade(judged, {"quality": "double"})


@query(
    "forecast_copied",
    "W-07",
    sql="""
    SELECT product, forecast_date + INTERVAL 2 DAY AS forecast_date, timestamp + INTERVAL 2 DAY AS timestamp,
           point_forecast, true AS is_fallback FROM v_stored""",
    doubles="point_forecast",
)
def _(i):
    source = i.kept("stored").select("product", "forecast_date", F.date_add("forecast_date", 2).alias("target_date")).distinct()
    rows = store.copy_to(i.kept("stored"), source, as_fallback=True)
    return rows.select("product", "forecast_date", "timestamp", "point_forecast", "is_fallback")


@query(
    "index_upserted",
    "W-08",
    sql="""
    SELECT forecast_date, product, generation_timestamp, event_id, file_path, is_fallback FROM v_entries
    QUALIFY row_number() OVER (PARTITION BY forecast_date, product ORDER BY generation_timestamp DESC, event_id DESC) = 1""",
)
def _(i):
    old, new = (i.entries.where(F.col("event_id") % 2 == r) for r in (0, 1))
    return store.upsert_index(old, new, ["event_id"])


_SKIPPED = """
    SELECT CASE WHEN NOT regexp_matches(file_path, '([0-9]{4})/([0-9]{2})/([0-9]{2})_([A-Za-z]+)\\.parquet$') THEN 'bad name'
       WHEN regexp_extract(file_path, '_([A-Za-z]+)\\.parquet$', 1) NOT IN ('DALMP', 'RTLMP', 'RegUp', 'RegDown', 'RRS', 'NSRS')
         THEN 'unknown product'
       WHEN try_strptime(regexp_extract(file_path, '([0-9]{4}/[0-9]{2}/[0-9]{2})_', 1), '%Y/%m/%d') IS NULL THEN 'bad date' END AS why
    FROM v_entries"""


@query(
    "index_rebuild_report",
    "W-09",
    sql=f"""
    SELECT count(*) AS found, count(*) FILTER (why IS NULL) AS processed, count(*) FILTER (why = 'bad name') AS bad_name,
           count(*) FILTER (why = 'unknown product') AS unknown_product, count(*) FILTER (why = 'bad date') AS bad_date
    FROM ({_SKIPPED})""",
)
def _(i):
    return store.rebuild_report(store.parse_paths(i.entries.select("file_path")))


@query("index_from_data", "W-09", sql="SELECT * FROM v_index")
def _(i):
    return store.index_of(i.stored).drop("file_path")


# Stored data exists for the even days only.
_PRESENT = "SELECT DISTINCT forecast_date, product FROM v_stored WHERE day(forecast_date) % 2 = 0"


@query(
    "index_cleaned",
    "W-10",
    sql=f"SELECT i.forecast_date, i.product FROM v_index i JOIN ({_PRESENT}) p USING (forecast_date, product)",
)
def _(i):
    present = i.kept("stored").where(F.day("forecast_date") % 2 == 0)
    return store.clean_index(store.index_of(i.kept("stored")), present).select("forecast_date", "product")


@query(
    "index_clean_report",
    "W-10",
    sql=f"""
    SELECT count(*) AS total, count(*) FILTER (p.product IS NULL) AS removed,
           count(*) FILTER (p.product IS NOT NULL) AS remaining
    FROM v_index i LEFT JOIN ({_PRESENT}) p USING (forecast_date, product)""",
)
def _(i):
    present = i.kept("stored").where(F.day("forecast_date") % 2 == 0)
    return store.clean_report(store.index_of(i.kept("stored")), present)


@query(
    "forecasts_retained",
    "W-11",
    sql=f"SELECT forecast_date, product FROM v_index WHERE forecast_date >= TIMESTAMP '{_AS_OF[:10]}' - INTERVAL 30 DAY",
)
def _(i):
    return store.retained(store.index_of(i.stored), _as_of(), 30).select("forecast_date", "product")


@query(
    "forecasts_expired",
    "W-11",
    sql=f"SELECT forecast_date, product FROM v_index WHERE forecast_date < TIMESTAMP '{_AS_OF[:10]}' - INTERVAL 30 DAY",
)
def _(i):
    return store.expired(store.index_of(i.stored), _as_of(), 30).select("forecast_date", "product")


@query(
    "storage_statistics",
    "W-12",
    sql="""
    SELECT product, CAST(is_fallback AS VARCHAR) AS is_fallback, count(*) AS entries, min(forecast_date) AS first_date, max(forecast_date) AS last_date,
           max(generation_timestamp) AS newest_generation
    FROM v_index GROUP BY GROUPING SETS ((), (product), (is_fallback))""",
)
def _(i):
    return store.statistics(store.index_of(i.stored)).withColumn("is_fallback", F.col("is_fallback").cast("string"))


_UNITS = "CASE WHEN product IN ('DALMP', 'RTLMP') THEN '$/MWh' ELSE '$/MW' END"


@query(
    "export_projection",
    "W-14",
    sql=f"""
    SELECT product AS "Product", strftime(timestamp, '%Y-%m-%d %H:%M') AS "Forecast Time",
           round(point_forecast, 6) AS "Forecast Value", lower_bound AS "Lower Bound", upper_bound AS "Upper Bound",
           is_fallback AS "Is Fallback Forecast", {_UNITS} AS unit FROM v_shown""",
)
def _(i):
    return store.export_rows(i.shown)


@query("available_dates", "W-16", sql="SELECT DISTINCT product, forecast_date FROM v_index")
def _(i):
    return store.available_dates(store.index_of(i.stored))


def _stored_table(i):
    """Path of the forecasts of the given ticks, written as a partitioned table of their own."""
    path = new_folder(i.spark, "forecasts")
    store.write(i.stored, path, _as_of())
    return path


@query("forecasts_written", "W-01", sql="SELECT forecast_date, product, timestamp, point_forecast FROM v_stored", doubles="point_forecast")
def _(i):
    rows = store.read(i.spark, _stored_table(i))
    return rows.select("forecast_date", "product", "timestamp", "point_forecast")


@query(
    "forecasts_written_size",
    "W-12",
    sql=None,
)
def _(i):
    return store.size_on_disk(i.spark, _stored_table(i))


@query(
    "forecasts_after_delete",
    "W-05",
    sql="""
    SELECT forecast_date, product, timestamp FROM v_stored
    WHERE NOT (forecast_date = TIMESTAMP '2024-01-07' AND product = 'RRS')""",
)
def _(i):
    path = _stored_table(i)
    store.delete(i.spark, path, [("2024-01-07", "RRS")])
    return store.read(i.spark, path).select("forecast_date", "product", "timestamp")


@query(
    "forecasts_exported_csv",
    "W-13",
    "W-15",
    sql=f"""
    SELECT product AS "Product", strftime(timestamp, '%Y-%m-%d %H:%M') AS "Forecast Time",
           round(point_forecast, 6) AS "Forecast Value", {_UNITS} AS unit
    FROM v_stored WHERE forecast_date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
)
def _(i):
    path = new_folder(i.spark, "csv")
    rows = i.stored.select("forecast_date", "product", "timestamp", "point_forecast")
    store.export_range(rows, path, "2024-01-05", "2024-01-20")
    back = i.spark.read.option("header", True).csv(path)
    return back.select(
        "Product", "Forecast Time", F.col("Forecast Value").cast("double").alias("Forecast Value"), "unit"
    )


@query(
    "forecasts_exported_json",
    "W-13",
    sql="""
    SELECT product AS "Product", strftime(timestamp, '%Y-%m-%d %H:%M') AS "Forecast Time",
           len(samples) AS sample_count FROM v_sampled""",
)
def _(i):
    path = new_folder(i.spark, "json")
    store.export_json(i.sampled.select("timestamp", "product", "samples"), path)
    back = i.spark.read.schema('`Product` string, `Forecast Time` string, samples array<double>').json(path)
    return back.select("Product", "Forecast Time", F.size("samples").alias("sample_count"))


