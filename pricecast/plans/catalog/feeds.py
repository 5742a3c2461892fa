"""Feeds: reading, ranges, snapshots, horizons, normalisation."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast.functions import calendar
from pricecast.operators import align, normalize, present, reshape, topk
from pricecast.plans.inputs import FUELS, PRODUCTS, hours
from pricecast.plans.registry import query
from pricecast.sources import feeds
from pricecast.sources.scratch import new_folder

_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


@query(
    "feed_read_fixed_schema",
    "S-01",
    sql="SELECT event_type, count(*) AS row_count, round(sum(value), 6) AS total FROM events GROUP BY ALL",
)
def _(i):
    df = feeds.read(i.spark, f"{i.folder}/events.parquet", _EVENTS)
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("row_count"), F.sum("value").alias("total"))


@query(
    "feed_envelope_records",
    "S-01",
    sql="""
    SELECT event_type, count(*) AS records, round(sum(value), 6) AS total,
           sum(CAST(props->>'$.k' AS BIGINT))::BIGINT AS key_total
    FROM events GROUP BY ALL""",
)
def _(i):
    record = F.concat(
        F.lit('{"data": [{"event_type": "'), F.col("event_type"), F.lit('", "value": '), F.col("value").cast("string"),
        F.lit(', "props": '), F.col("props"), F.lit("}]}"),
    )
    schema = T.StructType(
        [
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("props", T.StructType([T.StructField("k", T.LongType())])),
        ]
    )
    rows = feeds.open_envelope(i.table("events").select(record.alias("value")), schema)
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("records"), F.sum("value").alias("total"), F.sum("props.k").alias("key_total")
    )


# Price records as text, some of them broken: a time or price that is none, a line that breaks off, a field too many.
_PRICE_RECORDS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("product", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("node", T.StringType()),
        T.StructField("event_id", T.LongType()),
    ]
)
_LINES = {
    "csv": """
        CASE WHEN event_id % 79 = 0 THEN concat(stamp, ',', product)
             WHEN event_id % 71 = 0 THEN concat(stamp, ',', product, ',', amount, ',"', node, '",', event_id, ',more')
             ELSE concat(stamp, ',', product, ',', amount, ',"', node, '",', event_id) END""",
    "json": """
        CASE WHEN event_id % 79 = 0 THEN concat('{"timestamp": "', stamp, '", "product": "', product)
             ELSE concat('{"timestamp": "', stamp, '", "product": "', product, '", "price": ',
                         CASE WHEN amount = 'n/a' THEN '"n/a"' ELSE amount END, ', "node": "', node, '", "event_id": ', event_id, '}') END""",
}
_LINE_PARTS = """
    SELECT event_id, price, ts, CASE WHEN event_id % 83 = 0 THEN 'soon' ELSE {time} END AS stamp, node,
           CASE WHEN event_id % 89 = 0 THEN 'Other' ELSE lower(product) END AS product,
           CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE {amount} END AS amount
    FROM {ticks}"""


def _lines_sql(kind):
    broken = "event_id % 79 = 0 OR event_id % 83 = 0 OR event_id % 97 = 0" + (" OR event_id % 71 = 0" if kind == "csv" else "")
    parts = _LINE_PARTS.format(time="strftime(ts, '%Y-%m-%d %H:%M:%S')", amount="printf('%.2f', price)", ticks="v_ticks")
    return f"""
    SELECT CASE WHEN {broken} THEN 'malformed record' WHEN event_id % 89 = 0 THEN 'unknown product' ELSE 'accepted' END AS outcome,
           CASE WHEN {broken} THEN {_LINES[kind]} END AS record,
           CASE WHEN NOT ({broken}) THEN event_id END AS event_id,
           CASE WHEN NOT ({broken}) THEN round(price, 2) END AS price
    FROM ({parts})"""


for _kind in _LINES:

    @query(f"feed_{_kind}_with_rejects", "S-01", "N-05", sql=_lines_sql(_kind))
    def _(i, kind=_kind):
        parts = _LINE_PARTS.format(time="date_format(ts, 'yyyy-MM-dd HH:mm:ss')", amount="format_string('%.2f', price)", ticks="{ticks}")
        path = new_folder(i.spark, kind)
        i.spark.sql(parts, ticks=i.ticks).select(F.expr(_LINES[kind]).alias("value")).write.text(path)
        good, rejected = feeds.read_clean(i.spark, path, "price", _PRICE_RECORDS, kind, header=False)
        refused = F.col("reason") != "malformed record"
        kept = F.from_json("record", "event_id long, price double")
        told = rejected.select(
            F.col("reason").alias("outcome"),
            F.when(~refused, F.col("record")).alias("record"),
            F.when(refused, kept["event_id"]).alias("event_id"),
            F.when(refused, kept["price"]).alias("price"),
        )
        none = F.lit(None).cast("string").alias("record")
        return good.select(F.lit("accepted").alias("outcome"), none, "event_id", "price").unionByName(told)


@query(
    "feed_time_range",
    "S-02",
    sql="""
    SELECT event_id, ts, value FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""",
)
def _(i):
    # The bounds have the type of the stored column, so the filter reaches the file scan.
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = feeds.in_range(i.table("events"), at("2024-01-08 00:00:00"), at("2024-01-15 00:00:00"), "ts")
    return rows.select("event_id", "ts", "value")


@query(
    "feed_latest_snapshot",
    "S-03",
    sql="""
    SELECT user_id, product, ts, price, event_id FROM v_ticks
    QUALIFY row_number() OVER (PARTITION BY user_id, product ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(i):
    rows = i.ticks.select("user_id", "product", "ts", "price", "event_id")
    return feeds.latest_snapshot(rows, ["user_id", "product"], "ts", ["event_id"])


_STARTS = """
    SELECT DISTINCT date_trunc('day', timestamp) AS start FROM v_load"""


def _starts(i):
    return i.kept("load").select(F.date_trunc("day", "timestamp").alias("start")).distinct()


@query(
    "feed_horizon_rows",
    "S-04",
    sql=f"""
    SELECT start, l.region, l.timestamp, l.load_mw FROM ({_STARTS}) s
    JOIN v_load l ON l.timestamp >= start AND l.timestamp < start + INTERVAL 72 HOUR""",
)
def _(i):
    found, _ = feeds.horizon(i.kept("load"), _starts(i), "start")
    return found.select("start", "region", "timestamp", "load_mw")


@query(
    "feed_horizon_gaps",
    "S-04",
    "G-09",
    sql="""
    SELECT start, product, start + h.h * INTERVAL 1 HOUR AS timestamp
    FROM (SELECT DISTINCT product, date_trunc('day', timestamp) AS start FROM v_hourly) s, range(72) h(h)
    EXCEPT SELECT start, product, timestamp
    FROM (SELECT DISTINCT product, date_trunc('day', timestamp) AS start FROM v_hourly) s
    JOIN v_hourly USING (product)""",
)
def _(i):
    hourly = i.kept("hourly")
    starts = hourly.select("product", F.date_trunc("day", "timestamp").alias("start")).distinct()
    _, gaps = feeds.horizon(hourly, starts, "start", ["product"])
    return gaps.select("start", "product", "timestamp")


@query(
    "feed_missing_hours",
    "G-09",
    sql="""
    SELECT product, timestamp FROM (SELECT DISTINCT product FROM v_hourly),
      (SELECT unnest(generate_series((SELECT min(timestamp) FROM v_hourly), (SELECT max(timestamp) FROM v_hourly),
         INTERVAL 1 HOUR)) AS timestamp)
    EXCEPT SELECT product, timestamp FROM v_hourly""",
)
def _(i):
    hourly = i.kept("hourly")
    span = align.union_bounds([hourly]).select(F.struct("_from", "_to")).scalar()
    wanted = hourly.select("product").distinct().withColumn("_span", span)
    grid = align.series_grid(wanted.select("product", "_span._from", "_span._to"))
    return align.missing_hours(hourly, grid, ["product"])


@query(
    "feed_summary",
    "A-13",
    sql="""
    SELECT min(load_mw) AS min_load, max(load_mw) AS max_load, round(avg(load_mw), 6) AS mean_load FROM v_load""",
)
def _(i):
    from pricecast.operators.aggregates import load_summary

    return load_summary(i.load)


@query(
    "load_feed_normalized",
    "N-01",
    sql="""
    SELECT try_cast("Timestamp" AS TIMESTAMP) AS timestamp, try_cast("Load MW" AS DOUBLE) AS load_mw,
           upper("Region") AS region, "Event ID" AS event_id
    FROM v_raw_load
    WHERE try_cast("Timestamp" AS TIMESTAMP) IS NOT NULL AND try_cast("Load MW" AS DOUBLE) IS NOT NULL""",
)
def _(i):
    return normalize.normalize(i.raw_load, "load")


_CANON = """list_filter(['DALMP', 'RTLMP', 'RegUp', 'RegDown', 'RRS', 'NSRS'], lambda p: upper(p) = upper("Product"))[1]"""


@query(
    "price_feed_normalized",
    "N-02",
    sql=f"""
    SELECT * FROM (
      SELECT try_cast("Timestamp" AS TIMESTAMP) AS timestamp, {_CANON} AS product,
             try_cast("Price" AS DOUBLE) AS price, upper("Node") AS node, "Event ID" AS event_id
      FROM v_raw_prices)
    WHERE timestamp IS NOT NULL AND product IS NOT NULL AND price IS NOT NULL""",
)
def _(i):
    return normalize.normalize(i.raw_prices, "price")


@query(
    "generation_feed_normalized",
    "N-03",
    sql="""
    SELECT * FROM (
      SELECT try_cast("Timestamp" AS TIMESTAMP) AS timestamp, lower("Fuel Type") AS fuel_type,
             try_cast("Generation MW" AS DOUBLE) AS generation_mw, upper("Region") AS region, "Event ID" AS event_id
      FROM v_raw_generation)
    WHERE timestamp IS NOT NULL AND generation_mw IS NOT NULL""",
)
def _(i):
    return normalize.normalize(i.raw_generation, "generation")


@query(
    "generation_feed_normalized_pivot",
    "N-04",
    sql=f"""
    SELECT timestamp, {", ".join(f"coalesce(round(sum(generation_mw) FILTER (fuel_type = '{f}'), 6), 0) AS generation_{f}" for f in FUELS)}
    FROM (
      SELECT try_cast("Timestamp" AS TIMESTAMP) AS timestamp, lower("Fuel Type") AS fuel_type,
             try_cast("Generation MW" AS DOUBLE) AS generation_mw
      FROM v_raw_generation)
    WHERE timestamp IS NOT NULL AND generation_mw IS NOT NULL GROUP BY ALL""",
)
def _(i):
    return reshape.pivot_generation(normalize.normalize(i.raw_generation, "generation"), FUELS)


_JUDGED = """
    SELECT event_id, CASE WHEN timestamp IS NULL THEN 'bad timestamp' WHEN load_mw IS NULL THEN 'bad value'
             WHEN load_mw <= 0 THEN 'load not positive' WHEN trim(region) = '' THEN 'empty region' END AS reason
    FROM (SELECT try_cast("Timestamp" AS TIMESTAMP) AS timestamp, try_cast("Load MW" AS DOUBLE) AS load_mw,
                 upper("Region") AS region, "Event ID" AS event_id FROM v_raw_load)"""


@query("records_rejected", "N-05", sql=f"SELECT * FROM ({_JUDGED}) WHERE reason IS NOT NULL")
def _(i):
    _, rejected = normalize.split_records(i.raw_load, "load")
    return rejected.select("event_id", "reason")


@query("records_accepted", "N-05", sql=f"SELECT event_id FROM ({_JUDGED}) WHERE reason IS NULL")
def _(i):
    accepted, _ = normalize.split_records(i.raw_load, "load")
    return accepted.select("event_id")


# --- filters -----------------------------------------------------------------------------------


@query("forecast_of_product", "F-01", sql="SELECT * FROM v_shown WHERE product = 'RTLMP'", doubles="point_forecast")
def _(i):
    return present.by_product(i.shown, "RTLMP")


@query(
    "forecast_in_dates",
    "F-02",
    sql="""
    SELECT * FROM v_shown WHERE timestamp BETWEEN TIMESTAMP '2024-01-03 06:00:00' AND TIMESTAMP '2024-01-05 23:59:59'""",
    doubles="point_forecast",
)
def _(i):
    at = lambda s: F.lit(s).cast("timestamp")
    return present.by_date_range(i.shown, at("2024-01-03 06:00:00"), at("2024-01-05 00:00:00"))


@query("prices_of_products", "F-03", sql="SELECT event_id, product, price FROM v_ticks WHERE product IN ('DALMP', 'RegUp')")
def _(i):
    return present.by_products(i.ticks, ["DALMP", "RegUp"]).select("event_id", "product", "price")


@query(
    "generation_of_fuels", "F-04", sql="SELECT * FROM v_generation WHERE fuel_type IN ('wind', 'solar')"
)
def _(i):
    return i.generation.where(F.col("fuel_type").isin("wind", "solar"))


@query("fuel_types", "F-05", sql="SELECT DISTINCT fuel_type FROM v_ticks ORDER BY 1")
def _(i):
    return i.ticks.select("fuel_type").distinct().orderBy("fuel_type")


@query(
    "forecast_at_time",
    "F-06",
    sql="""
    SELECT t.product, t.target, s.point_forecast FROM
      (SELECT DISTINCT product, date_trunc('day', timestamp) + INTERVAL 12 HOUR AS target FROM v_shown) t
    LEFT JOIN v_shown s ON s.product = t.product AND s.timestamp = t.target""",
    doubles="point_forecast",
)
def _(i):
    target = (F.date_trunc("day", "timestamp") + hours(12)).alias("target")
    shown = i.kept("shown")
    wanted = shown.select("product", target).distinct()
    points = shown.select("product", F.col("timestamp").alias("target"), "point_forecast")
    return wanted.join(points, ["product", "target"], "left")


@query(
    "fallback_in_use",
    "F-07",
    sql="SELECT forecast_date, bool_or(is_fallback) AS uses_fallback FROM v_stored GROUP BY ALL",
)
def _(i):
    return i.stored.groupBy("forecast_date").agg(F.bool_or("is_fallback").alias("uses_fallback"))


# --- time columns ------------------------------------------------------------------------------


@query(
    "times_localized",
    "C-01",
    sql="""
    SELECT o_orderkey, timezone('UTC', timezone('America/Chicago', o_orderdate)) AS utc_time,
           timezone('America/Chicago', timezone('UTC', o_orderdate)) AS market_time
    FROM orders""",
)
def _(i):
    day = F.col("o_orderdate")
    return i.table("orders").select(
        "o_orderkey", calendar.localize(day).alias("utc_time"), calendar.to_zone(day).alias("market_time")
    )


@query(
    "times_parsed",
    "C-02",
    sql="""
    SELECT "Event ID" AS event_id, try_strptime("Timestamp", '%Y-%m-%d %H:%M:%S') AS parsed FROM v_raw_prices""",
)
def _(i):
    parsed = calendar.parse(F.col("Timestamp"), "yyyy-MM-dd HH:mm:ss").alias("parsed")
    return i.raw_prices.select(F.col("Event ID").alias("event_id"), parsed)


@query(
    "forecast_starts",
    "C-04",
    sql="SELECT event_id, date_trunc('day', ts) + INTERVAL 1 DAY AS start FROM v_ticks",
)
def _(i):
    return i.ticks.select("event_id", calendar.next_midnight(F.col("ts")).alias("start"))


# --- sorting, set operations -------------------------------------------------------------------


@query("forecast_sorted", "O-01", sql="SELECT * FROM v_shown ORDER BY timestamp, product", doubles="point_forecast")
def _(i):
    return i.shown.orderBy("timestamp", "product")


@query(
    "peak_hours",
    "O-02",
    sql="""
    SELECT product, timestamp, point_forecast,
           row_number() OVER (PARTITION BY product ORDER BY point_forecast DESC, timestamp) AS rank
    FROM v_shown QUALIFY rank <= 3""",
    doubles="point_forecast",
)
def _(i):
    return topk.top_hours(i.shown, 3).select("product", "timestamp", "point_forecast", "rank")


@query(
    "nth_forecast_hour",
    "O-03",
    sql="""
    SELECT product, timestamp, point_forecast FROM v_shown
    QUALIFY row_number() OVER (PARTITION BY product ORDER BY timestamp) = 13""",
    doubles="point_forecast",
)
def _(i):
    return topk.nth_hour(i.shown, 12).select("product", "timestamp", "point_forecast")


@query(
    "frames_concatenated",
    "O-05",
    sql="""
    SELECT timestamp, load_mw AS value, 'load' AS feed FROM v_system_load
    UNION ALL SELECT timestamp, price, product FROM v_hourly""",
    doubles="value",
)
def _(i):
    load = i.system_load.select("timestamp", F.col("load_mw").alias("value"), F.lit("load").alias("feed"))
    prices = i.hourly.select("timestamp", F.col("price").alias("value"), F.col("product").alias("feed"))
    return topk.concat(load, prices)


@query(
    "expected_minus_actual",
    "O-06",
    sql="""
    SELECT product, timestamp + INTERVAL 24 HOUR AS timestamp FROM v_hourly
    EXCEPT SELECT product, timestamp FROM v_hourly""",
)
def _(i):
    later = i.kept("hourly").select("product", (F.col("timestamp") + hours(24)).alias("timestamp"))
    return topk.difference(later, i.kept("hourly"), ["product", "timestamp"])


@query(
    "common_times",
    "O-07",
    sql="""
    SELECT timestamp, count(DISTINCT product) AS feeds FROM v_ticks GROUP BY ALL""",
)
def _(i):
    parts = [i.ticks.where(F.col("product") == p).select("timestamp") for p in PRODUCTS]
    return topk.common_times(*parts)


