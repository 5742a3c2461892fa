"""Violation tables."""

from pyspark.sql import functions as F

from pricecast import config
from pricecast.operators import topk, validate
from pricecast.plans.inputs import SAMPLES
from pricecast.plans.registry import query
from pricecast.sources import feeds
from pricecast.sources.scratch import settle

_AS_OF = "2024-01-31 00:00:00"


def _as_of():
    return F.lit(_AS_OF).cast("timestamp")


def _rows(category, checks, product="product"):
    """Union of (check, condition, value, message) over one source."""
    return "(" + " UNION ALL ".join(
        f"""SELECT '{category}' AS category, '{check}' AS "check", {product} AS product, timestamp, {value} AS value,
        '{text}' AS message FROM src WHERE {condition}"""
        for check, condition, value, text in checks
    ) + ")"


_NONE = "NULL::DOUBLE"


def _broken_load(i):
    e = F.col("event_id")
    return i.by_region.select(
        F.when(e % 53 == 0, None).when(e % 59 == 0, F.col("ts") - F.expr("interval 400 days")).otherwise(F.col("ts")).alias("timestamp"),
        F.when(e % 61 == 0, None).otherwise(F.col("price") - 5).alias("load_mw"),
        F.when(e % 67 == 0, " ").otherwise(F.col("region")).alias("region"),
    )


_LOAD = """
    SELECT CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN ts - INTERVAL 400 DAY ELSE ts END AS timestamp,
           CASE WHEN event_id % 61 = 0 THEN NULL ELSE price - 5 END AS load_mw,
           CASE WHEN event_id % 67 = 0 THEN ' ' ELSE region END AS region FROM v_by_region"""
_TIME_CHECKS = [
    ("timestamp", "timestamp IS NULL", _NONE, "timestamp is null"),
    (
        "timestamp_range",
        f"abs(date_diff('day', timestamp, TIMESTAMP '{_AS_OF}')) > 365",
        _NONE,
        "timestamp more than 365 days from the run",
    ),
]
_LOAD_CHECKS = [
    *_TIME_CHECKS,
    ("load_mw", "load_mw IS NULL", _NONE, "load_mw is null"),
    ("load_positive", "load_mw <= 0", "round(load_mw, 6)", "load_mw must be positive"),
    ("region", "trim(region) = ''", _NONE, "region is empty"),
]


@query(
    "load_feed_violations",
    "V-02",
    sql=f"WITH src AS ({_LOAD}) SELECT * FROM {_rows('load', _LOAD_CHECKS, 'NULL::VARCHAR')}",
)
def _(i):
    return validate.load_feed(_broken_load(i), _as_of())


def _broken_prices(i):
    e = F.col("event_id")
    return i.ticks.select(
        F.when(e % 53 == 0, None).otherwise(F.col("ts")).alias("timestamp"),
        F.when(e % 59 == 0, "Other").otherwise(F.col("product")).alias("product"),
        F.when(e % 61 == 0, None).otherwise(F.col("price")).alias("price"),
        F.when(e % 67 == 0, None).otherwise(F.col("node")).alias("node"),
    )


_PRICES = """
    SELECT CASE WHEN event_id % 53 = 0 THEN NULL ELSE ts END AS timestamp,
           CASE WHEN event_id % 59 = 0 THEN 'Other' ELSE product END AS product,
           CASE WHEN event_id % 61 = 0 THEN NULL ELSE price END AS price,
           CASE WHEN event_id % 67 = 0 THEN NULL ELSE node END AS node FROM v_ticks"""
_PRICE_CHECKS = [
    _TIME_CHECKS[0],
    ("product", "product = 'Other'", _NONE, "product is not known"),
    ("price", "price IS NULL", _NONE, "price is null"),
    ("node", "node IS NULL", _NONE, "node is empty"),
]


@query("price_feed_violations", "V-03", sql=f"WITH src AS ({_PRICES}) SELECT * FROM {_rows('price', _PRICE_CHECKS)}")
def _(i):
    return validate.price_feed(_broken_prices(i))


def _broken_generation(i):
    e = F.col("event_id")
    return i.by_region.select(
        F.col("ts").alias("timestamp"),
        F.when(e % 59 == 0, "").otherwise(F.col("fuel_type")).alias("fuel_type"),
        F.when(e % 61 == 0, None).otherwise(F.col("price") - 2).alias("generation_mw"),
        "region",
    )


_GENERATION = """
    SELECT ts AS timestamp, CASE WHEN event_id % 59 = 0 THEN '' ELSE fuel_type END AS fuel_type,
           CASE WHEN event_id % 61 = 0 THEN NULL ELSE price - 2 END AS generation_mw, region FROM v_by_region"""
_GENERATION_CHECKS = [
    ("generation_mw", "generation_mw IS NULL", _NONE, "generation_mw is null"),
    ("generation_sign", "generation_mw < 0", "round(generation_mw, 6)", "generation_mw is negative"),
    ("fuel_type", "fuel_type = ''", _NONE, "fuel_type is empty"),
]


@query(
    "generation_feed_violations",
    "V-04",
    sql=f"WITH src AS ({_GENERATION}) SELECT * FROM {_rows('generation', _GENERATION_CHECKS, 'NULL::VARCHAR')}",
)
def _(i):
    return validate.generation_feed(_broken_generation(i))


@query(
    "time_coverage",
    "V-05",
    sql="""
    SELECT product, node, min(ts) AS first, max(ts) AS last,
           min(ts) <= TIMESTAMP '2024-01-01 01:00:00' AND max(ts) >= TIMESTAMP '2024-01-30 23:00:00' AS covered
    FROM v_ticks GROUP BY ALL""",
)
def _(i):
    at = lambda s: F.lit(s).cast("timestamp")
    rows = i.ticks.select("product", "node", F.col("ts").alias("timestamp"))
    return validate.time_coverage(rows, at("2024-01-01 01:00:00"), at("2024-01-30 23:00:00"), ["product", "node"])


_FEED_TIMES = """
    SELECT feed, count(DISTINCT timestamp) AS times, (SELECT count(DISTINCT timestamp) FROM v_ticks) AS all_times
    FROM (SELECT 'load' AS feed, timestamp FROM v_load UNION ALL
          SELECT 'price', timestamp FROM v_ticks WHERE product = 'RRS' UNION ALL
          SELECT 'generation', timestamp FROM v_generation WHERE fuel_type = 'coal' AND hour(timestamp) > 3) GROUP BY feed"""


@query(
    "feed_coverage",
    "V-06",
    sql=f"""
    SELECT feed, times, all_times, round(times / all_times, 6) AS coverage, times / all_times >= 0.9::DOUBLE AS covered
    FROM ({_FEED_TIMES})""",
)
def _(i):
    return validate.feed_coverage(
        {
            "load": i.load,
            "price": i.ticks.where("product = 'RRS'"),
            "generation": i.generation.where("fuel_type = 'coal' and hour(timestamp) > 3"),
        }
    )


@query(
    "all_feed_violations",
    "V-07",
    sql=f"""
    SELECT category, "check", product, count(*) AS violations FROM (
      WITH src AS ({_LOAD}) SELECT * FROM {_rows('load', _LOAD_CHECKS, 'NULL::VARCHAR')}
      UNION ALL (WITH src AS ({_PRICES}) SELECT * FROM {_rows('price', _PRICE_CHECKS)})
      UNION ALL (WITH src AS ({_GENERATION}) SELECT * FROM {_rows('generation', _GENERATION_CHECKS, 'NULL::VARCHAR')})
      UNION ALL (SELECT 'coverage', 'load', NULL, NULL, NULL, NULL WHERE (
        SELECT count(DISTINCT timestamp) FROM ({_LOAD})) / (SELECT count(DISTINCT timestamp) FROM (
          SELECT timestamp FROM ({_LOAD}) UNION ALL SELECT ts FROM v_ticks UNION ALL SELECT NULL)) < 0.9))
    GROUP BY ALL""",
)
def _(i):
    broken = [settle(f(i)) for f in (_broken_load, _broken_prices, _broken_generation)]
    found = validate.all_feeds(*broken, _as_of())
    return found.groupBy("category", "check", "product").agg(F.count(F.lit(1)).alias("violations"))


_CLEAN = """
    SELECT 'load' AS part, "Region" AS place, try_cast("Load MW" AS DOUBLE) AS value FROM v_raw_load
      WHERE try_cast("Timestamp" AS TIMESTAMP) IS NOT NULL AND try_cast("Load MW" AS DOUBLE) IS NOT NULL
    UNION ALL SELECT 'price', "Node", try_cast("Price" AS DOUBLE) FROM v_raw_prices
      WHERE try_cast("Timestamp" AS TIMESTAMP) IS NOT NULL AND try_cast("Price" AS DOUBLE) IS NOT NULL AND "Product" <> 'Unknown'
    UNION ALL SELECT 'generation', "Region", try_cast("Generation MW" AS DOUBLE) FROM v_raw_generation
      WHERE try_cast("Timestamp" AS TIMESTAMP) IS NOT NULL AND try_cast("Generation MW" AS DOUBLE) IS NOT NULL"""


@query(
    "feeds_collected",
    "S-11",
    sql=f"""
    SELECT part, count(*) AS row_count FROM ({_CLEAN}) GROUP BY part
    UNION ALL SELECT part, sum((part = 'load' AND value <= 0)::INT + (part = 'generation' AND value < 0)::INT + (place = '')::INT)::BIGINT AS bad
      FROM ({_CLEAN}) GROUP BY part HAVING bad > 0""",
)
def _(i):
    clean, found = feeds.collect(i.raw_load, i.raw_prices, i.raw_generation, _as_of(), settle)
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("part", F.lit(n)) for n, df in clean.items()]
    return topk.concat(*parts, found.groupBy(F.col("category").alias("part")).agg(F.count(F.lit(1)).alias("row_count")))


# --- forecasts ---------------------------------------------------------------------------------


def _broken_forecast(i):
    e = F.col("vec_id")
    return i.sampled.withColumns(
        {
            "product": F.when(e % 31 == 0, "Other").otherwise(F.col("product")),
            "point_forecast": F.when(e % 29 == 0, None).otherwise(F.col("point_forecast")),
            "samples": F.when(e % 23 == 0, F.slice("samples", 1, 60))
            .when(e % 19 == 0, F.transform("samples", lambda x: F.when(x > 32, x)))
            .otherwise(F.col("samples")),
            "is_fallback": F.when(e % 17 == 0, None).otherwise(F.col("is_fallback")),
        }
    )


_FORECAST = """
    SELECT vec_id, timestamp, CASE WHEN vec_id % 31 = 0 THEN 'Other' ELSE product END AS product,
           CASE WHEN vec_id % 29 = 0 THEN NULL ELSE point_forecast END AS point_forecast,
           CASE WHEN vec_id % 23 = 0 THEN samples[1:60]
             WHEN vec_id % 19 = 0 THEN list_transform(samples, lambda x: CASE WHEN x > 32 THEN x END) ELSE samples END AS samples,
           CASE WHEN vec_id % 17 = 0 THEN NULL ELSE is_fallback END AS is_fallback, generation_timestamp FROM v_sampled"""
_EARLY = "2024-01-15 00:00:00"
_FORECAST_CHECKS = [
    ("product", "product = 'Other'", _NONE, "product is not known"),
    ("point_forecast", "point_forecast IS NULL", _NONE, "point forecast is missing"),
    ("sample_count", "len(samples) <> 64", "len(samples)::DOUBLE", "wrong number of samples"),
    ("sample_values", "list_count(samples) < len(samples)", _NONE, "samples have gaps"),
    ("is_fallback", "is_fallback IS NULL", _NONE, "is_fallback is null"),
    ("generation_future", f"generation_timestamp > TIMESTAMP '{_EARLY}'", _NONE, "generated after the run"),
]


@query(
    "forecast_schema_violations",
    "V-08",
    sql=f"WITH src AS ({_FORECAST}) SELECT * FROM {_rows('schema', _FORECAST_CHECKS)}",
)
def _(i):
    return validate.forecast_schema(_broken_forecast(i), F.lit(_EARLY).cast("timestamp"), SAMPLES)


_STARTS = "SELECT min(date_trunc('day', timestamp)) AS start FROM v_ticks"
_MISSING = f"""
    SELECT product, timestamp FROM (SELECT unnest(['DALMP', 'RTLMP', 'RegUp', 'RegDown', 'RRS', 'NSRS']) AS product),
      (SELECT start + h.h * INTERVAL 1 HOUR AS timestamp FROM ({_STARTS}), range(720) h(h))
    EXCEPT SELECT product, timestamp FROM v_shown WHERE hour(timestamp) <> 4"""
_COMPLETENESS = f"""
    SELECT product, timestamp, CASE WHEN hours = 720 THEN 'missing_products' ELSE 'partial_missing' END AS kind
      FROM (SELECT *, count(*) OVER (PARTITION BY product) AS hours FROM ({_MISSING}))
    UNION ALL SELECT product, timestamp, 'missing_timestamps'
      FROM (SELECT *, count(*) OVER (PARTITION BY timestamp) AS products FROM ({_MISSING})) WHERE products = 6"""


def _incomplete(i):
    return i.shown.where(F.hour("timestamp") != 4), i.ticks.agg(F.min(F.date_trunc("day", "timestamp")).alias("start"))


@query("forecast_completeness", "V-09", sql=_COMPLETENESS)
def _(i):
    rows, starts = _incomplete(i)
    return validate.completeness(rows, starts, "start", config.PRODUCTS, 720)


@query(
    "missing_values_by_group",
    "V-10",
    sql="""
    SELECT user_id, hour FROM (SELECT DISTINCT user_id FROM v_ticks), (SELECT unnest(range(24)) AS hour)
    EXCEPT SELECT user_id, hour(timestamp) FROM v_ticks""",
)
def _(i):
    rows = i.ticks.select("user_id", F.hour("timestamp").alias("hour"))
    return validate.missing_values(rows, "user_id", "hour", F.sequence(F.lit(0), F.lit(23)))


# Limits narrow enough for the given prices to break them.
_LIMITS = {"DALMP": (20.0, 40.0, 1.5), "RegUp": (22.0, 38.0, 1.5), "RRS": (21.0, 39.0, 1.5)}
_LIMIT_ROWS = ", ".join(f"('{p}', {a}::DOUBLE, {b}::DOUBLE, {t}::DOUBLE)" for p, (a, b, t) in _LIMITS.items())
_RANGES = f"""
    SELECT 'plausibility' AS category, 'point_range' AS "check", s.product, timestamp, round(point_forecast, 6) AS value,
           'outside the allowed range' AS message
    FROM v_sampled s JOIN (VALUES {_LIMIT_ROWS}) l(product, lo, hi, t) ON l.product = s.product
    WHERE NOT (point_forecast BETWEEN lo AND hi)
    UNION ALL SELECT 'plausibility', 'sample_range', product, timestamp, round(x, 6),
           printf('sample_%03d outside the allowed range', n)
    FROM (SELECT s.product, timestamp, lo, hi, unnest(samples) AS x, unnest(range(1, 65)) AS n
          FROM v_sampled s JOIN (VALUES {_LIMIT_ROWS}) l(product, lo, hi, t) ON l.product = s.product)
    WHERE NOT (x BETWEEN lo AND hi)"""


@query("value_range_violations", "V-11", sql=_RANGES)
def _(i):
    return validate.value_ranges(i.sampled, _LIMITS)


@query(
    "column_range_counts",
    "V-12",
    sql="""
    SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity < 5) AS below, count(*) FILTER (l_quantity > 45) AS above FROM lineitem
    UNION ALL SELECT 'l_discount', 0, count(*) FILTER (l_discount > 0.08) FROM lineitem""",
)
def _(i):
    return validate.column_ranges(i.table("lineitem"), {"l_quantity": (5.0, 45.0), "l_discount": (None, 0.08)})


_OUTLIERS = f"""
    SELECT 'plausibility' AS category, 'outlier' AS "check", s.product, timestamp, round(point_forecast, 6) AS value,
           'far from the mean' AS message
    FROM (SELECT *, avg(point_forecast) OVER w AS m, stddev_samp(point_forecast) OVER w AS s
          FROM {{source}} WINDOW w AS (PARTITION BY product)) s
    JOIN (VALUES {_LIMIT_ROWS}) l(product, lo, hi, t) ON l.product = s.product
    WHERE s.s >= 1e-8 AND abs(point_forecast - m) > t * s.s"""


@query("forecast_outliers", "V-13", sql=_OUTLIERS.format(source="v_shown"))
def _(i):
    return validate.forecast_outliers(i.kept("shown"), _LIMITS)


@query(
    "column_outliers",
    "V-14",
    sql="""
    SELECT o_orderkey, o_orderpriority, round(z, 6) AS z_score FROM (
      SELECT *, (o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w AS z FROM orders
      WINDOW w AS (PARTITION BY o_orderpriority)) WHERE abs(z) > 1.7""",
)
def _(i):
    found = validate.outliers(i.table("orders"), "o_totalprice", 1.7, ["o_orderpriority"], settle)
    return found.select("o_orderkey", "o_orderpriority", "z_score")


_ORDER = """
    SELECT 'consistency' AS category, 'product_order' AS "check", a.product, a.timestamp, round(a.point_forecast, 6) AS value,
           a.product || ' greater_than ' || b.product || ' does not hold' AS message
    FROM v_shown a JOIN v_shown b ON a.timestamp = b.timestamp AND a.product IN ('DALMP', 'RTLMP')
     AND b.product IN ('RegUp', 'RegDown', 'RRS', 'NSRS') WHERE NOT a.point_forecast > b.point_forecast"""


@query("product_order_violations", "V-15", sql=_ORDER)
def _(i):
    return validate.product_order(i.shown)


_SMOOTH = """
    SELECT 'consistency' AS category, 'smoothness' AS "check", product, timestamp, round(change, 6) AS value,
           'change too large' AS message
    FROM (SELECT *, abs(point_forecast - before) / abs(nullif(before, 0)) AS change
          FROM (SELECT *, lag(point_forecast) OVER (PARTITION BY product ORDER BY timestamp) AS before FROM v_shown))
    WHERE change > 0.3::DOUBLE"""


@query("smoothness_violations", "V-16", sql=_SMOOTH)
def _(i):
    return validate.smoothness(i.kept("shown"))


@query("consistency_violations", "V-17", sql=f"{_ORDER} UNION ALL {_SMOOTH}")
def _(i):
    return validate.consistency(i.kept("shown"))


_DEFAULT_ROWS = ", ".join(
    f"('{p}', {a}::DOUBLE, {b}::DOUBLE, {t}::DOUBLE)" for p, (a, b, t) in config.PLAUSIBLE_LIMITS.items()
)


# Lowered prices, so that ancillary products fall below zero.
_LOWERED = """(SELECT product, timestamp, point_forecast - 30 AS point_forecast,
    list_transform(samples, lambda x: x - 30) AS samples FROM v_sampled)"""


@query(
    "plausibility_violations",
    "V-17",
    sql=f"{_RANGES} UNION ALL {_OUTLIERS.format(source='v_sampled')}".replace(_LIMIT_ROWS, _DEFAULT_ROWS).replace(
        "v_sampled", _LOWERED
    ),
)
def _(i):
    lowered = i.sampled.withColumns(
        {"point_forecast": F.col("point_forecast") - 30, "samples": F.transform("samples", lambda x: x - 30)}
    )
    return validate.plausibility(lowered)


_SAMPLED_ORDER = _ORDER.replace("v_shown", "src")
_SAMPLED_SMOOTH = _SMOOTH.replace("v_shown", "src")


@query(
    "forecast_validation_summary",
    "V-18",
    sql=f"""
    WITH src AS ({_FORECAST}), found AS (
      SELECT category FROM {_rows('schema', _FORECAST_CHECKS[:5])}
      UNION ALL SELECT 'completeness' FROM ({_COMPLETENESS.replace("v_shown WHERE hour(timestamp) <> 4", "src")})
      UNION ALL SELECT 'plausibility' FROM (
        SELECT 1 FROM src s JOIN (VALUES {_DEFAULT_ROWS}) l(product, lo, hi, t) ON l.product = s.product
          WHERE coalesce(NOT (point_forecast BETWEEN lo AND hi), true)
        UNION ALL SELECT 1 FROM (SELECT s.product, lo, hi, unnest(samples) AS x FROM src s
          JOIN (VALUES {_DEFAULT_ROWS}) l(product, lo, hi, t) ON l.product = s.product)
          WHERE coalesce(NOT (x BETWEEN lo AND hi), true))
      UNION ALL SELECT category FROM ({_SAMPLED_ORDER}) UNION ALL SELECT category FROM ({_SAMPLED_SMOOTH}))
    SELECT c.category, count(f.category) AS violations, count(f.category) = 0 AS is_valid
    FROM (SELECT unnest(['schema', 'completeness', 'plausibility', 'consistency', 'all']) AS category) c
    LEFT JOIN found f ON f.category = c.category OR c.category = 'all' GROUP BY c.category""",
)
def _(i):
    rows = settle(_broken_forecast(i))
    starts = i.ticks.agg(F.min(F.date_trunc("day", "timestamp")).alias("start"))
    found = validate.forecast(rows, starts, "start", None, SAMPLES, config.PRODUCTS, 720)
    return validate.summary(found)


_BOUNDS = """
    SELECT 'storage' AS category, 'sample_bounds' AS "check", product, timestamp, round(p, 6) AS value,
           'point outside the samples' AS message
    FROM (SELECT *, point_forecast * (1 + (vec_id % 10 - 5) / 10) AS p FROM v_sampled)
    WHERE p < list_min(samples) * 0.9::DOUBLE OR p > list_max(samples) * 1.1::DOUBLE"""


def _moved(i):
    factor = 1 + (F.col("vec_id") % 10 - 5) / 10
    return i.sampled.withColumn("point_forecast", F.col("point_forecast") * factor)


@query("sample_bound_violations", "V-19", sql=_BOUNDS)
def _(i):
    return validate.sample_bounds(_moved(i))


@query(
    "storage_integrity",
    "V-19",
    sql=f"""
    WITH bad AS ({_BOUNDS})
    (SELECT * FROM bad ORDER BY timestamp, product LIMIT 5)
    UNION ALL SELECT 'storage', 'more', NULL, NULL, count(*) - 5.0::DOUBLE, 'more rows' FROM bad HAVING count(*) > 5
    UNION ALL SELECT 'storage', 'missing_metadata', NULL, NULL, NULL, 'missing ' || f
      FROM (SELECT unnest(['storage_version', 'schema_version']) AS f)
    UNION ALL SELECT 'storage', 'data_type', NULL, NULL, NULL, 'storage_timestamp is not a time'""",
)
def _(i):
    return validate.storage_integrity(_moved(i).withColumn("storage_timestamp", F.lit("yesterday")))


@query(
    "price_bound_counts",
    "V-20",
    sql="""
    SELECT product, count(*) AS row_count, count(*) FILTER (p < 0 AND product NOT IN ('DALMP', 'RTLMP')) AS negative_prices,
           count(*) FILTER (NOT p BETWEEN lower_bound AND upper_bound) AS outside_bounds
    FROM (SELECT *, point_forecast - 15 AS p FROM v_shown) GROUP BY product""",
)
def _(i):
    return validate.price_bounds(i.shown.withColumn("point_forecast", F.col("point_forecast") - 15))


@query(
    "schema_versions",
    "V-22",
    sql="""
    SELECT product, count(*) FILTER (event_id % 3 = 1) AS compatible, count(*) FILTER (event_id % 3 <> 1) AS incompatible
    FROM v_ticks GROUP BY product""",
)
def _(i):
    version = F.when(F.col("event_id") % 3 == 1, "1.4.2").when(F.col("event_id") % 3 == 2, "2.0.0")
    fits = validate.version_compatible(version)
    return i.ticks.groupBy("product").agg(
        F.count_if(fits).alias("compatible"), F.count_if(~fits).alias("incompatible")
    )


@query(
    "own_rule_violations",
    "V-25",
    sql="""
    SELECT 'rule' AS category, 'wide_band' AS "check", product, timestamp, round(upper_bound - lower_bound, 6) AS value,
           'band too wide' AS message FROM v_shown WHERE upper_bound - lower_bound > 150
    UNION ALL SELECT 'rule', 'broken', NULL, NULL, NULL, 'rule failed: AnalysisException'""",
)
def _(i):
    def wide(df):
        band = F.col("upper_bound") - F.col("lower_bound")
        return validate.failures(df, "rule", [("wide_band", band > 150, band, "band too wide")])

    return validate.apply_rules(i.shown, {"wide_band": wide, "broken": lambda df: df.select("no_such_column")})


@query(
    "ensemble_violations",
    "V-26",
    sql="""
    WITH src AS (SELECT node AS ensemble_id, product, timestamp, CASE WHEN event_id % 37 = 0 THEN NULL ELSE price END AS point_forecast FROM v_ticks)
    SELECT 'ensemble' AS category, 'time_range' AS "check", product, timestamp, NULL::DOUBLE AS value, 'outside the range of the ensemble' AS message
      FROM src WHERE timestamp < TIMESTAMP '2024-01-02' OR timestamp > TIMESTAMP '2024-01-29'
    UNION ALL SELECT 'ensemble', 'point_forecast', product, timestamp, NULL, 'point forecast is missing' FROM src WHERE point_forecast IS NULL
    UNION ALL SELECT 'ensemble', 'single_product', min(product), NULL, NULL, 'more than one product' FROM src GROUP BY ensemble_id
      HAVING min(product) <> max(product)""",
)
def _(i):
    rows = i.ticks.select(
        F.col("node").alias("ensemble_id"),
        "product",
        "timestamp",
        F.when(F.col("event_id") % 37 == 0, None).otherwise(F.col("price")).alias("point_forecast"),
        F.lit("2024-01-02").cast("timestamp").alias("start_time"),
        F.lit("2024-01-29").cast("timestamp").alias("end_time"),
    )
    return validate.ensembles(rows)


