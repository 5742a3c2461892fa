"""Finding and using earlier forecasts."""

from pyspark.sql import functions as F

from pricecast.operators import fallback
from pricecast.plans.registry import query
from pricecast.sources import store

_AS_OF = "2024-02-10 07:00:00"


def _as_of():
    return F.lit(_AS_OF).cast("timestamp")


@query(
    "fallback_suitable",
    "B-01",
    sql="""
    SELECT forecast_date, product, horizon_hours >= 24 AS suitable, horizon_hours >= 24 AND NOT is_fallback AS suitable_fresh
    FROM v_index""",
)
def _(i):
    return store.index_of(i.stored).select(
        "forecast_date",
        "product",
        fallback.suitable().alias("suitable"),
        fallback.suitable(allow_cascading=False).alias("suitable_fresh"),
    )


def _targets(i):
    """Every product needs a forecast for the dates around the end of the store."""
    return i.kept("stored").select("product", F.date_add("forecast_date", 4).alias("target_date")).distinct()


_TARGETS = "SELECT DISTINCT product, forecast_date + INTERVAL 4 DAY AS target_date FROM v_stored"
_SOURCES = f"""
    SELECT t.product, t.target_date, i.forecast_date, date_diff('day', i.forecast_date, t.target_date) AS age_days,
           i.is_fallback, i.generation_timestamp, i.horizon_hours
    FROM ({_TARGETS}) t JOIN v_index i ON i.product = t.product
     AND i.forecast_date BETWEEN t.target_date - INTERVAL 7 DAY AND t.target_date - INTERVAL 1 DAY
    WHERE horizon_hours >= 24 {{extra}}
    QUALIFY row_number() OVER (PARTITION BY t.product, t.target_date ORDER BY i.forecast_date DESC) = 1"""
_ALL = _SOURCES.format(extra="")


@query(
    "fallback_sources",
    "B-02",
    "J-07",
    sql=f"SELECT product, target_date, forecast_date, age_days FROM ({_ALL})",
)
def _(i):
    found = fallback.find_source(_targets(i), store.index_of(i.kept("stored")))
    return found.select("product", "target_date", "forecast_date", "age_days")


@query(
    "fallback_sources_fresh",
    "B-02",
    sql=f"SELECT product, target_date, forecast_date, age_days FROM ({_SOURCES.format(extra='AND NOT is_fallback')})",
)
def _(i):
    found = fallback.find_source(_targets(i), store.index_of(i.kept("stored")), allow_cascading=False)
    return found.select("product", "target_date", "forecast_date", "age_days")


@query(
    "fallback_shifted",
    "B-03",
    sql=f"""
    SELECT product, timestamp + INTERVAL 3 DAY AS timestamp, round(point_forecast, 6) AS point_forecast, true AS is_fallback,
           TIMESTAMP '{_AS_OF}' AS generation_timestamp FROM v_stored""",
)
def _(i):
    rows = i.stored.withColumn("target_date", F.date_add("forecast_date", 3))
    return fallback.shift_to_target(rows, _as_of()).select(
        "product", "timestamp", "point_forecast", "is_fallback", "generation_timestamp"
    )


@query(
    "fallback_retrieved",
    "B-04",
    sql=f"""
    SELECT s.product, f.target_date AS forecast_date, timestamp + f.age_days * INTERVAL 1 DAY AS timestamp,
           round(point_forecast, 6) AS point_forecast, true AS is_fallback
    FROM v_stored s JOIN ({_ALL}) f ON f.product = s.product AND f.forecast_date = s.forecast_date""",
)
def _(i):
    rows, _ = fallback.retrieve(_targets(i), store.index_of(i.kept("stored")), i.kept("stored"), _as_of())
    return rows.select("product", "forecast_date", "timestamp", "point_forecast", "is_fallback")


@query(
    "fallback_without_source",
    "B-04",
    sql=f"""
    SELECT product, target_date FROM (SELECT DISTINCT product, forecast_date AS target_date FROM v_stored) t
    WHERE NOT EXISTS (SELECT 1 FROM v_index i WHERE i.product = t.product AND horizon_hours >= 24
      AND i.forecast_date BETWEEN t.target_date - INTERVAL 7 DAY AND t.target_date - INTERVAL 1 DAY)""",
)
def _(i):
    targets = i.kept("stored").select("product", F.col("forecast_date").alias("target_date")).distinct()
    return fallback.retrieve(targets, store.index_of(i.kept("stored")), i.kept("stored"), _as_of())[1]


@query(
    "fallback_lineage",
    "B-05",
    sql=f"""
    SELECT product, forecast_date AS source_date, target_date, age_days AS fallback_age_days,
           is_fallback AS is_cascading_fallback, generation_timestamp AS original_generation_time, horizon_hours FROM ({_ALL})""",
)
def _(i):
    return fallback.lineage(fallback.find_source(_targets(i), store.index_of(i.kept("stored"))))


@query(
    "fallback_filled_in",
    "B-06",
    sql=f"""
    WITH failed AS (SELECT forecast_date, product FROM v_index WHERE horizon_hours < 24 OR row_count < 20)
    SELECT forecast_date, product, timestamp, round(point_forecast, 6) AS point_forecast, is_fallback FROM v_stored
    WHERE (forecast_date, product) NOT IN (SELECT (forecast_date, product) FROM failed)
    UNION ALL SELECT t.target_date, s.product, s.timestamp + date_diff('day', s.forecast_date, t.target_date) * INTERVAL 1 DAY,
           round(point_forecast, 6), true
    FROM (SELECT f.product, f.forecast_date AS target_date, i.forecast_date AS source
          FROM failed f JOIN v_index i ON i.product = f.product AND i.horizon_hours >= 24
           AND i.forecast_date BETWEEN f.forecast_date - INTERVAL 7 DAY AND f.forecast_date - INTERVAL 1 DAY
          QUALIFY row_number() OVER (PARTITION BY f.product, f.forecast_date ORDER BY i.forecast_date DESC) = 1) t
    JOIN v_stored s ON s.product = t.product AND s.forecast_date = t.source""",
)
def _(i):
    index = store.index_of(i.kept("stored"))
    failed = index.where("horizon_hours < 24 or row_count < 20").select("forecast_date", "product")
    targets = failed.select("product", F.col("forecast_date").alias("target_date"))
    columns = ["forecast_date", "product", "timestamp", "point_forecast", "is_fallback", "generation_timestamp"]
    fresh = i.kept("stored").select(*columns)
    rows, _ = fallback.retrieve(targets, index, fresh, _as_of())
    return fallback.fill_in(fresh, failed, rows).drop("generation_timestamp")
