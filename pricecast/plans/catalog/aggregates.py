"""Summaries of prices, generation and forecasts."""

from pyspark.sql import functions as F

from pricecast.functions.quantiles import exact_quantiles
from pricecast.operators import aggregates as agg
from pricecast.operators import present
from pricecast.plans.inputs import PRODUCTS
from pricecast.plans.registry import query, rounded
from pricecast.sources import store
from pricecast.sources.scratch import settle


@query(
    "total_generation",
    "A-01",
    sql="SELECT timestamp, round(sum(generation_mw), 6) AS total_generation_mw FROM v_generation GROUP BY ALL",
)
def _(i):
    return agg.total_generation(i.generation)


@query(
    "price_statistics",
    "A-02",
    sql="""
    SELECT DISTINCT t.product, timestamp, price_mean, price_std, price_min, price_max FROM v_ticks t JOIN (
      SELECT product, round(avg(price), 6) AS price_mean, round(stddev_samp(price), 6) AS price_std,
             min(price) AS price_min, max(price) AS price_max FROM v_ticks GROUP BY product) s USING (product)""",
)
def _(i):
    return agg.price_statistics(i.ticks, settle)


def _trailing(span):
    return f"(PARTITION BY product ORDER BY timestamp RANGE BETWEEN INTERVAL '{span}' PRECEDING AND CURRENT ROW)"


def _rolling_sql(span, source="v_hourly"):
    return f"""
    SELECT product, timestamp, price, round(avg(price) OVER w, 6) AS price_mean,
           round(stddev_samp(price) OVER w, 6) AS price_std, min(price) OVER w AS price_min, max(price) OVER w AS price_max
    FROM {source} WINDOW w AS {_trailing(span)}"""


@query("rolling_day_statistics", "X-13", sql=_rolling_sql("23:59:59.999999"), doubles="price price_max price_min")
def _(i):
    return agg.rolling_price_statistics(i.kept("hourly"), 24 * 3600, settle)


@query("rolling_week_statistics", "X-13", sql=_rolling_sql("167:59:59.999999"), doubles="price price_max price_min")
def _(i):
    return agg.rolling_price_statistics(i.kept("hourly"), 7 * 24 * 3600, settle)


@query(
    "rolling_peak_hours",
    "F-02",
    "X-04",
    "O-02",
    sql=f"""
    SELECT product, timestamp, price, price_mean, price_std,
           row_number() OVER (PARTITION BY product ORDER BY price DESC, timestamp) AS rank
    FROM ({_rolling_sql("23:59:59.999999", "(SELECT * FROM v_hourly WHERE timestamp BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-28 23:59:59')")})
    QUALIFY rank <= 3""",
    doubles="price",
)
def _(i):
    from pricecast.operators import topk

    at = lambda s: F.lit(s).cast("timestamp")
    rows = present.by_date_range(i.hourly, at("2024-01-02 00:00:00"), at("2024-01-28 00:00:00"))
    rolled = agg.rolling_price_statistics(rows, 24 * 3600)
    return topk.top_hours(rolled, 3, value="price").select(
        "product", "timestamp", "price", "price_mean", "price_std", "rank"
    )


@query(
    "forecast_statistics",
    "A-03",
    sql="""
    SELECT product, round(min(point_forecast), 6) AS min_price, round(max(point_forecast), 6) AS max_price,
           round(avg(point_forecast), 6) AS mean_price, round(stddev_samp(point_forecast), 6) AS std_price,
           round(quantile_cont(point_forecast, 0.5), 6) AS median_price, max(peak_hour_1) AS peak_hour_1,
           max(peak_hour_2) AS peak_hour_2, max(peak_hour_3) AS peak_hour_3
    FROM (SELECT *, CASE WHEN r = 1 THEN timestamp END AS peak_hour_1, CASE WHEN r = 2 THEN timestamp END AS peak_hour_2,
            CASE WHEN r = 3 THEN timestamp END AS peak_hour_3
          FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY point_forecast DESC, timestamp) AS r FROM v_shown))
    GROUP BY product""",
)
def _(i):
    return agg.forecast_statistics(i.kept("shown"), settle)


@query(
    "order_price_quantiles",
    "A-03",
    sql="""
    SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2,
           round(quantile_cont(o_totalprice, 0.9), 4) AS q9 FROM orders GROUP BY ALL""",
)
def _(i):
    found = exact_quantiles(
        i.table("orders"), ["o_orderpriority"], "o_totalprice", {"q1": 0.25, "q2": 0.5, "q9": 0.9}, settle
    )
    return rounded(found, "q1", "q2", "q9")


@query(
    "forecast_summary",
    "A-04",
    sql="""
    SELECT product, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS hours,
           round(avg(point_forecast), 6) AS mean_price, round(avg(lower_bound), 6) AS mean_lower,
           round(avg(upper_bound), 6) AS mean_upper, round(avg(upper_bound - lower_bound), 6) AS mean_range,
           bool_or(is_fallback) AS has_fallback,
           CASE product WHEN 'DALMP' THEN 'Day-Ahead LMP' WHEN 'RTLMP' THEN 'Real-Time LMP' WHEN 'RegUp' THEN 'Regulation Up'
             WHEN 'RegDown' THEN 'Regulation Down' ELSE 'Responsive Reserve' END AS display_name,
           CASE WHEN product IN ('DALMP', 'RTLMP') THEN '$/MWh' ELSE '$/MW' END AS unit
    FROM v_shown GROUP BY product""",
)
def _(i):
    return agg.forecast_summary(i.shown)


@query(
    "forecast_metadata",
    "A-05",
    sql="""
    SELECT max(generation_timestamp) AS generation_timestamp, bool_or(is_fallback) AS is_fallback,
           min(timestamp) AS start_time, max(timestamp) AS end_time, count(DISTINCT timestamp) AS hours,
           array_to_string(list_sort(list(DISTINCT product)), ',') AS products FROM v_stored""",
)
def _(i):
    return agg.forecast_metadata(i.stored).withColumn("products", F.concat_ws(",", "products"))


@query(
    "forecast_resampled",
    "A-06",
    sql="""
    SELECT g.product, g.timestamp, round(avg(point_forecast), 6) AS point_forecast, min(lower_bound) AS lower_bound,
           max(upper_bound) AS upper_bound
    FROM (SELECT product, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, min(timestamp)),
            time_bucket(INTERVAL 6 HOUR, max(timestamp)), INTERVAL 6 HOUR)) AS timestamp FROM v_shown GROUP BY product) g
    LEFT JOIN v_shown s ON s.product = g.product AND time_bucket(INTERVAL 6 HOUR, s.timestamp) = g.timestamp
    GROUP BY ALL""",
)
def _(i):
    return agg.resample_forecast(i.kept("shown"), "6 hours")


@query(
    "ensemble_statistics",
    "A-07",
    sql="""
    SELECT product, count(*) AS forecast_count, round(avg(point_forecast), 6) AS mean_point,
           round(min(point_forecast), 6) AS min_point, round(max(point_forecast), 6) AS max_point,
           round(avg(is_fallback::INT) * 100, 6) AS fallback_percent FROM v_shown GROUP BY product""",
)
def _(i):
    return agg.ensemble_statistics(i.shown)


@query(
    "ensembles_assembled",
    "A-14",
    sql="""
    SELECT product, timestamp, point_forecast, min(timestamp) OVER w AS start_time, max(timestamp) OVER w AS end_time,
           max(generation_timestamp) OVER w AS ensemble_generation_timestamp,
           bool_or(is_fallback) OVER w AS ensemble_is_fallback
    FROM v_stored WINDOW w AS (PARTITION BY product)""",
    doubles="point_forecast",
)
def _(i):
    return agg.assemble_ensembles(i.kept("stored"), settle=settle).select(
        "product",
        "timestamp",
        "point_forecast",
        "start_time",
        "end_time",
        "ensemble_generation_timestamp",
        "ensemble_is_fallback",
    )


@query(
    "sample_statistics",
    "A-08",
    sql="""
    SELECT product, timestamp, round(m, 6) AS sample_mean, round(quantile_cont(x, 0.5), 6) AS sample_median,
           round(stddev_pop(x), 6) AS sample_std, round(min(x), 6) AS sample_min, round(max(x), 6) AS sample_max,
           round(max(x) - min(x), 6) AS sample_range,
           round(avg(power(x - m, 3)) / power(stddev_pop(x), 3), 6) AS sample_skew,
           round(avg(power(x - m, 4)) / power(var_pop(x), 2) - 3, 6) AS sample_kurtosis
    FROM (SELECT vec_id, product, timestamp, list_avg(samples) AS m, unnest(samples) AS x FROM v_sampled)
    GROUP BY vec_id, product, timestamp, m""",
)
def _(i):
    return agg.sample_statistics(i.sampled)


def _merged_sql(function):
    return f"""
    SELECT product, timestamp, round(max(p) FILTER (pos = 0), 6) AS point_forecast,
           round(max(p) FILTER (pos = 1), 6) AS first_sample, round(sum(p) FILTER (pos > 0), 5) AS sample_total,
           bool_or(f) AS is_fallback, count(*) - 1 AS sample_count
    FROM (SELECT product, timestamp, pos, {function} AS p, bool_or(is_fallback) AS f
          FROM (SELECT product, timestamp, is_fallback, unnest(range(65)) AS pos,
                       unnest(list_concat([point_forecast], samples)) AS x FROM v_copies)
          GROUP BY ALL) GROUP BY ALL"""


def _merged(i, how):
    rows = agg.aggregate_forecasts(i.copies, how, settle)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "product",
        "timestamp",
        "point_forecast",
        F.element_at("samples", 1).alias("first_sample"),
        F.round(total, 5).alias("sample_total"),
        "is_fallback",
        F.size("samples").alias("sample_count"),
    )


@query("forecasts_averaged", "A-09", sql=_merged_sql("avg(x)"))
def _(i):
    return _merged(i, "mean")


@query("forecasts_median", "A-09", sql=_merged_sql("quantile_cont(x, 0.5)"))
def _(i):
    return _merged(i, "median")


@query(
    "fallback_figures",
    "A-10",
    sql="""
    SELECT product, count(*) AS row_count, date_diff('hour', min(timestamp), max(timestamp)) AS horizon_hours,
           bool_or(is_fallback) AS any_cascading, min(generation_timestamp) AS original_generation
    FROM v_stored GROUP BY product""",
)
def _(i):
    rows = i.stored.withColumnsRenamed(
        {"is_fallback": "is_cascading", "generation_timestamp": "original_generation"}
    )
    return agg.fallback_figures(rows)


@query(
    "fallback_rate_by_month",
    "A-11",
    sql="""
    SELECT date_trunc('month', forecast_date) AS month, count(*) AS forecasts,
           round(avg(is_fallback::INT) * 100, 6) AS fallback_percent FROM v_index GROUP BY ALL""",
)
def _(i):
    return agg.fallback_rate(store.index_of(i.stored))


@query(
    "availability_by_month",
    "A-11",
    sql="""
    SELECT date_trunc('month', forecast_date) AS month, count(*) AS days, round(avg(ok::INT) * 100, 6) AS available_percent
    FROM (SELECT forecast_date, min(generation_timestamp) <= forecast_date - INTERVAL 1 DAY + INTERVAL 8 HOUR AS ok
          FROM v_index GROUP BY forecast_date) GROUP BY ALL""",
)
def _(i):
    return agg.availability(store.index_of(i.stored))


@query(
    "completeness_by_day",
    "A-11",
    sql="""
    SELECT date_trunc('day', timestamp) AS forecast_date, count(*) AS present, round(count(*) / 120.0::DOUBLE * 100, 6) AS complete_percent
    FROM v_shown GROUP BY ALL""",
)
def _(i):
    return agg.completeness(i.shown, PRODUCTS)


@query(
    "sample_histogram",
    "A-12",
    sql="""
    SELECT s.product, s.timestamp, b.bin, round(lo + b.bin * w, 6) AS bin_start, count(x.place) AS sample_count,
           round(count(x.place) / (64 * w), 6) AS density
    FROM (SELECT vec_id, product, timestamp, list_min(samples) AS lo, (list_max(samples) - list_min(samples)) / 30 AS w FROM v_sampled) s,
      (SELECT unnest(range(30)) AS bin) b
    LEFT JOIN (SELECT vec_id, least(floor((x - lo) / w), 29)::BIGINT AS place
      FROM (SELECT vec_id, list_min(samples) AS lo, (list_max(samples) - list_min(samples)) / 30 AS w, unnest(samples) AS x
            FROM v_sampled)) x ON x.vec_id = s.vec_id AND x.place = b.bin
    GROUP BY s.vec_id, s.product, s.timestamp, b.bin, lo, w""",
)
def _(i):
    return agg.histogram(i.sampled)
