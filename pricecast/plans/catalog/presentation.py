"""Reader-facing tables."""

from pyspark.sql import functions as F

from pricecast.functions import calendar
from pricecast.operators import present
from pricecast.plans.registry import query
from pricecast.sources.scratch import settle

_SIGNED = "product IN ('DALMP', 'RTLMP')"


def _plain(x):
    """Two decimals, halves up, like the decimal text of the value."""
    return f"""printf('%.2f', round(CAST(CASE WHEN NOT ({_SIGNED}) AND {x} < 0 THEN 0 ELSE {x} END AS DECIMAL(20, 9)), 2)::DOUBLE)"""


def _money(x):
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE '$' || {_plain(x)} END"


def _range(a, b):
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN '-' ELSE '$' || {_plain(a)} || ' - ' || {_plain(b)} END"


_LABEL = "strftime(timestamp, '%b %-d, %H:%M')"
# Prices around zero, so that signs matter.
_SHIFTED = """
    SELECT product, timestamp, round(point_forecast - 20, 9) AS point_forecast, lower_bound - 20 AS lower_bound,
           CASE WHEN hour(timestamp) = 3 THEN NULL ELSE upper_bound - 20 END AS upper_bound FROM v_shown"""


def _shifted(i):
    return i.shown.select(
        "product",
        "timestamp",
        F.round(F.col("point_forecast") - 20, 9).alias("point_forecast"),
        (F.col("lower_bound") - 20).alias("lower_bound"),
        F.when(F.hour("timestamp") == 3, None).otherwise(F.col("upper_bound") - 20).alias("upper_bound"),
    )


@query(
    "time_series_table",
    "T-01",
    sql=f"""
    SELECT timestamp, product, round(point_forecast, 6) AS point_forecast, {_LABEL} AS x_label, {_money("point_forecast")} AS point_text,
           {_money("lower_bound")} AS lower_text, {_money("upper_bound")} AS upper_text,
           round(upper_bound - lower_bound, 6) AS range, {_range("lower_bound", "upper_bound")} AS range_text FROM ({_SHIFTED})""",
)
def _(i):
    return present.time_series_table(_shifted(i))


def _q(q):
    return f"list_aggregate(samples, 'quantile_cont', {q}::DOUBLE)"


@query(
    "hourly_table",
    "T-02",
    sql=f"""
    SELECT timestamp, product, {_LABEL} AS hour_label, round(point_forecast, 6) AS point_forecast, {_money("point_forecast")} AS point_text,
           round(p10, 6) AS percentile_10, round(p90, 6) AS percentile_90, {_money("p10")} AS percentile_10_text,
           {_money("p90")} AS percentile_90_text, round(p90 - p10, 6) AS range, {_range("p10", "p90")} AS range_text
    FROM (SELECT *, {_q(0.1)} AS p10, {_q(0.9)} AS p90 FROM v_sampled)""",
)
def _(i):
    return present.hourly_table(i.sampled)


@query(
    "comparison_table",
    "T-03",
    sql=f"""
    SELECT timestamp, product, round(point_forecast, 6) AS point_forecast, {_LABEL} AS x_label, {_money("point_forecast")} AS point_text
    FROM ({_SHIFTED}) WHERE product IN ('DALMP', 'RRS')""",
)
def _(i):
    return present.comparison_table(_shifted(i), ["DALMP", "RRS"])


@query(
    "price_spikes",
    "T-04",
    sql=f"""
    SELECT timestamp, product, round(point_forecast, 6) AS point_forecast, round(m + 2 * s, 6) AS threshold,
           round(point_forecast - m, 6) AS deviation, round((point_forecast / m - 1) * 100, 6) AS deviation_percent, {_LABEL} AS hour_label
    FROM (SELECT *, avg(point_forecast) OVER w AS m, stddev_samp(point_forecast) OVER w AS s FROM v_shown
          WINDOW w AS (PARTITION BY product)) WHERE point_forecast > m + 2 * s""",
)
def _(i):
    return present.price_spikes(i.kept("shown"), settle=settle)


@query(
    "formatted_prices",
    "T-05",
    sql="""
    SELECT o_orderkey, '$' || printf('%.2f', o_totalprice) AS price_text, strftime(o_orderdate, '%b %-d, %H:%M') AS label,
           CASE WHEN o_custkey % 5 = 0 THEN '-' ELSE '$0.00 - ' || printf('%.2f', o_totalprice) END AS range_text FROM orders""",
)
def _(i):
    price = F.col("o_totalprice")
    top = F.when(F.col("o_custkey") % 5 != 0, price)
    return i.table("orders").select(
        "o_orderkey",
        calendar.money(price).alias("price_text"),
        calendar.date_hour_label(F.col("o_orderdate")).alias("label"),
        calendar.money_range(-price, top, can_be_negative=False).alias("range_text"),
    )
