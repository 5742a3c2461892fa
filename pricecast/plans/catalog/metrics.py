"""Accuracy metrics, intervals and comparisons."""

from pyspark.sql import functions as F

from pricecast.operators import intervals, metrics, reshape, topk
from pricecast.plans.catalog.shaping import node_ensembles
from pricecast.plans.inputs import hours
from pricecast.plans.registry import query

# --- point metrics -----------------------------------------------------------------------------

_E = "(actual - forecast)"
_METRICS = {
    "rmse": f"sqrt(avg({_E} * {_E}))",
    "mae": f"avg(abs({_E}))",
    "mape": f"CASE WHEN NOT bool_or(actual = 0) THEN avg(abs({_E} / nullif(actual, 0))) * 100 END",
    "r2": f"CASE WHEN count(*) >= 2 THEN 1 - sum({_E} * {_E}) / nullif(var_pop(actual) * count(*), 0) END",
    "bias": "avg(forecast - actual)",
    "pinball": f"avg(greatest(0.5::DOUBLE * {_E}, -0.5::DOUBLE * {_E}))",
}


def _metric_sql(names, group="product", source="v_pairs"):
    cells = ", ".join(f"round({_METRICS[n]}, 6) AS {n}" for n in names)
    return f"SELECT {group}, {cells} FROM {source} GROUP BY {group}"


for _name, _row in {"rmse": "E-01", "mae": "E-02", "mape": "E-03", "r2": "E-04", "bias": "E-05"}.items():

    @query(f"accuracy_{_name}", _row, sql=_metric_sql([_name]))
    def _(i, name=_name):
        return metrics.accuracy(i.pairs, ["product"], [name])


@query(
    "accuracy_pinball",
    "E-06",
    sql=f"""
    SELECT product, round(avg(greatest(0.1::DOUBLE * {_E}, -0.9::DOUBLE * {_E})), 6) AS pinball_10,
           round(avg(greatest(0.9::DOUBLE * {_E}, -0.1::DOUBLE * {_E})), 6) AS pinball_90 FROM v_pairs GROUP BY product""",
)
def _(i):
    a, f = F.col("actual"), F.col("forecast")
    return i.pairs.groupBy("product").agg(
        metrics.pinball(a, f, 0.1).alias("pinball_10"), metrics.pinball(a, f, 0.9).alias("pinball_90")
    )


@query("accuracy_all", "E-07", sql=_metric_sql(list(_METRICS)))
def _(i):
    return metrics.accuracy(i.pairs, ["product"])


@query(
    "accuracy_by_hour",
    "E-07",
    "E-14",
    sql=f"""
    SELECT product, hour, round({_METRICS["mae"]}, 6) AS mae, round({_METRICS["rmse"]}, 6) AS rmse
    FROM (SELECT *, hour(timestamp) AS hour FROM v_pairs) GROUP BY product, hour""",
)
def _(i):
    rows = i.pairs.withColumn("hour", F.hour("timestamp"))
    return metrics.accuracy(rows, ["product", "hour"], ["mae", "rmse"])


@query("accuracy_summary", "E-14", sql=_metric_sql(["mae", "rmse"]))
def _(i):
    return metrics.accuracy(i.pairs, ["product"], ["mae", "rmse"])


# --- with samples ------------------------------------------------------------------------------

# Sampled forecasts against the price of the same hour.
_SCORED = """
    SELECT s.product, s.timestamp, s.point_forecast AS forecast, s.samples, h.load_mw / 12 AS actual, s.is_fallback
    FROM v_sampled s JOIN v_system_load h ON h.timestamp = s.timestamp"""


def _scored(i):
    actual = i.system_load.select("timestamp", (F.col("load_mw") / 12).alias("actual"))
    rows = i.sampled.join(actual, "timestamp")
    return rows.select("product", "timestamp", F.col("point_forecast").alias("forecast"), "samples", "actual")


def _q(q):
    return f"list_aggregate(samples, 'quantile_cont', {q!r}::DOUBLE)"


def _inside(level):
    return f"(actual BETWEEN {_q((1 - level) / 2)} AND {_q(1 - (1 - level) / 2)})::INT"


_STEP = "list_sort(samples)[least(floor({q} * len(samples))::INT, len(samples) - 1) + 1]"


def _step_loss(q):
    e = f"(actual - {_STEP.format(q=q)})"
    return f"avg(greatest({q}::DOUBLE * {e}, ({q} - 1)::DOUBLE * {e}))"


@query(
    "interval_coverage",
    "E-08",
    sql=f"SELECT product, round(avg({_inside(0.8)}), 6) AS coverage FROM ({_SCORED}) GROUP BY product",
)
def _(i):
    return metrics.coverage(_scored(i), 0.8, ["product"])


_LEVELS = {0.5: "50", 0.8: "80", 0.9: "90", 0.95: "95", 0.99: "99"}


@query(
    "accuracy_probabilistic",
    "E-09",
    sql=f"""
    SELECT product, {", ".join(f"round({m}, 6) AS {n}" for n, m in _METRICS.items())},
      {", ".join(f"round(avg({_inside(c)}), 6) AS coverage_{n}" for c, n in _LEVELS.items())},
      {", ".join(f"round({_step_loss(q)}, 6) AS pinball_{n}" for q, n in ((0.1, 10), (0.5, 50), (0.9, 90)))}
    FROM ({_SCORED}) GROUP BY product""",
)
def _(i):
    return metrics.probabilistic(_scored(i), ["product"])


_METHODS = """
    SELECT 'day' AS method, product, actual, forecast FROM v_pairs UNION ALL
    SELECT 'hour', a.product, a.price, b.price FROM v_hourly a
      JOIN v_hourly b ON a.product = b.product AND a.timestamp = b.timestamp + INTERVAL 1 HOUR UNION ALL
    SELECT 'week', a.product, a.price, b.price FROM v_hourly a
      JOIN v_hourly b ON a.product = b.product AND a.timestamp = b.timestamp + INTERVAL 168 HOUR"""


def _methods(i):
    """Three ways to forecast a price: the hour, the day and the week before."""
    actual = i.kept("hourly").withColumnRenamed("price", "actual")
    parts = []
    for name, n in (("hour", 1), ("day", 24), ("week", 168)):
        earlier = i.kept("hourly").select(
            "product", (F.col("timestamp") + hours(n)).alias("timestamp"), F.col("price").alias("forecast")
        )
        parts.append(actual.join(earlier, ["product", "timestamp"]).withColumn("method", F.lit(name)))
    return topk.concat(*parts).select("method", "product", "actual", "forecast")


_FOUR = ("rmse", "mae", "r2", "bias")


@query("methods_compared", "E-10", "P-06", sql=_metric_sql(_FOUR, "method", f"({_METHODS})"))
def _(i):
    return metrics.compare_methods(_methods(i), _FOUR)


@query(
    "methods_compared_long",
    "P-05",
    "P-06",
    sql=f"""
    SELECT method, metric, value FROM ({_metric_sql(_FOUR, "method", f"({_METHODS})")})
    UNPIVOT (value FOR metric IN (rmse, mae, r2, bias))""",
)
def _(i):
    return reshape.long_metrics(metrics.compare_methods(_methods(i), _FOUR), ["method"], _FOUR)


for _name, _order in {"rmse": "score", "r2": "-score", "bias": "abs(score)"}.items():

    @query(
        f"best_method_by_{_name}",
        "O-04",
        sql=f"""
        SELECT product, method, round(score, 6) AS score FROM (
          SELECT product, method, {_METRICS[_name]} AS score FROM ({_METHODS}) GROUP BY product, method)
        QUALIFY row_number() OVER (PARTITION BY product ORDER BY {_order}, method) = 1""",
    )
    def _(i, name=_name):
        scores = metrics.accuracy(_methods(i), ["product", "method"], [name])
        return topk.best(scores, name, "method", ["product"])


@query(
    "forecast_improvement",
    "E-11",
    sql=f"""
    SELECT product, round(m1, 6) AS metric_1, round(m2, 6) AS metric_2, round(coalesce((m1 - m2) / nullif(abs(m1), 0) * 100, 0), 6) AS improvement
    FROM (SELECT product, avg(abs(actual - forecast)) AS m1, avg(abs(actual - (forecast + second) / 2)) AS m2
          FROM (SELECT p.*, w.price AS second FROM v_pairs p
                JOIN v_hourly w ON w.product = p.product AND p.timestamp = w.timestamp + INTERVAL 48 HOUR) GROUP BY product)""",
)
def _(i):
    earlier = i.kept("hourly").select("product", (F.col("timestamp") + hours(48)).alias("timestamp"), F.col("price").alias("second"))
    rows = i.pairs.join(earlier, ["product", "timestamp"]).select(
        "product",
        "actual",
        F.col("forecast").alias("forecast_1"),
        ((F.col("forecast") + F.col("second")) / 2).alias("forecast_2"),
    )
    return metrics.improvement(rows, "mae", groups=["product"])


_COMPLETE = f"""
    SELECT s.product, a.actual, f.point_forecast AS forecast, f.samples
    FROM (SELECT product, timestamp, actual FROM (SELECT product, timestamp, actual FROM ({_SCORED}))
          UNION ALL SELECT 'NSRS', (SELECT max(timestamp) FROM v_sampled) + INTERVAL 1 HOUR, 1.0) a
    JOIN (SELECT DISTINCT product FROM v_sampled) s ON s.product = a.product
    LEFT JOIN v_sampled f ON f.product = a.product AND f.timestamp = a.timestamp"""


@query(
    "ensemble_accuracy",
    "E-12",
    sql=f"""
    SELECT product, {", ".join(f"round({m}, 6) AS {n}" for n, m in _METRICS.items())},
      {", ".join(f"round(avg({_inside(c)}), 6) AS coverage_{n}" for c, n in _LEVELS.items())}
    FROM ({_COMPLETE}) GROUP BY product HAVING count(*) = count(forecast)""",
)
def _(i):
    # The actuals of one product go an hour beyond its forecast, so that product has no metrics.
    beyond = i.sampled.agg((F.max("timestamp") + hours(1)).alias("timestamp")).select(
        F.lit("NSRS").alias("product"), "timestamp", F.lit(1.0).alias("actual")
    )
    actual = _scored(i).select("product", "timestamp", "actual").unionByName(beyond)
    return metrics.ensemble_accuracy(i.sampled.select("product", "timestamp", "point_forecast", "samples"), actual)


@query(
    "ensembles_pairwise",
    "E-13",
    sql="""
    SELECT a.product, a.node AS ensemble, b.node AS comparison, round(sqrt(avg((a.p - b.p) * (a.p - b.p))), 6) AS rmse,
           round(avg(abs(a.p - b.p)), 6) AS mae, round(avg(a.p - b.p), 6) AS bias, count(*) AS hours
    FROM (SELECT node, product, timestamp, round(avg(price), 12) AS p FROM v_ticks GROUP BY ALL) a
    JOIN (SELECT node, product, timestamp, round(avg(price), 12) AS p FROM v_ticks GROUP BY ALL) b
      ON a.product = b.product AND a.timestamp = b.timestamp AND a.node <> b.node GROUP BY ALL""",
)
def _(i):
    return metrics.pairwise(node_ensembles(i), ["HB_0", "HB_1", "HB_2"])


# --- percentiles and intervals -----------------------------------------------------------------


@query(
    "sample_percentiles",
    "I-01",
    sql=f"SELECT vec_id, product, {', '.join(f'round({_q(q / 100)}, 6) AS p{q}' for q in (5, 10, 50, 90, 95))} FROM v_sampled",
)
def _(i):
    rows = intervals.percentile_columns(i.sampled, (5, 10, 50, 90, 95))
    return rows.select("vec_id", "product", "p5", "p10", "p50", "p90", "p95")


@query(
    "confidence_intervals",
    "I-02",
    sql=f"SELECT vec_id, round({_q((1 - 0.8) / 2)}, 6) AS interval_low, round({_q(1 - (1 - 0.8) / 2)}, 6) AS interval_high FROM v_sampled",
)
def _(i):
    return intervals.confidence_interval(i.sampled, 0.8).select("vec_id", "interval_low", "interval_high")


@query(
    "display_frame",
    "I-03",
    sql=f"""
    SELECT timestamp, product, round(point_forecast, 6) AS point_forecast, round({_q(0.1)}, 6) AS lower_bound,
           round({_q(0.9)}, 6) AS upper_bound, is_fallback FROM v_sampled""",
)
def _(i):
    return intervals.display_frame(i.sampled)


@query(
    "uncertainty_band",
    "I-04",
    sql=f"""
    SELECT timestamp, round(point_forecast, 6) AS point_forecast, round({_q(0.1)}, 6) AS lower_bound,
           round({_q(0.9)}, 6) AS upper_bound FROM v_sampled WHERE product = 'RTLMP'""",
)
def _(i):
    return intervals.uncertainty_band(i.sampled, "RTLMP")


@query(
    "distribution_markers",
    "I-05",
    sql=f"""
    SELECT timestamp, product, unnest([10.0, 50.0, 90.0])::DOUBLE AS percentile,
           round(unnest([{_q(0.1)}, {_q(0.5)}, {_q(0.9)}]), 6) AS value FROM v_sampled""",
)
def _(i):
    return intervals.distribution_markers(i.sampled)


