"""Feature columns, lags, scalers and feature sets."""

from pyspark.sql import functions as F

from pricecast import config
from pricecast.functions.timeline import DAY, trailing
from pricecast.operators import features, scaling
from pricecast.plans.inputs import FUELS, PRODUCTS
from pricecast.plans.registry import query, rounded
from pricecast.sources.scratch import new_folder, settle

_LAGS = (1, 2, 3, 6, 12, 24, 48, 72, 168)


@query(
    "temporal_features",
    "X-01",
    sql="""
    SELECT region, timestamp, load_mw, hour(timestamp) AS hour, isodow(timestamp) - 1 AS day_of_week,
           month(timestamp) AS month, (isodow(timestamp) >= 6)::BIGINT AS is_weekend, 0::BIGINT AS is_holiday FROM v_load""",
)
def _(i):
    return features.temporal(i.load)


# --- load --------------------------------------------------------------------------------------


def _both(columns, part, first):
    """Each column filled in one direction, then the other."""
    up = f"OVER ({part} ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    down = f"OVER ({part} ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

    def one(c):
        forward, backward = f"last_value({c} IGNORE NULLS) {up}", f"first_value({c} IGNORE NULLS) {down}"
        a, b = (backward, forward) if first == "backward" else (forward, backward)
        return f"coalesce({a}, {b}) AS {c}"

    return ", ".join(one(c) for c in columns)


def _load_sql(source, keys):
    head = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    daily = f"PARTITION BY {head}date_trunc('day', timestamp)"
    made = ["load_mw", "load_rate_of_change", "load_daily_peak", "load_daily_average"]
    return f"""
    SELECT {head}timestamp, {_both(made, part, "backward")} FROM (
      SELECT {head}timestamp, load_mw, (load_mw / lag(load_mw) OVER ({part} ORDER BY timestamp) - 1) * 100 AS load_rate_of_change,
             load_mw / max(load_mw) OVER ({daily}) AS load_daily_peak,
             load_mw / avg(load_mw) OVER ({daily}) AS load_daily_average FROM {source})"""


_LOAD_MADE = "load_rate_of_change load_daily_peak load_daily_average"


@query("load_features", "X-02", sql=_load_sql("v_load", ["region"]), doubles=_LOAD_MADE)
def _(i):
    return features.load_features(i.kept("load"), ["region"], settle)


# --- generation --------------------------------------------------------------------------------

_FUEL_COLUMNS = [f"generation_{f}" for f in FUELS]


def _generation_sql(source, keys):
    head = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    pivot = ", ".join(f"sum(generation_mw) FILTER (fuel_type = '{f}') AS generation_{f}" for f in FUELS)
    total = " + ".join(f"coalesce({c}, 0)" for c in _FUEL_COLUMNS)
    strict = " + ".join(_FUEL_COLUMNS)
    terms = " + ".join(f"CASE WHEN {c} > 0 THEN -({c} / t) * ln({c} / t) ELSE 0 END" for c in _FUEL_COLUMNS)
    positive = " + ".join(f"({c} > 0)::INT" for c in _FUEL_COLUMNS)
    made = [*_FUEL_COLUMNS, "total_generation", "renewable_ratio", "fuel_mix_diversity"]
    filled = _both(made, part, "backward").replace("coalesce(first", "coalesce(first")
    zeroed = ", ".join(f"coalesce({c}, 0) AS {c}" for c in made)
    return f"""
    SELECT {head}timestamp, {zeroed} FROM (SELECT {head}timestamp, {filled} FROM (
      SELECT *, CASE WHEN total_generation <> 0 THEN (coalesce(generation_wind, 0) + coalesce(generation_solar, 0)) / total_generation END AS renewable_ratio,
             CASE WHEN t IS NULL OR t <= 0 OR {positive} <= 1 THEN 0 ELSE ({terms}) / ln(5) END AS fuel_mix_diversity
      FROM (SELECT *, {total} AS total_generation, {strict} AS t
            FROM (SELECT {head}timestamp, {pivot} FROM {source} GROUP BY ALL))))"""


_GEN_MADE = " ".join([*_FUEL_COLUMNS, "total_generation", "renewable_ratio", "fuel_mix_diversity"])


@query("generation_features", "X-03", sql=_generation_sql("v_generation", ["region"]), doubles=_GEN_MADE)
def _(i):
    return features.generation_features(i.generation, FUELS, ["region"], settle)


# --- prices ------------------------------------------------------------------------------------


def _price_sql(source):
    columns = [f"price_{p}" for p in PRODUCTS]
    pivot = ", ".join(f"avg(price) FILTER (product = '{p}') AS price_{p}" for p in PRODUCTS)
    day = "(ORDER BY timestamp RANGE BETWEEN INTERVAL '23:59:59.999999' PRECEDING AND CURRENT ROW)"
    week = "(ORDER BY timestamp RANGE BETWEEN INTERVAL '167:59:59.999999' PRECEDING AND CURRENT ROW)"
    rolled = ", ".join(
        f"stddev_samp({c}) OVER d AS {c}_volatility_24h, avg({c}) OVER d AS {c}_ma_24h, avg({c}) OVER k AS {c}_ma_7d"
        for c in columns
    )
    made = columns + [f"{c}_{s}" for c in columns for s in ("volatility_24h", "ma_24h", "ma_7d")] + ["price_spread_DA_RT"]
    return f"""
    SELECT timestamp, {_both(made, "", "backward")} FROM (
      SELECT *, {rolled}, price_DALMP - price_RTLMP AS price_spread_DA_RT
      FROM (SELECT timestamp, {pivot} FROM {source} GROUP BY ALL) WINDOW d AS {day}, k AS {week})""", made


_PRICE_SQL, _PRICE_MADE = _price_sql("v_ticks")


def _all_rounded(sql, made, digits=6):
    cells = ", ".join(f"round({c}, {digits}) AS {c}" for c in made)
    return f"SELECT * REPLACE ({cells}) FROM ({sql})"


@query("price_features", "X-04", sql=_all_rounded(_PRICE_SQL, _PRICE_MADE))
def _(i):
    return features.price_features(i.ticks.select("timestamp", "product", "price"), PRODUCTS, settle=settle)


BASE_SQL = f"""
    SELECT timestamp, load_mw, {_LOAD_MADE.replace(" ", ", ")}, hour(timestamp) AS hour,
           isodow(timestamp) - 1 AS day_of_week, month(timestamp) AS month, (isodow(timestamp) >= 6)::BIGINT AS is_weekend,
           0::BIGINT AS is_holiday, {_GEN_MADE.replace(" ", ", ")}, {", ".join(_PRICE_MADE)}
    FROM ({_load_sql("v_system_load", [])}) FULL JOIN ({_generation_sql("v_system_generation", [])}) USING (timestamp)
    FULL JOIN ({_PRICE_SQL}) USING (timestamp)"""
_BASE_DOUBLES = [*_LOAD_MADE.split(), *_GEN_MADE.split(), *_PRICE_MADE]


def base_table(i):
    prices = i.ticks.select("timestamp", "product", "price")
    return features.base_features(i.kept("system_load"), prices, i.system_generation, PRODUCTS, FUELS, settle=settle)


@query("base_features", "X-05", sql=_all_rounded(BASE_SQL, _BASE_DOUBLES))
def _(i):
    return base_table(i)


# --- derived -----------------------------------------------------------------------------------

_WIDE = f"""
    SELECT l.timestamp, l.load_mw, {", ".join(f"coalesce(generation_{f}, 0) AS generation_{f}" for f in FUELS)},
           total_generation, {", ".join(f"price_{p}" for p in PRODUCTS)}, hour(l.timestamp) AS hour,
           isodow(l.timestamp) - 1 AS day_of_week, (isodow(l.timestamp) >= 6)::INT AS is_weekend
    FROM v_system_load l
    JOIN (SELECT timestamp, sum(generation_mw) AS total_generation,
            {", ".join(f"sum(generation_mw) FILTER (fuel_type = '{f}') AS generation_{f}" for f in FUELS)}
          FROM v_system_generation GROUP BY timestamp) g ON g.timestamp = l.timestamp
    JOIN (SELECT timestamp, {", ".join(f"avg(price) FILTER (product = '{p}') AS price_{p}" for p in PRODUCTS)}
          FROM v_hourly GROUP BY timestamp) p ON p.timestamp = l.timestamp"""


def wide_table(i):
    """Load, fuels and prices of each hour, without fills."""
    from pricecast.operators import reshape

    generation = reshape.pivot_generation(i.system_generation, FUELS).withColumn(
        "total_generation", sum((F.col(f"generation_{f}") for f in FUELS), F.lit(0.0))
    )
    prices = reshape.pivot_prices(i.hourly, PRODUCTS)
    wide = i.system_load.join(generation, "timestamp").join(prices, "timestamp")
    return features.temporal(wide).drop("month", "is_holiday")


@query(
    "load_generation_ratio",
    "X-06",
    sql=f"""
    SELECT timestamp, round(least(load_mw / CASE WHEN generation_wind > 0.9 THEN generation_wind ELSE 0.9::DOUBLE END, 10), 6)
      AS load_generation_ratio FROM ({_WIDE})""",
)
def _(i):
    ratio = features.load_generation_ratio("load_mw", "generation_wind")
    return wide_table(i).select("timestamp", ratio.alias("load_generation_ratio"))


@query(
    "price_spreads",
    "X-07",
    sql=f"""
    SELECT timestamp, round(price_DALMP - price_RTLMP, 6) AS spread_dalmp_rtlmp, round(price_DALMP - price_RegUp, 6) AS spread_dalmp_regup,
           round(price_DALMP - price_RegDown, 6) AS spread_dalmp_regdown, round(price_DALMP - price_RRS, 6) AS spread_dalmp_rrs,
           round(price_RegUp - price_RegDown, 6) AS spread_regup_regdown FROM ({_WIDE})""",
)
def _(i):
    wide = wide_table(i)
    return wide.select("timestamp", *[c.alias(n) for n, c in features.spread_columns(wide.columns).items()])


_VOLATILE = [f"price_{p}" for p in PRODUCTS]


def _volatility_sql(source, columns, windows, digits=6):
    names = [(c, w) for c in columns for w in windows]
    rolled = ", ".join(
        f"stddev_samp({c}) OVER (ORDER BY timestamp ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS raw_{c}_{w}"
        for c, w in names
    )
    forward = ", ".join(
        f"last_value(raw_{c}_{w} IGNORE NULLS) OVER (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f_{c}_{w}"
        for c, w in names
    )
    final = ", ".join(
        f"CASE WHEN count(*) OVER () >= {w} THEN coalesce(f_{c}_{w}, avg(f_{c}_{w}) OVER ()) END AS volatility_{c}_{w}h"
        for c, w in names
    )
    return f"SELECT *, {final} FROM (SELECT *, {forward} FROM (SELECT *, {rolled} FROM ({source})))"


_VOL_NAMES = [f"volatility_{c}_{w}h" for c in _VOLATILE for w in config.VOLATILITY_ROWS]


@query(
    "price_volatility",
    "X-08",
    sql=f"SELECT timestamp, {', '.join(f'round({n}, 6) AS {n}' for n in _VOL_NAMES)} FROM ({_volatility_sql(_WIDE, _VOLATILE, config.VOLATILITY_ROWS)})",
)
def _(i):
    made = features.volatility(settle(wide_table(i)), [], _VOLATILE, settle=settle)
    return made.select("timestamp", *_VOL_NAMES)


_GREEN = {
    "total_renewable": "generation_wind + generation_solar",
    "renewable_ratio": "least((generation_wind + generation_solar) / CASE WHEN total_generation > 0.9 THEN total_generation ELSE 0.9::DOUBLE END, 1)",
    "renewable_to_load": "least((generation_wind + generation_solar) / CASE WHEN load_mw > 0.9 THEN load_mw ELSE 0.9::DOUBLE END, 1.5::DOUBLE)",
    "solar_hour_impact": "generation_solar * sin(pi() * hour / 12)",
    "wind_hour_impact": "generation_wind * (1 - cos(pi() * hour / 12))",
}


@query(
    "renewable_impact",
    "X-09",
    sql=f"SELECT timestamp, {', '.join(f'round({e}, 6) + 0 AS {n}' for n, e in _GREEN.items())} FROM ({_WIDE})",
)
def _(i):
    wide = wide_table(i)
    return wide.select("timestamp", *[c.alias(n) for n, c in features.renewable_columns(wide.columns).items()])


_CROSSED = ["load_mw", "total_generation", *[f"price_{p}" for p in PRODUCTS]]


def _crossed_sql(columns):
    made = {}
    for c in columns:
        made[f"hour_x_{c}"] = f"hour * {c}"
        made[f"hour_sin_x_{c}"] = f"sin(2 * pi() * hour / 24) * {c}"
        made[f"hour_cos_x_{c}"] = f"cos(2 * pi() * hour / 24) * {c}"
        made[f"weekend_x_{c}"] = f"is_weekend * {c}"
        made[f"day_of_week_x_{c}"] = f"day_of_week * {c}"
    return made


@query(
    "temporal_interactions",
    "X-10",
    sql=f"SELECT timestamp, {', '.join(f'round({e}, 6) AS {n}' for n, e in _crossed_sql(_CROSSED).items())} FROM ({_WIDE})",
)
def _(i):
    wide = wide_table(i)
    made = features.interaction_columns(wide.columns, _CROSSED)
    return wide.select("timestamp", *[c.alias(n) for n, c in made.items()])


_DERIVED = {
    "load_generation_ratio": "least(load_mw / CASE WHEN total_generation > 0.9 THEN total_generation ELSE 0.9::DOUBLE END, 10)",
    "spread_dalmp_rtlmp": "price_DALMP - price_RTLMP",
    "spread_regup_regdown": "price_RegUp - price_RegDown",
    **_GREEN,
    **_crossed_sql(["load_mw", "price_DALMP"]),
    "volatility_price_DALMP_24h": "volatility_price_DALMP_24h",
    "volatility_price_RRS_168h": "volatility_price_RRS_168h",
}


@query(
    "derived_features",
    "X-11",
    sql=f"SELECT timestamp, {', '.join(f'round({e}, 6) AS {n}' for n, e in _DERIVED.items())} FROM ({_volatility_sql(_WIDE, _VOLATILE, config.VOLATILITY_ROWS)})",
)
def _(i):
    made = features.derived_features(wide_table(i), settle=settle)
    return made.select("timestamp", *_DERIVED)


# --- lags and selections -----------------------------------------------------------------------


@query(
    "load_lags",
    "X-12",
    sql=f"""
    SELECT region, timestamp, load_mw, {", ".join(f"lag(load_mw, {k}) OVER w AS load_mw_lag_{k}" for k in _LAGS)}
    FROM v_load WINDOW w AS (PARTITION BY region ORDER BY timestamp)""",
)
def _(i):
    return features.lags(i.kept("load"), ["load_mw"], keys=["region"], settle=settle)


@query(
    "supplier_daily_lags",
    "X-12",
    sql="""
    SELECT l_suppkey, timestamp, value, lag(value, 1) OVER w AS value_lag_1, lag(value, 7) OVER w AS value_lag_7,
           lag(value, 28) OVER w AS value_lag_28
    FROM (SELECT l_suppkey, l_shipdate AS timestamp, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY ALL)
    WINDOW w AS (PARTITION BY l_suppkey ORDER BY timestamp)""",
)
def _(i):
    return features.lags(settle(supplier_days(i)), ["value"], (1, 7, 28), ["l_suppkey"], step_seconds=DAY)


def supplier_days(i):
    """Daily totals per supplier: the largest set of series in the tables."""
    return i.table("lineitem").groupBy("l_suppkey", F.col("l_shipdate").alias("timestamp")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("value")
    )


@query(
    "supplier_rolling_week",
    "X-13",
    sql="""
    SELECT l_suppkey, timestamp, value, round(avg(value) OVER w, 4) AS mean_7d, max(value) OVER w AS max_7d
    FROM (SELECT l_suppkey, l_shipdate AS timestamp, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY ALL)
    WINDOW w AS (PARTITION BY l_suppkey ORDER BY timestamp RANGE BETWEEN INTERVAL '167:59:59.999999' PRECEDING AND CURRENT ROW)""",
)
def _(i):
    rolled = {"mean_7d": (7 * DAY, lambda: F.avg("value")), "max_7d": (7 * DAY, lambda: F.max("value"))}
    return rounded(trailing(supplier_days(i), ["l_suppkey"], "timestamp", rolled), "mean_7d")


@query(
    "pair_interactions",
    "X-14",
    sql=f"""
    SELECT timestamp, round(load_mw * hour, 6) AS load_mw_x_hour, round(load_mw * is_weekend, 6) AS load_mw_x_is_weekend
    FROM ({_WIDE})""",
)
def _(i):
    wide = wide_table(i)
    return wide.select("timestamp", *[c.alias(n) for n, c in features.pair_columns(wide.columns).items()])


@query(
    "features_of_product_hour",
    "X-15",
    sql=f"""
    SELECT timestamp, load_mw, hour, day_of_week, is_weekend, round(generation_wind, 6) AS wind_generation,
           round(generation_solar, 6) AS solar_generation FROM ({_WIDE}) WHERE hour = 12""",
)
def _(i):
    wide = wide_table(i).withColumnsRenamed(
        {"generation_wind": "wind_generation", "generation_solar": "solar_generation"}
    )
    return features.select_features(wide, "RTLMP", 12)


@query(
    "hour_categories",
    "X-16",
    sql="""
    SELECT event_id, concat_ws(',', CASE WHEN h BETWEEN 7 AND 22 THEN 'peak_hours' END,
      CASE WHEN h <= 6 OR h = 23 THEN 'off_peak_hours' END, CASE WHEN h BETWEEN 8 AND 17 THEN 'solar_hours' END,
      CASE WHEN h BETWEEN 16 AND 20 THEN 'evening_ramp' END) AS categories
    FROM (SELECT event_id, hour(timestamp) AS h FROM v_ticks)""",
)
def _(i):
    found = F.concat_ws(",", features.hour_categories(F.hour("timestamp")))
    return i.ticks.select("event_id", found.alias("categories"))


@query(
    "product_hour_vectors",
    "X-17",
    sql=f"""
    SELECT timestamp, p.product, hour,
           CASE WHEN hour BETWEEN 8 AND 17 OR p.product = 'RTLMP' THEN 5 ELSE 4 END + 1 AS feature_count,
           round(load_mw + hour + day_of_week + is_weekend + lag_24
             + CASE WHEN hour BETWEEN 8 AND 17 OR p.product = 'RTLMP' THEN solar ELSE 0 END, 4) AS feature_total
    FROM (SELECT *, generation_solar AS solar, lag(load_mw, 24) OVER (ORDER BY timestamp) AS lag_24 FROM ({_WIDE})),
      (SELECT unnest(['DALMP', 'RTLMP', 'RegUp', 'RegDown', 'RRS', 'NSRS']) AS product) p""",
)
def _(i):
    wide = settle(wide_table(i).withColumnRenamed("generation_solar", "solar_generation"))
    lagged = features.lags(wide, ["load_mw"], [24])
    vectors = features.product_hour_vectors(lagged, extra=["load_mw_lag_24"])
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return vectors.select(
        "timestamp",
        "product",
        "hour",
        F.size("features").alias("feature_count"),
        F.round(total, 4).alias("feature_total"),
    )


# --- scalers -----------------------------------------------------------------------------------

_SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


def _scalers_sql(method, keys=("l_returnflag",), columns=_SCALED, source="lineitem"):
    head = "".join(f"{k}, " for k in keys)
    center, scale = {
        "standard": ("avg({c})", "stddev_pop({c})"),
        "minmax": ("min({c})", "max({c}) - min({c})"),
        "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
        "none": ("0::DOUBLE", "1::DOUBLE"),
    }[method]
    parts = [
        f"""SELECT {head}'{c}' AS "column", {center.format(c=c)} AS center,
        CASE WHEN {scale.format(c=c)} = 0 THEN 1 ELSE {scale.format(c=c)} END AS scale, avg({c}) AS mean,
        stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max FROM {source} {"GROUP BY " + ", ".join(keys) if keys else ""}"""
        for c in columns
    ]
    return " UNION ALL ".join(parts)


def _fit(i, method, keys=("l_returnflag",)):
    return scaling.fit(i.table("lineitem"), _SCALED, method, list(keys), "v1", settle)


for _method in scaling.METHODS:

    @query(
        f"scalers_{_method}",
        "X-19",
        sql=f"""
        SELECT 'v1' AS normalizer_id, l_returnflag, "column", '{_method}' AS method, round(center, 5) AS center,
               round(scale, 5) AS scale, round(mean, 5) AS mean, round(std, 5) AS std, min, max
        FROM ({_scalers_sql(_method)})""",
    )
    def _(i, method=_method):
        return rounded(_fit(i, method), "center", "scale", "mean", "std", digits=5)


_SCALED_SQL = """
    SELECT l_orderkey, l_linenumber, l_returnflag, round((l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w, 6) + 0 AS l_quantity,
           round((l_extendedprice - avg(l_extendedprice) OVER w) / stddev_pop(l_extendedprice) OVER w, 6) + 0 AS l_extendedprice
    FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)"""


@query("rows_scaled", "X-20", sql=_SCALED_SQL)
def _(i):
    rows = i.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    return scaling.apply(rows, settle(_fit(i, "standard")), ["l_quantity", "l_extendedprice"], ["l_returnflag"])


@query(
    "rows_unscaled",
    "X-21",
    sql="SELECT l_orderkey, l_linenumber, l_returnflag, round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice FROM lineitem",
)
def _(i):
    columns = ["l_quantity", "l_extendedprice"]
    rows = i.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *columns)
    scalers = settle(_fit(i, "standard"))
    scaled = scaling.apply(rows, scalers, columns, ["l_returnflag"])
    return rounded(scaling.invert(scaled, scalers, columns, ["l_returnflag"]), *columns)


@query(
    "scalers_saved",
    "X-22",
    sql=f"""SELECT l_returnflag, "column", round(center, 5) AS center, round(scale, 5) AS scale FROM ({_scalers_sql("minmax")})""",
)
def _(i):
    path = new_folder(i.spark, "scalers")
    scaling.save(_fit(i, "standard").withColumn("normalizer_id", F.lit("other")), path)
    scaling.save(_fit(i, "minmax"), path)
    loaded = scaling.load(i.spark, path, "v1").select("l_returnflag", "column", "center", "scale")
    return rounded(loaded, "center", "scale", digits=5)


@query(
    "feature_report",
    "X-23",
    sql=f"""SELECT "column", round(mean, 5) AS mean, round(std, 5) AS std, min, max FROM ({_scalers_sql("standard", ())})""",
)
def _(i):
    return rounded(scaling.feature_report(i.table("lineitem"), _SCALED), "mean", "std", digits=5)


@query(
    "features_scaled_end_to_end",
    "X-18",
    sql=f"""
    SELECT timestamp, hour, round((load_mw - avg(load_mw) OVER ()) / stddev_pop(load_mw) OVER (), 6) + 0 AS load_mw,
           round((hour_x_load_mw - avg(hour_x_load_mw) OVER ()) / stddev_pop(hour_x_load_mw) OVER (), 6) + 0 AS hour_x_load_mw,
           round((renewable_to_load - avg(renewable_to_load) OVER ()) / stddev_pop(renewable_to_load) OVER (), 6) + 0 AS renewable_to_load
    FROM (SELECT timestamp, hour, load_mw, hour * load_mw AS hour_x_load_mw, {_GREEN["renewable_to_load"]} AS renewable_to_load FROM ({_WIDE}))""",
)
def _(i):
    columns = ["load_mw", "hour_x_load_mw", "renewable_to_load"]
    made = features.derived_features(wide_table(i), settle=settle).select("timestamp", "hour", *columns)
    made = settle(made)
    return scaling.apply(made, scaling.fit(made, columns), columns)


_ALL_DERIVED = {
    "load_mw": "load_mw",
    **_DERIVED,
    "spread_dalmp_regup": "price_DALMP - price_RegUp",
    "spread_dalmp_regdown": "price_DALMP - price_RegDown",
    "spread_dalmp_rrs": "price_DALMP - price_RRS",
    **_crossed_sql(_CROSSED),
    **{n: n for n in _VOL_NAMES},
}


def _standard_sql(c):
    return f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () <= 1e-12 * greatest(abs(min({c}) OVER ()), abs(max({c}) OVER ())) THEN 1 ELSE stddev_pop({c}) OVER () END, 6) + 0 AS {c}"


@query(
    "features_scaled_whole",
    "X-18",
    sql=f"""
    SELECT timestamp, hour, {", ".join(_standard_sql(c) for c in _ALL_DERIVED)}
    FROM (SELECT timestamp, hour, {", ".join(f"{e} AS {n}" for n, e in _ALL_DERIVED.items())}
          FROM ({_volatility_sql(_WIDE, _VOLATILE, config.VOLATILITY_ROWS)}))""",
)
def _(i):
    wide = wide_table(i)
    made = features.derived_features(wide, settle=settle)
    columns = ["load_mw", *[c for c in made.columns if c not in wide.columns]]
    made = settle(made.select("timestamp", "hour", *columns))
    return scaling.apply(made, scaling.fit(made, columns), columns)
