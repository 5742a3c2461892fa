"""Linear models, uncertainty and samples."""

from statistics import NormalDist

from pyspark.sql import functions as F

from pricecast import config
from pricecast.config import RunSettings
from pricecast.functions import gauss
from pricecast.operators import models, sampling, uncertainty
from pricecast.plans import daily
from pricecast.plans.catalog.features import BASE_SQL
from pricecast.plans.inputs import FUELS, PRODUCTS
from pricecast.plans.registry import query, rounded
from pricecast.sources.scratch import new_folder, settle

_FEATURES = ["l_quantity", "l_discount"]
_GROUPS = ["l_returnflag", "l_linestatus"]


def _trained(i, features=tuple(_FEATURES), groups=tuple(_GROUPS)):
    return models.train(i.table("lineitem"), list(features), "l_extendedprice", list(groups))


# Two features have a closed solution in the covariances.
_FIT = """
    SELECT {groups}, n, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1,
           (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2, my, m1, m2, cyy, c1y, c2y
    FROM (SELECT {groups}, count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my,
            covar_pop({x1}, {x1}) AS c11, covar_pop({x2}, {x2}) AS c22, covar_pop({x1}, {x2}) AS c12,
            covar_pop({x1}, {y}) AS c1y, covar_pop({x2}, {y}) AS c2y, covar_pop({y}, {y}) AS cyy
          FROM {source} GROUP BY {groups})"""
_LINE_FIT = _FIT.format(
    groups="l_returnflag, l_linestatus", x1="l_quantity", x2="l_discount", y="l_extendedprice", source="lineitem"
)


@query(
    "models_two_features",
    "M-01",
    sql=f"""
    SELECT l_returnflag, l_linestatus, n AS row_count, round(b1, 3) AS b1, round(b2, 3) AS b2,
           round(my - b1 * m1 - b2 * m2, 3) AS intercept, round(sqrt(cyy - b1 * c1y - b2 * c2y), 3) AS rmse,
           round((b1 * c1y + b2 * c2y) / cyy, 6) AS r2 FROM ({_LINE_FIT})""",
)
def _(i):
    fitted = _trained(i)
    return fitted.select(
        *_GROUPS,
        "row_count",
        F.round(F.col("coefficients")[0], 3).alias("b1"),
        F.round(F.col("coefficients")[1], 3).alias("b2"),
        F.round("intercept", 3).alias("intercept"),
        F.round(F.col("metrics")["rmse"], 3).alias("rmse"),
        F.col("metrics")["r2"].alias("r2"),
    )


@query(
    "models_one_feature",
    "M-01",
    sql="""
    SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 3) AS coefficient,
           round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
           round(sqrt((regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2)
             / regr_sxx(l_extendedprice, l_quantity)) / count(*)), 3) AS rmse
    FROM lineitem GROUP BY l_suppkey""",
)
def _(i):
    fitted = models.train_single(i.table("lineitem"), "l_quantity", "l_extendedprice", ["l_suppkey"])
    return rounded(fitted, "coefficient", "intercept", "rmse", digits=3)


_MANY = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _elimination_sql(features, target, group, source):
    """Gaussian elimination on the covariances, a step per feature, then the unknowns from the last to the first."""
    columns, k = [*features, target], len(features)
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    first = ", ".join(f"covar_pop({columns[i]}, {columns[j]}) AS a{i}_{j}" for i, j in cells)
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(columns))
    steps = [f"s0 AS (SELECT {group}, {means}, {first} FROM {source} GROUP BY {group})"]
    for p in range(k):
        changed = ", ".join(f"a{i}_{j} - a{p}_{i} * a{p}_{j} / a{p}_{p} AS a{i}_{j}" for i, j in cells if i > p)
        steps.append(f"s{p + 1} AS (SELECT * REPLACE ({changed}) FROM s{p})")
    for n, i in enumerate(reversed(range(k))):
        known = "".join(f" - a{i}_{j} * b{j}" for j in range(i + 1, k))
        steps.append(f"t{n} AS (SELECT *, (a{i}_{k}{known}) / a{i}_{i} AS b{i} FROM {f't{n - 1}' if n else f's{k}'})")
    intercept = f"m{k}" + "".join(f" - b{i} * m{i}" for i in range(k))
    rows = " UNION ALL ".join(
        f"SELECT {group}, '{f}' AS feature, round(b{i}, 3) + 0 AS coefficient, round(abs(b{i}), 3) AS importance, round({intercept}, 3) + 0 AS intercept FROM t{k - 1}"
        for i, f in enumerate(features)
    )
    return f"WITH {', '.join(steps)} {rows}"


@query("models_many_features", "M-01", "M-03", sql=_elimination_sql(_MANY, "l_extendedprice", "l_suppkey", "lineitem"))
def _(i):
    fitted = _trained(i, _MANY, ["l_suppkey"])
    return rounded(models.coefficient_report(fitted, ["l_suppkey"]), "coefficient", "importance", "intercept", digits=3)


@query(
    "predictions",
    "M-02",
    "J-10",
    sql=f"""
    SELECT l_orderkey, l_linenumber, round(my + b1 * (l_quantity - m1) + b2 * (l_discount - m2), 3) AS point_forecast
    FROM lineitem JOIN ({_LINE_FIT}) USING (l_returnflag, l_linestatus)""",
)
def _(i):
    scored = models.predict(i.table("lineitem"), settle(_trained(i)), _FEATURES, _GROUPS)
    return rounded(scored.select("l_orderkey", "l_linenumber", "point_forecast"), "point_forecast", digits=3)


@query(
    "coefficient_report",
    "M-03",
    sql=f"""
    SELECT l_returnflag, l_linestatus, feature, round(b, 3) AS coefficient, round(abs(b), 3) AS importance,
           round(my - b1 * m1 - b2 * m2, 3) AS intercept
    FROM (SELECT *, unnest(['l_quantity', 'l_discount']) AS feature, unnest([b1, b2]) AS b FROM ({_LINE_FIT}))""",
)
def _(i):
    report = models.coefficient_report(_trained(i), _GROUPS)
    return rounded(report, "coefficient", "importance", "intercept", digits=3)


_SPLIT_FIT = _FIT.format(
    groups="l_returnflag",
    x1="l_quantity",
    x2="l_discount",
    y="l_extendedprice",
    source="(SELECT * FROM lineitem WHERE l_orderkey % 4 <> 0)",
)


@query(
    "models_evaluated",
    "M-04",
    sql=f"""
    SELECT l_returnflag, round(sqrt(avg(power(y - f, 2))), 3) AS rmse, round(1 - sum(power(y - f, 2)) / (var_pop(y) * count(*)), 6) AS r2
    FROM (SELECT l_returnflag, l_extendedprice AS y, my + b1 * (l_quantity - m1) + b2 * (l_discount - m2) AS f
          FROM (SELECT * FROM lineitem WHERE l_orderkey % 4 = 0) JOIN ({_SPLIT_FIT}) USING (l_returnflag))
    GROUP BY l_returnflag""",
)
def _(i):
    # Every row is used: three quarters of the orders to learn, one quarter to test.
    rows = i.table("lineitem")
    learned = rows.where("l_orderkey % 4 <> 0")
    fitted = settle(models.train(learned, _FEATURES, "l_extendedprice", ["l_returnflag"]))
    held = rows.where("l_orderkey % 4 = 0")
    scored = models.evaluate(held, fitted, _FEATURES, "l_extendedprice", ["l_returnflag"])
    return rounded(scored, "rmse", digits=3)


# --- the model table ---------------------------------------------------------------------------


def _history(i):
    """Model entries over time: one per product, hour and day, with the day's mean as coefficient."""
    return i.kept("hourly").select(
        "product",
        F.hour("timestamp").alias("hour"),
        F.array(F.lit("hour")).alias("feature_names"),
        F.array("price").alias("coefficients"),
        F.lit(0.0).alias("intercept"),
        F.create_map(F.lit("rmse"), F.col("price") / 10).alias("metrics"),
        F.col("timestamp").alias("created_at"),
    )


@query(
    "models_latest",
    "M-05",
    sql="""
    SELECT product, hour(timestamp) AS hour, 1::BIGINT AS feature_count, round(price / 10, 6) AS rmse, timestamp AS created_at
    FROM v_hourly QUALIFY row_number() OVER (PARTITION BY product, hour(timestamp) ORDER BY timestamp DESC) = 1""",
)
def _(i):
    entries = models.info(models.latest(_history(i)))
    return entries.select(
        "product", "hour", "feature_count", F.col("metrics")["rmse"].alias("rmse"), "created_at"
    )


@query(
    "models_registered",
    "M-05",
    sql="""
    SELECT product, hour, max(t) AS created_at FROM (
      SELECT product, hour(timestamp) AS hour, max(timestamp) FILTER (timestamp < TIMESTAMP '2024-01-16') AS a,
             max(timestamp) FILTER (timestamp >= TIMESTAMP '2024-01-16' AND product <> 'RRS') AS b,
             coalesce(b, a) AS t FROM v_hourly GROUP BY product, hour(timestamp))
    WHERE t IS NOT NULL AND hour <> 5 GROUP BY product, hour""",
)
def _(i):
    history = _history(i)
    middle = F.lit("2024-01-16").cast("timestamp")
    old = models.latest(history.where(F.col("created_at") < middle))
    new = models.latest(history.where((F.col("created_at") >= middle) & (F.col("product") != "RRS")))
    kept = models.delete(models.register(old, new), old.where("hour = 5"))
    return kept.select("product", "hour", "created_at")


@query(
    "models_available",
    "M-05",
    sql="""
    SELECT w.product, w.hour, m.product IS NOT NULL AS available
    FROM (SELECT DISTINCT product, hour(timestamp) AS hour FROM v_sampled) w
    LEFT JOIN (SELECT DISTINCT product, hour(timestamp) AS hour FROM v_hourly) m USING (product, hour)""",
)
def _(i):
    wanted = i.sampled.select("product", F.hour("timestamp").alias("hour")).distinct()
    return models.has(wanted, _history(i))


@query(
    "models_saved",
    "M-06",
    sql="""
    SELECT l_returnflag, l_linestatus, 2::BIGINT AS feature_count FROM lineitem GROUP BY ALL""",
)
def _(i):
    path = new_folder(i.spark, "models")
    models.save(_trained(i), path)
    return models.info(models.load(i.spark, path), _GROUPS).select(*_GROUPS, "feature_count")


# --- residuals and uncertainty -----------------------------------------------------------------

_RESIDUALS = """
    SELECT product, hour(timestamp) AS hour, timestamp, actual - forecast AS residual,
           (actual - forecast) / nullif(forecast, 0) AS pct_error FROM v_pairs"""
_SUMMARY = f"""
    SELECT * FROM (SELECT product, hour, avg(residual) AS res_mean, stddev_pop(residual) AS res_std,
        avg(pct_error) AS pct_mean, stddev_pop(pct_error) AS pct_std, count(residual) AS errors
      FROM ({_RESIDUALS}) GROUP BY product, hour)
    LEFT JOIN (SELECT product, hour, avg(abs(residual)) FILTER (r <= 3) AS recent_abs,
        avg(abs(residual)) FILTER (r > 3 AND r <= 6) AS older_abs
      FROM (SELECT *, row_number() OVER (PARTITION BY product, hour ORDER BY timestamp DESC) AS r FROM ({_RESIDUALS}))
      GROUP BY product, hour) USING (product, hour)"""


def _summary(i):
    return settle(models.residual_summary(settle(models.residuals(i.pairs))))


@query("residual_history", "M-07", sql=_RESIDUALS, doubles="residual pct_error")
def _(i):
    return models.residuals(i.pairs)


@query(
    "residual_summary",
    "M-07",
    sql=_SUMMARY,
    doubles="res_mean res_std pct_mean pct_std recent_abs older_abs",
)
def _(i):
    return _summary(i)


# Point forecasts: the price of each hour; products without history get the defaults.
_POINTS = """
    SELECT product, timestamp, hour(timestamp) AS hour, point_forecast FROM v_shown
    UNION ALL SELECT product, timestamp, hour(timestamp), point_forecast FROM v_sampled"""
_FACTOR = """CASE product WHEN 'RTLMP' THEN 1.2 WHEN 'RegUp' THEN 0.8 WHEN 'RegDown' THEN 0.8 WHEN 'RRS' THEN 0.7
    WHEN 'NSRS' THEN 0.7 ELSE 1.0 END::DOUBLE"""
_FIXED = """CASE product WHEN 'DALMP' THEN 5 WHEN 'RTLMP' THEN 8 WHEN 'RegUp' THEN 3 WHEN 'RegDown' THEN 3
    WHEN 'RRS' THEN 2.5 WHEN 'NSRS' THEN 2 ELSE 5 END::DOUBLE"""
_RES_STD = """CASE WHEN res_std IS NULL THEN abs(point_forecast) * 0.1::DOUBLE
    ELSE greatest(res_std, abs(point_forecast) * 0.05::DOUBLE) END"""
_TREND = """CASE WHEN errors < 3 OR older_abs IS NULL THEN 0
    ELSE greatest(0, (recent_abs - older_abs) / greatest(older_abs, 1)) END"""
_SPREADS = {
    "residuals": ("point_forecast + coalesce(res_mean, 0)", _RES_STD),
    "percentage": (
        "point_forecast * (1 + coalesce(pct_mean, 0))",
        """abs(point_forecast) * CASE WHEN pct_std IS NULL THEN 0.1::DOUBLE ELSE greatest(pct_std, 0.05::DOUBLE) END""",
    ),
    "fixed": ("point_forecast", _FIXED),
    "adaptive": (
        "point_forecast + coalesce(res_mean, 0)",
        f"CASE WHEN recent_abs IS NULL THEN {_RES_STD} ELSE {_RES_STD} * (1 + {_TREND}) END",
    ),
}


def _points(i):
    hour = F.hour("timestamp").alias("hour")
    both = [x.select("product", "timestamp", hour, "point_forecast") for x in (i.shown, i.sampled)]
    return both[0].unionByName(both[1])


def _spread_sql(method):
    mean, std = _SPREADS[method]
    return f"""
    SELECT p.product, timestamp, point_forecast, {mean} AS mean, ({std}) * {_FACTOR} AS std
    FROM ({_POINTS}) p LEFT JOIN ({_SUMMARY}) s ON s.product = p.product AND s.hour = p.hour""".replace(
        "CASE product", "CASE p.product"
    )


for _method, _row in {"residuals": "U-01", "percentage": "U-02", "fixed": "U-03", "adaptive": "U-04"}.items():

    @query(f"spread_by_{_method}", _row, "U-05", sql=_spread_sql(_method), doubles="point_forecast mean std")
    def _(i, method=_method):
        return uncertainty.estimate(_points(i), _summary(i), default=method).drop("hour")


_CHOSEN = {"DALMP": "percentage", "RRS": "fixed", "RegUp": "no such method"}


@query(
    "spread_by_product_choice",
    "U-06",
    "Y-03",
    sql=f"""
    SELECT p.product, timestamp, point_forecast, CASE p.product WHEN 'DALMP' THEN {_SPREADS["percentage"][0]}
        WHEN 'RRS' THEN {_SPREADS["fixed"][0]} ELSE {_SPREADS["residuals"][0]} END AS mean,
      CASE p.product WHEN 'DALMP' THEN {_SPREADS["percentage"][1]} WHEN 'RRS' THEN 2.5::DOUBLE
        ELSE {_SPREADS["residuals"][1]} END * {_FACTOR.replace("CASE product", "CASE p.product")} AS std
    FROM ({_POINTS}) p LEFT JOIN ({_SUMMARY}) s ON s.product = p.product AND s.hour = p.hour""",
    doubles="point_forecast mean std",
)
def _(i):
    return uncertainty.estimate(_points(i), _summary(i), _CHOSEN).drop("hour")


@query(
    "spread_by_own_method",
    "Y-02",
    sql=f"""
    SELECT product, timestamp, round(point_forecast, 6) AS point_forecast, round(point_forecast, 6) AS mean,
           round((1 + abs(point_forecast) / 50) * {_FACTOR}, 6) AS std FROM ({_POINTS})""",
)
def _(i):
    own = uncertainty.with_method("linear", lambda p: (p, 1 + F.abs(p) / 50))
    return uncertainty.estimate(_points(i), _summary(i), default="linear", methods=own).drop("hour")


# --- samples -----------------------------------------------------------------------------------

_COUNT = 100
_HASH = "md5('7|' || product || '|' || strftime(timestamp, '%Y-%m-%d %H:%M') || '{extra}|' || i)"


def _unit(digest, start):
    return f"((('0x' || substr({digest}, {start}, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def _z(extra=""):
    h = _HASH.format(extra=extra)
    return f"(sqrt(-2.0::DOUBLE * ln({_unit(h, 1)})) * cos(2.0::DOUBLE * pi() * {_unit(h, 14)}))"


_SHAPE = 2 / 5**0.5
_DRAWS = {
    "normal": f"point_forecast + std * {_z()}",
    "lognormal": f"exp(ln(CASE WHEN point_forecast <= 0 THEN 0.01::DOUBLE ELSE point_forecast END) - ln(1 + 0.1::DOUBLE * 0.1::DOUBLE) / 2 + sqrt(ln(1 + 0.1::DOUBLE * 0.1::DOUBLE)) * {_z()})",
    "skewed_normal": f"point_forecast + std * ({_SHAPE!r}::DOUBLE * abs({_z()}) + {(1 - _SHAPE**2) ** 0.5!r}::DOUBLE * {_z('|b')})",
}


def _held(x, low=None, high=None):
    x = f"CASE WHEN product IN ('RegUp', 'RegDown', 'RRS', 'NSRS') THEN greatest({x}, 0) ELSE {x} END"
    x = x if low is None else f"greatest({x}, {low})"
    return x if high is None else f"least({x}, {high})"


def _draw_sql(expression):
    return f"""
    SELECT product, timestamp, i, round({_held("x")}, 4) AS x FROM (
      SELECT product, timestamp, i, {expression} AS x
      FROM (SELECT product, timestamp, point_forecast, 8::DOUBLE AS std FROM v_shown), (SELECT unnest(range(1, {_COUNT + 1})) AS i))"""


def _drawn(i, **options):
    rows = i.shown.select("product", "timestamp", "point_forecast", F.lit(8.0).alias("std"))
    drawn = sampling.draw(rows, _COUNT, 7, **options)
    return drawn.select("product", "timestamp", F.posexplode("samples").alias("i", "x")).select(
        "product", "timestamp", (F.col("i") + 1).alias("i"), F.round("x", 4).alias("x")
    )


for _name, _row in {"normal": "D-N", "lognormal": "D-L", "skewed_normal": "D-S"}.items():

    @query(f"samples_{_name}", _row, "D-C", sql=_draw_sql(_DRAWS[_name]))
    def _(i, name=_name):
        return _drawn(i, default=name)


def _polynomial(coefficients, x):
    out = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _ratio(of, x):
    return f"{_polynomial(of[0], x)} / {_polynomial(of[1], x)}"


_ENDS = (NormalDist().cdf(-3), NormalDist().cdf(3))


@query(
    "samples_truncated_normal",
    "D-T",
    sql=f"""
    WITH uniform AS (
      SELECT product, timestamp, point_forecast, i, {_ENDS[0]!r}::DOUBLE + {_unit(_HASH.format(extra=""), 1)} * {_ENDS[1] - _ENDS[0]!r}::DOUBLE AS p
      FROM v_shown, (SELECT unnest(range(1, {_COUNT + 1})) AS i)),
    placed AS (SELECT *, p - 0.5::DOUBLE AS q, 0.180625::DOUBLE - (p - 0.5::DOUBLE) * (p - 0.5::DOUBLE) AS c,
                      sqrt(-ln(least(p, 1 - p))) - 1.6::DOUBLE AS t FROM uniform),
    quantiles AS (
      SELECT *, CASE WHEN abs(q) <= 0.425::DOUBLE THEN q * {_ratio(gauss.CENTRE, "c")} ELSE sign(q) * {_ratio(gauss.TAIL, "t")} END AS z
      FROM placed)
    SELECT product, timestamp, i, round({_held("x")}, 4) AS x FROM (
      SELECT product, timestamp, i, point_forecast + 8 * greatest(least(z, 3), -3) AS x FROM quantiles)""",
)
def _(i):
    return _drawn(i, default="truncated_normal")


@query(
    "samples_bounded",
    "D-C",
    "Y-03",
    sql=f"""
    SELECT product, timestamp, i, round(CASE product WHEN 'DALMP' THEN {_held("x", 10, 90)} WHEN 'RRS' THEN {_held("x", None, 60)} ELSE {_held("x")} END, 4) AS x
    FROM (SELECT product, timestamp, i, CASE product WHEN 'RTLMP' THEN {_DRAWS["lognormal"]} ELSE {_DRAWS["normal"]} END AS x
      FROM (SELECT product, timestamp, point_forecast, 8::DOUBLE AS std FROM v_shown), (SELECT unnest(range(1, {_COUNT + 1})) AS i))""",
)
def _(i):
    bounds = {"DALMP": (10.0, 90.0), "RRS": (None, 60.0)}
    return _drawn(i, chosen={"RTLMP": "lognormal"}, bounds=bounds)


@query(
    "samples_own_distribution",
    "Y-01",
    sql=_draw_sql(f"point_forecast + std * (2 * {_unit(_HASH.format(extra=''), 1)} - 1)"),
)
def _(i):
    from pricecast.functions import randomness

    def even(point, std, key, seed, count):
        return F.transform(
            randomness.digests(seed, key, count), lambda d: point + std * (2 * randomness.uniform(d) - 1)
        )

    return _drawn(i, default="even", distributions=sampling.with_distribution("even", even))


@query(
    "sampling_inputs_rejected",
    "D-V",
    sql="""
    SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'point not finite' WHEN event_id % 23 = 0 THEN 'std not finite'
      WHEN price <= 5 THEN 'std not positive' WHEN event_id % 29 = 0 THEN 'unknown product' END AS reason
    FROM v_ticks WHERE event_id % 19 = 0 OR event_id % 23 = 0 OR price <= 5 OR event_id % 29 = 0""",
)
def _(i):
    e = F.col("event_id")
    rows = i.ticks.select(
        "event_id",
        F.when(e % 19 == 0, F.lit(float("nan"))).otherwise(F.col("price")).alias("point_forecast"),
        F.when(e % 23 == 0, F.lit(float("inf"))).otherwise(F.col("price") - 5).alias("std"),
        F.when(e % 29 == 0, "Unknown").otherwise(F.col("product")).alias("product"),
    )
    return sampling.split_inputs(rows)[1].select("event_id", "reason")


# --- whole forecasts ---------------------------------------------------------------------------

_SETTINGS = RunSettings(products=PRODUCTS, fuels=FUELS)
_NAMES = ["load_mw", "total_generation"]


def _runs(i):
    """One run at 07:00 of each day that the feeds cover with its horizon."""
    days = i.ticks.select(F.date_trunc("day", "timestamp").alias("day")).distinct()
    last = i.ticks.select(F.max(F.date_trunc("day", "timestamp")).alias("last"))
    return days.withColumn("_last", last.scalar()).where("day <= _last - interval 3 days").select(
        (F.col("day") + F.expr("interval 7 hours")).alias("run_time")
    )


def _feeds(i):
    return daily.Feeds(i.kept("system_load"), i.ticks.select("timestamp", "product", "price"), i.system_generation)


def all_forecasts(i, runs=None):
    table = daily.feature_table(_feeds(i), _SETTINGS)
    trained = settle(daily.train(table, _NAMES, _SETTINGS))
    return daily.forecasts(_runs(i) if runs is None else runs, table, trained, _summary(i), _NAMES, _SETTINGS)


@query(
    "model_forecast_points",
    "M-08",
    "M-09",
    sql=f"""
    WITH wide AS (SELECT timestamp, hour(timestamp) AS hour, load_mw FROM v_system_load),
    rows AS (SELECT h.product, w.hour, w.load_mw, f.generation_mw AS generation_wind, h.price FROM v_hourly h
             JOIN wide w USING (timestamp) JOIN v_system_generation f ON f.timestamp = h.timestamp AND f.fuel_type = 'wind'),
    fit AS ({_FIT.format(groups="product, hour", x1="load_mw", x2="generation_wind", y="price", source="rows")}),
    runs AS (SELECT DISTINCT date_trunc('day', timestamp) + INTERVAL 7 HOUR AS run_time FROM v_ticks
             WHERE date_trunc('day', timestamp) <= (SELECT max(date_trunc('day', timestamp)) FROM v_ticks) - INTERVAL 3 DAY)
    SELECT run_time, timestamp, product, round(my + b1 * (load_mw - m1) + b2 * (generation_mw - m2), 4) AS point_forecast
    FROM (SELECT run_time, date_trunc('day', run_time) + INTERVAL 1 DAY + h.h * INTERVAL 1 HOUR AS timestamp FROM runs, range(72) h(h)) t
    JOIN wide w USING (timestamp) JOIN v_system_generation g ON g.timestamp = t.timestamp AND g.fuel_type = 'wind'
    JOIN fit f ON f.hour = w.hour""",
)
def _(i):
    wind = i.kept("system_generation").where("fuel_type = 'wind'").select("timestamp", F.col("generation_mw").alias("generation_wind"))
    inputs = settle(i.system_load.join(wind, "timestamp"))
    names = ["load_mw", "generation_wind"]
    rows = i.hourly.join(inputs, "timestamp").withColumn("hour", F.hour("timestamp"))
    trained = settle(models.train(rows, names, "price"))
    points = daily.point_forecasts(_runs(i), inputs, trained, names, _SETTINGS)
    known = points.where("point_forecast is not null")
    return rounded(known.select("run_time", "timestamp", "product", "point_forecast"), "point_forecast")


# The model of a run that does not depend on any order: features, fits, points, spreads, draws by their digests.
_TABLE = f"SELECT timestamp, hour(timestamp) AS hour, load_mw, total_generation, {', '.join(f'price_{p}' for p in PRODUCTS)} FROM ({BASE_SQL})"
_RUNS = """
    SELECT DISTINCT date_trunc('day', timestamp) + INTERVAL 7 HOUR AS run_time FROM v_ticks
    WHERE date_trunc('day', timestamp) <= (SELECT max(date_trunc('day', timestamp)) FROM v_ticks) - INTERVAL 3 DAY"""
_RUN_HASH = _HASH.format(extra="").replace("'7|'", f"'{_SETTINGS.seed}|'")
_RUN_PARTS = f"""
    base AS MATERIALIZED ({_TABLE}),
    learnt AS ({" UNION ALL ".join(f"SELECT hour, load_mw, total_generation, '{p}' AS product, price_{p} AS price FROM base" for p in PRODUCTS)}),
    fit AS ({_FIT.format(groups="product, hour", x1="load_mw", x2="total_generation", y="price", source="(SELECT * FROM learnt WHERE price IS NOT NULL AND load_mw IS NOT NULL AND total_generation IS NOT NULL)")}),
    runs AS ({_RUNS}),
    points AS (
      SELECT run_time, date_trunc('day', run_time) + INTERVAL 1 DAY AS forecast_date, t.timestamp, f.product, f.hour,
             my + b1 * (load_mw - m1) + b2 * (total_generation - m2) AS point_forecast
      FROM (SELECT run_time, date_trunc('day', run_time) + INTERVAL 1 DAY + h.h * INTERVAL 1 HOUR AS timestamp FROM runs, range({_SETTINGS.horizon_hours}) h(h)) t
      JOIN base USING (timestamp) JOIN fit f ON f.hour = base.hour),
    spread AS (
      SELECT points.*, ({_SPREADS["residuals"][1]}) * {_FACTOR.replace("CASE product", "CASE points.product")} AS std
      FROM points LEFT JOIN ({_SUMMARY}) s ON s.product = points.product AND s.hour = points.hour WHERE point_forecast IS NOT NULL),
    draws AS MATERIALIZED (
      SELECT product, timestamp, i, sqrt(-2.0::DOUBLE * ln({_unit(_RUN_HASH, 1)})) * cos(2.0::DOUBLE * pi() * {_unit(_RUN_HASH, 14)}) AS z
      FROM (SELECT DISTINCT product, timestamp FROM spread WHERE std > 0), (SELECT unnest(range(1, {_SETTINGS.sample_count + 1})) AS i))"""


@query(
    "forecast_backfill",
    "R-02",
    "M-08",
    "M-09",
    sql=f"""
    WITH {_RUN_PARTS},
    ends AS (SELECT product, timestamp, count(*) AS n, min(z) AS least, max(z) AS greatest FROM draws GROUP BY ALL)
    SELECT forecast_date, timestamp, product, round(point_forecast, 4) AS point_forecast, n AS sample_count,
           round({_held("point_forecast + std * least")}, 4) AS least_sample, round({_held("point_forecast + std * greatest")}, 4) AS greatest_sample
    FROM spread JOIN ends USING (product, timestamp) WHERE std > 0""",
)
def _(i):
    made = all_forecasts(i)
    shown = made.select(
        "forecast_date",
        "timestamp",
        "product",
        "point_forecast",
        F.size("samples").alias("sample_count"),
        F.array_min("samples").alias("least_sample"),
        F.array_max("samples").alias("greatest_sample"),
    )
    return rounded(shown, "point_forecast", "least_sample", "greatest_sample")


_LOST = PRODUCTS[-1]
_CHECKED = ", ".join(f"('{p}', {a}::DOUBLE, {b}::DOUBLE, {t}::DOUBLE)" for p, (a, b, t) in config.PLAUSIBLE_LIMITS.items())
_CATEGORIES = "['schema', 'completeness', 'plausibility', 'consistency', 'all']"


@query(
    "forecast_daily_run",
    "R-01",
    "S-11",
    sql=f"""
    WITH {_RUN_PARTS},
    two AS (SELECT max(run_time) AS last, max(run_time) - INTERVAL 1 DAY AS before FROM runs),
    -- The lost product has the forecast of the day before, a day later.
    final AS MATERIALIZED (
      SELECT timestamp AS drawn_at, timestamp, product, point_forecast, std FROM spread, two
      WHERE run_time = last AND product <> '{_LOST}' AND std > 0
      UNION ALL SELECT timestamp, timestamp + INTERVAL 1 DAY, product, point_forecast, std FROM spread, two
      WHERE run_time = before AND product = '{_LOST}' AND std > 0),
    limits AS (SELECT * FROM (VALUES {_CHECKED}) l(product, lo, hi, t)),
    samples AS (
      SELECT f.product, {_held("point_forecast + std * z").replace("product IN", "f.product IN")} AS x
      FROM final f JOIN draws d ON d.product = f.product AND d.timestamp = drawn_at),
    moved AS (SELECT *, lag(point_forecast) OVER (PARTITION BY product ORDER BY timestamp) AS earlier FROM final),
    found AS (
      SELECT 'completeness' AS category FROM (
        SELECT p.product, date_trunc('day', last) + INTERVAL 1 DAY + h.h * INTERVAL 1 HOUR AS timestamp
        FROM two, range({_SETTINGS.horizon_hours}) h(h), (SELECT unnest({PRODUCTS}) AS product) p
        EXCEPT SELECT product, timestamp FROM final)
      UNION ALL SELECT 'plausibility' FROM final JOIN limits USING (product) WHERE NOT (point_forecast BETWEEN lo AND hi)
      UNION ALL SELECT 'plausibility' FROM samples JOIN limits USING (product) WHERE NOT (x BETWEEN lo AND hi)
      UNION ALL SELECT 'plausibility' FROM final JOIN limits USING (product)
        JOIN (SELECT product, avg(point_forecast) AS m, stddev_samp(point_forecast) AS s FROM final GROUP BY product) USING (product)
        WHERE s >= 1e-8 AND abs(point_forecast - m) > t * s
      UNION ALL SELECT 'consistency' FROM final a JOIN final b ON a.timestamp = b.timestamp AND a.product IN ('DALMP', 'RTLMP')
        AND b.product IN ('RegUp', 'RegDown', 'RRS', 'NSRS') WHERE NOT a.point_forecast > b.point_forecast
      UNION ALL SELECT 'consistency' FROM moved WHERE abs(point_forecast - earlier) / abs(nullif(earlier, 0)) > 0.3::DOUBLE)
    SELECT date_trunc('day', last) + INTERVAL 1 DAY AS forecast_date, c.category, count(f.category) AS violations,
           count(f.category) = 0 AS is_valid, 0::BIGINT AS without_source
    FROM two, (SELECT unnest({_CATEGORIES}) AS category) c LEFT JOIN found f ON f.category = c.category OR c.category = 'all'
    GROUP BY last, c.category""",
)
def _(i):
    """The run of the last day after that of the day before; one product has lost its models and falls back."""
    table = daily.feature_table(_feeds(i), _SETTINGS)
    trained = settle(daily.train(table, _NAMES, _SETTINGS))
    path = new_folder(i.spark, "run")
    days = settle(_runs(i).orderBy(F.desc("run_time")).limit(2))
    as_of = F.lit("2024-02-01").cast("timestamp")
    before, last = days.agg(F.min("run_time").alias("run_time")), days.agg(F.max("run_time").alias("run_time"))
    summary = _summary(i)
    daily.run(i.spark, path, before, table, trained, summary, _NAMES, _SETTINGS, as_of)
    fewer = trained.where(F.col("product") != PRODUCTS[-1])
    found, without = daily.run(i.spark, path, last, table, fewer, summary, _NAMES, _SETTINGS, as_of)
    lost = without.groupBy("forecast_date").agg(F.count(F.lit(1)).alias("without_source"))
    return found.join(lost, "forecast_date", "left").fillna(0, ["without_source"])
