"""Pivots, samples in wide and array form, grids, fills and joins."""

from pyspark.sql import functions as F

from pricecast.functions import timeline
from pricecast.operators import align, joins, reshape, topk
from pricecast.plans.inputs import FUELS, PRODUCTS, SAMPLES, hours
from pricecast.plans.registry import query
from pricecast.sources.scratch import settle


def _each(items, template):
    return ", ".join(template.format(x) for x in items)


# --- samples -----------------------------------------------------------------------------------

@query(
    "samples_to_columns",
    "S-06",
    sql="SELECT vec_id, product, "
    + ", ".join(f"round(samples[{n}], 6) AS sample_{n:03d}" for n in range(1, SAMPLES + 1))
    + " FROM v_sampled",
)
def _(i):
    return reshape.array_to_wide(i.sampled.select("vec_id", "product", "samples"), SAMPLES)


@query(
    "columns_to_samples",
    "S-05",
    sql="""
    SELECT vec_id, len(samples) AS sample_count, round(samples[1], 6) AS first_sample,
           round(samples[64], 6) AS last_sample, round(list_sum(samples), 6) AS total FROM v_sampled""",
)
def _(i):
    wide = reshape.array_to_wide(i.sampled.select("vec_id", "samples"), SAMPLES)
    back = reshape.wide_to_array(wide)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return back.select(
        "vec_id",
        F.size("samples").alias("sample_count"),
        F.element_at("samples", 1).alias("first_sample"),
        F.element_at("samples", -1).alias("last_sample"),
        total.alias("total"),
    )


@query(
    "samples_as_rows",
    "P-07",
    sql="""
    SELECT vec_id, product, timestamp, unnest(range(64)) AS sample_index,
           round(unnest(samples), 6) AS sample_value FROM v_sampled""",
)
def _(i):
    return reshape.distribution(i.sampled.select("vec_id", "product", "timestamp", "samples"))


# --- pivots ------------------------------------------------------------------------------------


@query(
    "generation_by_fuel",
    "P-01",
    sql=f"""
    SELECT timestamp, {_each(FUELS, "coalesce(round(sum(generation_mw) FILTER (fuel_type = '{0}'), 6), 0) AS generation_{0}")}
    FROM v_generation GROUP BY ALL""",
)
def _(i):
    return reshape.pivot_generation(i.generation, FUELS)


def _filled(columns, source):
    """Forward fill, then backward fill, in SQL."""
    parts = []
    for c in columns:
        forward = f"last_value({c} IGNORE NULLS) OVER (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        backward = f"first_value({c} IGNORE NULLS) OVER (ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        parts.append(f"round(coalesce({forward}, {backward}), 6) AS {c}")
    return f"SELECT timestamp, {', '.join(parts)} FROM ({source})"


_PRICE_PIVOT = (
    "SELECT timestamp, "
    + _each(PRODUCTS, "avg(price) FILTER (product = '{0}') AS price_{0}")
    + " FROM v_ticks GROUP BY ALL"
)


@query("prices_by_product", "P-02", sql=_filled([f"price_{p}" for p in PRODUCTS], _PRICE_PIVOT))
def _(i):
    return reshape.price_matrix(i.ticks.select("timestamp", "product", "price"), PRODUCTS)


@query(
    "model_price_matrix",
    "P-03",
    sql=_filled(
        [f"price_{p}" for p in [*PRODUCTS, "NSRS"]],
        _PRICE_PIVOT.replace(" FROM v_ticks", ", NULL::DOUBLE AS price_NSRS FROM v_ticks"),
    ),
)
def _(i):
    return reshape.price_matrix(i.ticks.select("timestamp", "product", "price"))


@query(
    "price_heatmap",
    "P-04",
    sql="SELECT date_trunc('day', timestamp) AS date, "
    + ", ".join(f"min(point_forecast) FILTER (hour(timestamp) = {h}) AS hour_{h:02d}" for h in range(24))
    + " FROM v_shown WHERE product = 'DALMP' GROUP BY ALL",
    doubles=" ".join(f"hour_{h:02d}" for h in range(24)),
)
def _(i):
    return reshape.heatmap(i.shown, "DALMP")


# --- grids and fills ---------------------------------------------------------------------------

_SPAN = "generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)"
# One row per product and hour between the first and the last hour of the product, gaps as null.
_GRID = f"""
    SELECT g.product, g.timestamp, h.price FROM
      (SELECT product, unnest({_SPAN}) AS timestamp FROM v_hourly GROUP BY product) g
    LEFT JOIN v_hourly h ON h.product = g.product AND h.timestamp = g.timestamp"""


def _gappy(i):
    hourly = i.kept("hourly")
    bounds = hourly.groupBy("product").agg(F.min("timestamp").alias("_from"), F.max("timestamp").alias("_to"))
    return settle(align.to_grid(hourly, align.series_grid(bounds), ["product"]))


@query(
    "resampled_hours",
    "G-01",
    sql=f"""
    SELECT g.product, g.timestamp, round(avg(price), 6) AS mean_price, coalesce(round(sum(price), 6), 0) AS total_price,
           max(price) AS max_price
    FROM (SELECT product, unnest({_SPAN}) AS timestamp FROM v_ticks GROUP BY product) g
    LEFT JOIN v_ticks t ON t.product = g.product AND t.timestamp = g.timestamp GROUP BY ALL""",
)
def _(i):
    return align.resample(
        i.ticks.select("product", F.col("ts").alias("timestamp"), "price"),
        ["product"],
        "1 hour",
        {"mean_price": ("price", "avg"), "total_price": ("price", "sum"), "max_price": ("price", "max")},
        settle=settle,
    )


_W = "OVER (PARTITION BY product ORDER BY timestamp ROWS BETWEEN {} AND {})"
_UP = _W.format("UNBOUNDED PRECEDING", "CURRENT ROW")
_DOWN = _W.format("CURRENT ROW", "UNBOUNDED FOLLOWING")
_BLEND = f"""
    SELECT product, timestamp, price,
      last_value(price IGNORE NULLS) {_UP} AS pv, first_value(price IGNORE NULLS) {_DOWN} AS nv,
      last_value(CASE WHEN price IS NOT NULL THEN timestamp END IGNORE NULLS) {_UP} AS pt,
      first_value(CASE WHEN price IS NOT NULL THEN timestamp END IGNORE NULLS) {_DOWN} AS nt
    FROM ({{}})"""
_BLENDED = """
    SELECT product, timestamp, round(CASE WHEN price IS NOT NULL OR pv IS NULL THEN price WHEN nv IS NULL THEN pv
      ELSE pv + (nv - pv) * (epoch(timestamp) - epoch(pt)) / (epoch(nt) - epoch(pt)) END, 6) AS price
    FROM ({})"""


@query("prices_filled_forward", "G-03", sql=f"SELECT product, timestamp, last_value(price IGNORE NULLS) {_UP} AS price FROM ({_GRID})", doubles="price")
def _(i):
    rows = settle(_gappy(i))
    chunks = timeline.Chunks.by_count(rows, ["product"], "timestamp", settle)
    return timeline.fill(rows, ["product"], "timestamp", ["price"], chunks=chunks)


@query("prices_filled_backward", "G-04", sql=f"SELECT product, timestamp, first_value(price IGNORE NULLS) {_DOWN} AS price FROM ({_GRID})", doubles="price")
def _(i):
    return timeline.fill(_gappy(i), ["product"], "timestamp", ["price"], ("backward",), chunk_seconds=timeline.DAY)


@query("prices_interpolated", "G-05", sql=_BLENDED.format(_BLEND.format(_GRID)))
def _(i):
    rows = settle(_gappy(i))
    # So few rows per chunk that the days of a product are several tasks.
    chunks = timeline.Chunks.by_count(rows, ["product"], "timestamp", settle, rows=100)
    return timeline.interpolate(rows, ["product"], "timestamp", ["price"], chunks=chunks)


_UNION_GRID = """
    SELECT p.product, g.timestamp, h.price FROM (SELECT DISTINCT product FROM v_hourly) p,
      (SELECT unnest(generate_series((SELECT min(timestamp) FROM v_ticks) - INTERVAL 3 HOUR,
         (SELECT max(timestamp) FROM v_ticks), INTERVAL 1 HOUR)) AS timestamp) g
    LEFT JOIN v_hourly h ON h.product = p.product AND h.timestamp = g.timestamp"""


@query("feeds_aligned", "G-02", sql=_BLENDED.format(_BLEND.format(_UNION_GRID)))
def _(i):
    early = i.kept("system_load").select((F.col("timestamp") - hours(3)).alias("timestamp"), "load_mw")
    aligned = align.align({"price": (i.kept("hourly"), ("product",)), "load": (early, ())}, settle=settle)
    return aligned["price"]


_LOAD_GRID = """
    SELECT NULL::VARCHAR AS product, g.timestamp, l.load_mw AS price FROM (SELECT unnest(generate_series((SELECT min(timestamp) FROM v_ticks)
         - INTERVAL 3 HOUR, (SELECT max(timestamp) FROM v_ticks), INTERVAL 1 HOUR)) AS timestamp) g
    LEFT JOIN (SELECT timestamp - INTERVAL 3 HOUR AS timestamp, load_mw FROM v_system_load) l ON l.timestamp = g.timestamp"""


@query(
    "feeds_aligned_both",
    "G-02",
    sql=f"""
    SELECT 'price' AS feed, product, timestamp, price AS value FROM ({_BLENDED.format(_BLEND.format(_UNION_GRID))})
    UNION ALL SELECT 'load', product, timestamp, price FROM ({_BLENDED.format(_BLEND.format(_LOAD_GRID))})""",
)
def _(i):
    early = i.kept("system_load").select((F.col("timestamp") - hours(3)).alias("timestamp"), "load_mw")
    aligned = align.align({"price": (i.kept("hourly"), ("product",)), "load": (early, ())}, settle=settle)
    price = aligned["price"].select(F.lit("price").alias("feed"), "product", "timestamp", F.col("price").alias("value"))
    load = aligned["load"].select(F.lit("load").alias("feed"), F.lit(None).cast("string").alias("product"), "timestamp", F.col("load_mw").alias("value"))
    return price.unionByName(load)


@query(
    "hour_grid",
    "G-06",
    sql="""
    SELECT product, start, start + h.h * INTERVAL 1 HOUR AS timestamp
    FROM (SELECT product, max(date_trunc('day', timestamp)) + INTERVAL 1 DAY AS start FROM v_ticks GROUP BY ALL), range(72) h(h)""",
)
def _(i):
    starts = i.ticks.groupBy("product").agg((F.max(F.date_trunc("day", "timestamp")) + hours(24)).alias("start"))
    return align.hour_grid(starts, "start")


@query(
    "date_range_grid",
    "G-07",
    sql="""
    SELECT product, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 23 HOUR,
      INTERVAL 1 HOUR)) AS timestamp FROM v_ticks GROUP BY product""",
)
def _(i):
    spans = i.ticks.groupBy("product").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return align.day_range_grid(spans, "a", "b").select("product", "timestamp")


@query(
    "times_shifted", "G-08", sql="SELECT event_id, ts + INTERVAL 36 HOUR AS ts FROM v_ticks"
)
def _(i):
    return align.shift_time(i.ticks.select("event_id", "ts"), hours(36), "ts")


# --- joins -------------------------------------------------------------------------------------


def _one_product(i, product, name="price"):
    rows = i.hourly.where(F.col("product") == product)
    return rows.select("timestamp", F.col("price").alias(name))


@query(
    "frames_merged",
    "J-01",
    sql="""
    SELECT timestamp, a.price AS price, b.price AS price_rt, c.price AS price_up
    FROM (SELECT timestamp, price FROM v_hourly WHERE product = 'DALMP') a
    FULL JOIN (SELECT timestamp, price FROM v_hourly WHERE product = 'RTLMP') b USING (timestamp)
    FULL JOIN (SELECT timestamp, price FROM v_hourly WHERE product = 'RegUp') c USING (timestamp)""",
    doubles="price price_rt price_up",
)
def _(i):
    frames = [_one_product(i, p) for p in ("DALMP", "RTLMP", "RegUp")]
    return joins.merge_frames(frames, "outer", ["rt", "up"])


@query(
    "feature_frames_merged",
    "J-03",
    sql="""
    SELECT timestamp, round(l.value, 6) AS value, l.load_mw, round(p.value, 6) AS value_price, round(p.price, 6) AS price
    FROM (SELECT timestamp, load_mw, load_mw / 2 AS value FROM v_system_load) l
    FULL JOIN (SELECT timestamp, price, price / 2 AS value FROM v_hourly WHERE product = 'RRS') p USING (timestamp)""",
)
def _(i):
    load = i.system_load.withColumn("value", F.col("load_mw") / 2)
    price = _one_product(i, "RRS").withColumn("value", F.col("price") / 2)
    return joins.merge_features({"load": load, "price": price})


def _combined_sql():
    def blended(source, keys, value):
        part = f"PARTITION BY {keys} " if keys else ""
        up = f"OVER ({part}ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        down = f"OVER ({part}ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        at = f"CASE WHEN {value} IS NOT NULL THEN timestamp END"
        head = f"{keys}, " if keys else ""
        return f"""
        SELECT {head}timestamp, CASE WHEN {value} IS NOT NULL OR pv IS NULL THEN {value} WHEN nv IS NULL THEN pv
          ELSE pv + (nv - pv) * (epoch(timestamp) - epoch(pt)) / (epoch(nt) - epoch(pt)) END AS {value}
        FROM (SELECT *, last_value({value} IGNORE NULLS) {up} AS pv, first_value({value} IGNORE NULLS) {down} AS nv,
          last_value({at} IGNORE NULLS) {up} AS pt, first_value({at} IGNORE NULLS) {down} AS nt FROM ({source}))"""

    grid = """(SELECT unnest(generate_series((SELECT min(timestamp) FROM v_ticks), (SELECT max(timestamp) FROM v_ticks),
      INTERVAL 1 HOUR)) AS timestamp) g"""
    load = f"SELECT g.timestamp, l.load_mw FROM {grid} LEFT JOIN v_system_load l USING (timestamp)"
    price = f"""SELECT k.product, g.timestamp, p.price FROM (SELECT DISTINCT product FROM v_hourly) k, {grid}
      LEFT JOIN v_hourly p ON p.product = k.product AND p.timestamp = g.timestamp"""
    fuel = f"""SELECT k.fuel_type, g.timestamp, p.generation_mw FROM (SELECT DISTINCT fuel_type FROM v_system_generation) k, {grid}
      LEFT JOIN v_system_generation p ON p.fuel_type = k.fuel_type AND p.timestamp = g.timestamp"""
    prices = _each(PRODUCTS, "avg(price) FILTER (product = '{0}') AS price_{0}")
    fuels = _each(FUELS, "coalesce(sum(generation_mw) FILTER (fuel_type = '{0}'), 0) AS generation_{0}")
    return f"""
    SELECT timestamp, round(load_mw, 6) AS load_mw, {_each(PRODUCTS, 'round(price_{0}, 6) AS price_{0}')},
           {_each(FUELS, 'round(generation_{0}, 6) AS generation_{0}')}
    FROM ({blended(load, '', 'load_mw')})
    FULL JOIN (SELECT timestamp, {prices} FROM ({blended(price, 'product', 'price')}) GROUP BY timestamp) USING (timestamp)
    FULL JOIN (SELECT timestamp, {fuels} FROM ({blended(fuel, 'fuel_type', 'generation_mw')}) GROUP BY timestamp)
      USING (timestamp)"""


@query("combined_dataset", "J-02", sql=_combined_sql())
def _(i):
    return joins.combined_dataset(
        i.kept("system_load"), i.kept("hourly"), i.kept("system_generation"), FUELS, PRODUCTS, settle
    )


@query("forecast_vs_actual", "J-04", sql="SELECT * FROM v_pairs", doubles="actual forecast")
def _(i):
    hourly = i.kept("hourly")
    earlier = hourly.select("product", (F.col("timestamp") + hours(24)).alias("timestamp"), F.col("price").alias("forecast"))
    return joins.forecast_vs_actual(earlier, hourly.withColumnRenamed("price", "actual"))


@query(
    "ensembles_paired",
    "J-05",
    sql="""
    WITH nodes AS (SELECT node, product, timestamp, round(avg(price), 12) AS p FROM v_ticks GROUP BY ALL)
    SELECT a.node AS first, b.node AS second, a.product, a.timestamp, a.p AS first_point, b.p AS second_point
    FROM nodes a JOIN nodes b ON a.product = b.product AND a.timestamp = b.timestamp AND a.node < b.node""",
    doubles="first_point second_point",
)
def _(i):
    nodes = settle(node_ensembles(i))
    pairs = [("HB_0", "HB_1"), ("HB_0", "HB_2"), ("HB_1", "HB_2")]
    return topk.concat(
        *[joins.pair_ensembles(nodes, a, b).withColumns({"first": F.lit(a), "second": F.lit(b)}) for a, b in pairs]
    )


@query(
    "ensembles_paired_ordered",
    "J-05",
    sql="""
    WITH nodes AS (SELECT node, product, timestamp, round(avg(price), 12) AS p FROM v_ticks GROUP BY ALL)
    SELECT a.node AS first, b.node AS second, a.product, a.timestamp, a.p AS first_point, b.p AS second_point
    FROM nodes a JOIN nodes b ON a.product = b.product AND a.timestamp = b.timestamp AND a.node <> b.node""",
    doubles="first_point second_point",
)
def _(i):
    return joins.pair_all_ensembles(settle(node_ensembles(i)))


def node_ensembles(i):
    """The prices of each node as an ensemble of its own."""
    return i.ticks.groupBy(F.col("node").alias("ensemble_id"), "product", "timestamp").agg(
        F.round(F.avg("price"), 12).alias("point_forecast")
    )


@query(
    "nearest_hour",
    "J-06",
    sql="""
    SELECT event_id, t.product, target, nearest_time, point_forecast FROM (
      SELECT e.event_id, e.product, e.ts AS target, s.timestamp AS nearest_time, s.point_forecast,
             row_number() OVER (PARTITION BY e.event_id
               ORDER BY abs(epoch_us(s.timestamp) - epoch_us(e.ts)), s.timestamp) AS r
      FROM v_ticks e JOIN v_shown s ON e.product = s.product) t WHERE r = 1""",
    doubles="point_forecast",
)
def _(i):
    targets = i.ticks.select("event_id", "product", F.col("ts").alias("target"))
    return joins.nearest(targets, i.shown, ["product"], "point_forecast", settle=settle)


def _earlier_sql(ahead, back):
    return f"""
    SELECT t.product, t.target_date, date_diff('day', i.forecast_date, t.target_date) AS age_days, i.forecast_date
    FROM (SELECT DISTINCT product, date_trunc('day', timestamp + INTERVAL {ahead} HOUR) AS target_date FROM v_ticks) t
    JOIN (SELECT * FROM v_index WHERE horizon_hours = 24) i ON i.product = t.product
     AND i.forecast_date BETWEEN t.target_date - INTERVAL {back} DAY AND t.target_date - INTERVAL 1 DAY
    QUALIFY row_number() OVER (PARTITION BY t.product, t.target_date ORDER BY i.forecast_date DESC) = 1"""


# A week back for targets four days ahead; a year back for targets two hundred days ahead. The plans are the same.
for _name, _ahead, _back in (("earlier_forecast_search", 96, 7), ("earlier_forecast_search_year", 4800, 365)):

    @query(_name, "J-07", sql=_earlier_sql(_ahead, _back))
    def _(i, ahead=_ahead, back=_back):
        from pricecast.sources.store import index_of

        targets = i.kept("stored").select("product", F.to_date(F.col("timestamp") + hours(ahead)).alias("target_date"))
        index = index_of(i.kept("stored")).where("horizon_hours = 24")
        return joins.days_back(targets, index, back, settle=settle).select("product", "target_date", "age_days", "forecast_date")


@query(
    "missing_combinations",
    "J-08",
    sql="""
    SELECT p.product, start + h.h * INTERVAL 1 HOUR AS timestamp
    FROM (SELECT min(date_trunc('day', timestamp)) AS start FROM v_ticks), range(720) h(h),
      (SELECT unnest(['DALMP', 'RTLMP', 'RegUp', 'RegDown', 'RRS', 'NSRS']) AS product) p
    EXCEPT SELECT product, timestamp FROM v_shown""",
)
def _(i):
    from pricecast import config
    from pricecast.operators import validate

    start = i.ticks.agg(F.min(F.date_trunc("day", "timestamp")).alias("start"))
    return validate.missing_cells(i.shown, validate.expected_cells(start, "start", config.PRODUCTS, 720))


@query(
    "product_attributes",
    "J-09",
    sql="""
    SELECT vec_id, v.product, d.* FROM v_sampled v JOIN (VALUES
      ('DALMP', 'Day-Ahead LMP', '$/MWh', 'energy', true, 1), ('RTLMP', 'Real-Time LMP', '$/MWh', 'energy', true, 2),
      ('RegUp', 'Regulation Up', '$/MW', 'ancillary', false, 3), ('RegDown', 'Regulation Down', '$/MW', 'ancillary', false, 4),
      ('RRS', 'Responsive Reserve', '$/MW', 'ancillary', false, 5), ('NSRS', 'Non-Spinning Reserve', '$/MW', 'ancillary', false, 6))
      d(p, display_name, unit, category, can_be_negative, sort_order) ON d.p = v.product""".replace(
        "d.*", "d.display_name, d.unit, d.category, d.can_be_negative, d.sort_order::BIGINT AS sort_order"
    ),
)
def _(i):
    return joins.attach_product(i.sampled.select("vec_id", "product"))
