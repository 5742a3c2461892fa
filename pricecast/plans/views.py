"""SQL twins of the input views, for the engine that checks the results."""

_BROKEN_TIME = "CASE WHEN event_id % 83 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"
_BROKEN_VALUE = (
    "CASE WHEN event_id % 97 = 0 THEN 'n/a' WHEN event_id % 101 = 0 THEN '-5.0' ELSE printf('%.2f', price) END"
)

VIEWS = {
    "v_ticks": """
        SELECT event_id, ts, user_id, value AS price,
               CASE event_type WHEN 'purchase' THEN 'DALMP' WHEN 'view' THEN 'RTLMP' WHEN 'click' THEN 'RegUp'
                    WHEN 'signup' THEN 'RegDown' ELSE 'RRS' END AS product,
               CASE event_type WHEN 'purchase' THEN 'wind' WHEN 'view' THEN 'solar' WHEN 'click' THEN 'gas'
                    WHEN 'signup' THEN 'coal' ELSE 'nuclear' END AS fuel_type,
               'HB_' || (user_id % 3) AS node,
               date_trunc('hour', ts) AS timestamp
        FROM events""",
    "v_hourly": "SELECT product, timestamp, round(avg(price), 12) AS price FROM v_ticks GROUP BY ALL",
    "v_by_region": """
        SELECT t.*, r_name AS region FROM v_ticks t
        JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "v_load": "SELECT region, timestamp, round(sum(price), 2) AS load_mw FROM v_by_region GROUP BY ALL",
    "v_system_load": "SELECT timestamp, round(sum(price), 2) AS load_mw FROM v_ticks GROUP BY ALL",
    "v_generation": """
        SELECT region, fuel_type, timestamp, round(sum(price), 2) AS generation_mw
        FROM v_by_region GROUP BY ALL""",
    "v_system_generation": """
        SELECT fuel_type, timestamp, mw * (1 + (hour(timestamp) + length(fuel_type)) % 3) AS generation_mw
        FROM (SELECT fuel_type, timestamp, round(sum(price), 2) AS mw FROM v_ticks GROUP BY ALL)""",
    "v_pairs": """
        SELECT a.product, a.timestamp, a.price AS actual, b.price AS forecast FROM v_hourly a
        JOIN v_hourly b ON a.product = b.product AND a.timestamp = b.timestamp + INTERVAL 24 HOUR""",
    "v_vectors": """
        SELECT vec_id, ['DALMP', 'RTLMP', 'RegUp', 'RegDown', 'RRS', 'NSRS'][(label % 6 + 1)] AS product,
               list_transform(embedding, lambda x: 30.0::DOUBLE + x::DOUBLE * 60.0::DOUBLE) AS samples,
               vec_id % 7 = 0 AS is_fallback
        FROM embeddings""",
    "v_sampled": """
        SELECT vec_id, product, samples, is_fallback, round(list_avg(samples), 12) AS point_forecast,
               TIMESTAMP '2024-01-01 00:00:00' + vec_id * INTERVAL 1 HOUR AS timestamp,
               date_trunc('day', TIMESTAMP '2024-01-01 00:00:00' + vec_id * INTERVAL 1 HOUR)
                 - INTERVAL 17 HOUR AS generation_timestamp
        FROM v_vectors""",
    "v_copies": """
        SELECT vec_id, product, samples, is_fallback, round(list_avg(samples), 12) AS point_forecast,
               TIMESTAMP '2024-01-01 00:00:00' + (vec_id % 24) * INTERVAL 1 HOUR AS timestamp
        FROM v_vectors""",
    "v_shown": """
        SELECT product, timestamp, round(avg(price), 12) AS point_forecast, min(price) AS lower_bound,
               max(price) AS upper_bound, bool_or(event_id % 50 = 0) AS is_fallback
        FROM v_ticks GROUP BY ALL""",
    "v_stored": """
        SELECT *, date_trunc('day', timestamp) AS forecast_date,
               date_trunc('day', timestamp) - INTERVAL 17 HOUR AS generation_timestamp
        FROM v_shown""",
    "v_index": """
        SELECT forecast_date, product, min(timestamp) AS first_hour,
               date_diff('hour', min(timestamp), max(timestamp)) + 1 AS horizon_hours,
               max(generation_timestamp) AS generation_timestamp, bool_or(is_fallback) AS is_fallback,
               count(*) AS row_count
        FROM v_stored GROUP BY ALL""",
    "v_paths": """
        SELECT *, 'forecasts/' || strftime(timestamp, '%Y/%m/%d') || '_' || product || '.parquet' AS path FROM v_ticks""",
    "v_entries": """
        SELECT date_trunc('day', timestamp) AS forecast_date, product, ts AS generation_timestamp, event_id,
               CASE WHEN event_id % 11 = 0 THEN 'forecasts/tmp_' || event_id
                    WHEN event_id % 13 = 0 THEN regexp_replace(path, '_[A-Za-z]+', '_Other')
                    WHEN event_id % 17 = 0 THEN regexp_replace(path, '/[0-9][0-9]/', '/13/', 'g')
                    ELSE path END AS file_path,
               event_id % 7 = 0 AS is_fallback
        FROM v_paths""",
    "v_raw_prices": f"""
        SELECT {_BROKEN_TIME} AS "Timestamp",
               CASE WHEN event_id % 89 = 0 THEN 'Unknown' ELSE lower(product) END AS "Product",
               CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE printf('%.2f', price) END AS "Price",
               lower(node) AS "Node", event_id AS "Event ID"
        FROM v_ticks""",
    "v_raw_load": f"""
        SELECT {_BROKEN_TIME} AS "Timestamp", {_BROKEN_VALUE} AS "Load MW",
               CASE WHEN event_id % 103 = 0 THEN '' ELSE lower(region) END AS "Region", event_id AS "Event ID"
        FROM v_by_region""",
    "v_raw_generation": f"""
        SELECT {_BROKEN_TIME} AS "Timestamp", upper(fuel_type) AS "Fuel Type", {_BROKEN_VALUE} AS "Generation MW",
               lower(region) AS "Region", event_id AS "Event ID"
        FROM v_by_region""",
}
