"""Streams over the event files, run to completion."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast.plans.inputs import PRODUCTS, _named
from pricecast.plans.registry import query
from pricecast.sources.scratch import new_folder
from pricecast.streaming import feeds

_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def _stream(i):
    rows = feeds.read(i.spark, i.folder, _EVENTS, "events.parquet")
    return rows.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        _named("event_type", PRODUCTS).alias("product"),
        F.col("value").alias("price"),
        F.concat(F.lit("HB_"), F.col("user_id") % 3).alias("node"),
        "event_id",
    )


@query(
    "stream_hourly_prices",
    "K-02",
    sql="""
    SELECT product, timestamp, round(avg(price), 6) AS mean, min(price) AS least, max(price) AS greatest, count(*) AS row_count
    FROM v_ticks WHERE timestamp + INTERVAL 1 HOUR <= (SELECT max(ts) FROM v_ticks) - INTERVAL 2 HOUR GROUP BY ALL""",
)
def _(i):
    out = new_folder(i.spark, "hourly")
    hourly = feeds.hourly(_stream(i), "price", ["product"])
    feeds.write_table(hourly, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return i.spark.read.schema(hourly.schema).parquet(f"{out}/table")


@query(
    "stream_feed_landing",
    "K-01",
    sql="""
    SELECT CASE WHEN event_id % 89 = 0 THEN 'unknown product' ELSE 'accepted' END AS outcome, count(*) AS row_count,
           round(sum(price), 6) AS total FROM v_ticks GROUP BY ALL""",
)
def _(i):
    out = new_folder(i.spark, "landing")
    rows = _stream(i)
    # Every record arrives twice; the second copy is dropped in the stream.
    twice = rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    marked = twice.withColumn("product", F.when(F.col("event_id") % 89 == 0, "Other").otherwise(F.col("product")))
    good, bad = f"{out}/good", f"{out}/bad"
    feeds.land(marked, "price", ["event_id"], good, bad, f"{out}/checkpoint").awaitTermination()
    schema = "timestamp timestamp, product string, price double, node string, event_id long, reason string"
    both = [i.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(p) for p in (good, bad)]
    return (
        both[0]
        .unionByName(both[1])
        .groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum("price").alias("total"))
    )


# Three arrivals. The second brings a part of the first again: within the delay of two days that is a repetition, before it is
# late. The third does so with both, and has records of the first days that were never seen.
_THIRDS = [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-01")]
_NEW_ID = 1_000_000_000_000


def _arrivals(i):
    rows = i.ticks.select(
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_id") % 89 == 0, "Other").otherwise(F.col("product")).alias("product"),
        "price",
        "node",
        "event_id",
    )
    first, second, third = (rows.where((F.col("timestamp") >= a) & (F.col("timestamp") < b)) for a, b in _THIRDS)
    unseen = first.where("event_id % 7 = 0").withColumn("event_id", F.col("event_id") + _NEW_ID)
    e = F.col("event_id")
    yield first.unionByName(first.where(e % 2 == 0))
    yield second.unionByName(first.where(e % 3 == 0))
    yield third.unionByName(first.where(e % 5 == 0)).unionByName(second.where(e % 4 == 0)).unionByName(unseen)


@query(
    "stream_feed_arrivals",
    "K-01",
    sql=f"""
    WITH rows AS (
      SELECT ts AS timestamp, price, event_id, CASE WHEN event_id % 89 = 0 THEN 'unknown product' ELSE 'accepted' END AS outcome FROM v_ticks),
    first AS (SELECT * FROM rows WHERE timestamp < '{_THIRDS[0][1]}'),
    second AS (SELECT * FROM rows WHERE timestamp >= '{_THIRDS[1][0]}' AND timestamp < '{_THIRDS[1][1]}'),
    third AS (SELECT * FROM rows WHERE timestamp >= '{_THIRDS[2][0]}'),
    marks AS (SELECT (SELECT date_trunc('milliseconds', max(timestamp)) FROM first) - INTERVAL 2 DAY AS m1,
                     (SELECT date_trunc('milliseconds', max(timestamp)) FROM second) - INTERVAL 2 DAY AS m2),
    late AS (
      SELECT * REPLACE ('late' AS outcome) FROM first, marks WHERE event_id % 3 = 0 AND timestamp <= m1
      UNION ALL SELECT * REPLACE ('late' AS outcome) FROM first, marks WHERE event_id % 5 = 0
      UNION ALL SELECT * REPLACE ('late' AS outcome) FROM second, marks WHERE event_id % 4 = 0 AND timestamp <= m2
      UNION ALL SELECT * REPLACE ('late' AS outcome, event_id + {_NEW_ID} AS event_id) FROM first, marks WHERE event_id % 7 = 0)
    SELECT outcome, event_id, timestamp, round(price, 6) AS price FROM (
      SELECT * FROM rows UNION ALL SELECT timestamp, price, event_id, outcome FROM late)""",
)
def _(i):
    out = new_folder(i.spark, "arrivals")
    schema = "timestamp timestamp, product string, price double, node string, event_id long"
    for rows in _arrivals(i):
        rows.write.mode("append").parquet(f"{out}/raw")
        raw = i.spark.readStream.schema(schema).parquet(f"{out}/raw")
        feeds.land(raw, "price", ["event_id"], f"{out}/good", f"{out}/bad", f"{out}/checkpoint").awaitTermination()
    both = [i.spark.read.schema(f"{schema}, reason string").option("recursiveFileLookup", True).parquet(f"{out}/{p}") for p in ("good", "bad")]
    return both[0].unionByName(both[1]).select(F.coalesce("reason", F.lit("accepted")).alias("outcome"), "event_id", "timestamp", "price")
