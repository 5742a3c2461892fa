"""Feeds as streams: landing with quarantine, and hourly windows with late data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pricecast.operators import normalize
from pricecast.sources.scratch import settle


def read(spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, kind: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.format(kind).load(path)


def land(
    raw: DataFrame,
    feed: str,
    keys: Sequence[str],
    good_path: str,
    bad_path: str,
    checkpoint: str,
    delay: str = "2 days",
    products: Sequence[str] | None = None,
) -> StreamingQuery:
    """Append clean rows to one table and rejected rows, each with its reason, to another.

    A record counts once: its keys are kept in the state store of the stream until the watermark, ``delay`` behind the
    newest record, has passed its time and the delay once more, and repetitions are dropped there. No batch reads
    what earlier ones landed. A row that is older than the watermark can no longer be told from a repetition; it
    goes to the rejected rows with the reason ``late``, once for its keys and batch. A row without a time is judged within
    its batch. Each batch is worked out once, under its own number, and overwrites it when retried, so a lost executor or
    driver doubles nothing.

    The stream drops late rows without a word. To keep them, the rows pass a second time beside the stateful
    operator, and those at or before the watermark of the batch are taken; the newest time so far is a one-row table
    per batch beside the checkpoint.
    """
    spark = raw.sparkSession
    newest_of = f"{checkpoint.rstrip('/')}-newest"
    rows = raw.withColumn("_event", F.col("timestamp").cast("timestamp"))
    once = rows.withWatermark("_event", delay).dropDuplicatesWithinWatermark(list(keys))
    both = once.withColumn("_once", F.lit(True)).unionByName(rows.withColumn("_once", F.lit(False)))

    def store(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{newest_of}/batch={number - 1}").first()["newest"] if number else None
        # The engine's watermark begins at the epoch and counts whole milliseconds.
        newest = F.timestamp_millis(F.lit(before).cast("long"))
        watermark = F.greatest(F.timestamp_millis(F.lit(0)), newest - F.expr(f"interval {delay}"))
        late = F.coalesce(~F.col("_once") & (F.col("_event") <= watermark), F.lit(False))
        seen = Observation()
        told = settle(batch.observe(seen, F.max(F.unix_millis("_event")).alias("newest")).where(F.col("_once") | late).withColumn("_late", late))
        known = [n for n in (before, seen.get["newest"]) if n is not None]
        latest = spark.createDataFrame([(max(known, default=None),)], "newest long")
        latest.write.mode("overwrite").parquet(f"{newest_of}/batch={number}")

        fresh = told.where("NOT _late").drop("_event", "_once", "_late")
        good, bad = normalize.split_records(fresh, feed, products)
        tardy = normalize.standard_names(told.where("_late").dropDuplicates(list(keys))).withColumn("reason", F.lit("late"))
        tardy = tardy.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in bad.schema.fields])
        good.write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        bad.unionByName(tardy).write.mode("overwrite").parquet(f"{bad_path}/batch={number}")

    return (
        both.writeStream.foreachBatch(store)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def hourly(df: DataFrame, value: str, keys: Sequence[str], delay: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Tumbling mean, least and greatest per key; rows later than the delay are left out."""
    window = F.window("timestamp", width)
    return (
        df.withWatermark("timestamp", delay)
        .groupBy(window, *keys)
        .agg(
            F.avg(value).alias("mean"),
            F.min(value).alias("least"),
            F.max(value).alias("greatest"),
            F.count(value).alias("row_count"),
        )
        .select(F.col("window.start").alias("timestamp"), *keys, "mean", "least", "greatest", "row_count")
    )


def write_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a Parquet table."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
