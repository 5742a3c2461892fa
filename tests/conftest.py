import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """``frame("timestamp string, x double", rows)``; a ``timestamp`` column given as text becomes a time."""

    def make(schema, rows):
        df = spark.createDataFrame(rows, schema)
        for c, kind in df.dtypes:
            if c in ("timestamp", "target", "created_at", "generation_timestamp") and kind == "string":
                df = df.withColumn(c, F.col(c).cast("timestamp"))
        return df

    return make


@pytest.fixture
def at():
    def hour(n, day="2024-01-01"):
        start = dt.datetime.fromisoformat(day)
        return (start + dt.timedelta(hours=n)).strftime("%Y-%m-%d %H:%M:%S")

    return hour


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*df.columns[:1]).collect()]
