"""Intermediate tables in the shared folder of the cluster.

A frame that several branches of a plan read is computed once, and a lost executor costs a re-read of a
file instead of the lineage behind it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

Settle = Callable[[DataFrame], DataFrame]


def as_is(df: DataFrame) -> DataFrame:
    """The default of composite operators: one lazy plan."""
    return df


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; one of its own only where all runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        folder = tempfile.mkdtemp(prefix="pricecast-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_passing: list[list[str]] = []
"""Of each open ``passing`` block, the folders of the tables settled in it."""


def settle(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet and go on from the written table: column pruning and known sizes included."""
    path = new_folder(df.sparkSession, "table")
    if _passing:
        _passing[-1].append(path)
    return _written(df, path)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Settle]:
    """A block whose settled tables are dropped at its end, so that a long run does not fill the shared folder.

    The block gets a function that settles what is to stay. A frame that leaves it in another way must not read what is
    dropped: nothing of it is kept elsewhere.
    """
    made: list[str] = []
    _passing.append(made)
    try:
        yield lambda df: _written(df, new_folder(df.sparkSession, "table"))
    finally:
        _passing.remove(made)
        for path in made:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
