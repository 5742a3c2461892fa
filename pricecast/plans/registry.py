"""Registered queries: a Spark plan over the given tables, its SQL twin and the blueprint rows it covers."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast.plans.inputs import Inputs
from pricecast.plans.views import VIEWS

DECIMALS = 6
# Moves values off the halves of the last digit, which the two engines round differently. Values with
# no more than six digits stay as they are.
NUDGE = 3e-8


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Inputs], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, *covers: str, sql: str | None = None, doubles: str = ""):
    """Register ``build(inputs) -> DataFrame`` under a name.

    ``doubles`` names output columns of the statement that still have to be rounded.
    """
    if sql is not None and doubles:
        cells = ", ".join(f"round({c}, {DECIMALS}) AS {c}" for c in doubles.split())
        sql = f"SELECT * REPLACE ({cells}) FROM ({sql})"

    def add(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, covers, build, None if sql is None else with_views(nudged(sql)))
        return build

    return add


def nudged(sql: str) -> str:
    """Every ``round(x, 6)`` of a statement as ``comparable`` rounds."""
    out, start = [], 0
    for found in re.finditer(r"\bround\(", sql):
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[found.end() : end - 1]
        tail = f", {DECIMALS}"
        if found.start() >= start and inner.endswith(tail):
            value = inner[: -len(tail)]
            out += [sql[start : found.start()], f"(round(({value}) + {NUDGE!r}::DOUBLE, {DECIMALS}) + 0)"]
            start = end
    return "".join([*out, sql[start:]])


def with_views(sql: str) -> str:
    """Put the input views that a statement uses, and those they use, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    body = sql.strip()
    own = re.match(r"WITH\s+", body, re.IGNORECASE)
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in needed]
    if not parts:
        return body
    if own:
        return "WITH " + ",\n".join(parts) + ",\n" + body[own.end():]
    return "WITH " + ",\n".join(parts) + "\n" + body


def comparable(df: DataFrame) -> DataFrame:
    """Types both engines agree on: whole numbers as bigint, rounded doubles, times without zone."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), DECIMALS) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampType, T.DateType)):
            c = c.cast("timestamp_ntz")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Fewer digits, for values whose sixth digit depends on the order of summation."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    # The tables carry wall-clock times without a zone; read as UTC they have no clock changes.
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return comparable(QUERIES[name].build(Inputs(spark, folder)))
