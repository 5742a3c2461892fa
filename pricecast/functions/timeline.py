"""Ordered operations on long series, split by time so that no series has to fit one task.

A plain ``Window.partitionBy(key)`` sorts a whole series in one task. Here every
series is cut into time chunks; a chunk gets what it
needs from its past either as a one-row summary per earlier chunk (fills) or as
copies of the rows just before it (trailing windows, lags). Results
are those of the unsplit window.

Chunks have a fixed length in time, made for hourly rows. Where that would put too many rows of a key into one chunk
(``Chunks.by_count``), the chunk is cut again at quantiles of its own times, found from counts, so that a series that
is dense in one day is many tasks as well. Rows of one key and one time stay together. A trailing window is cut no
finer than its own length: the rows of one frame have to meet.

Contract: key columns are not null, and ``ts`` orders the rows of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricecast.functions import arrays
from pricecast.sources.scratch import Settle, as_is

MICROS = 1_000_000
HOUR = 3600
DAY = 24 * HOUR
CHUNK_SECONDS = 90 * DAY
# Blocks and chunks are this many look-backs long: about 1/64 of the rows are copied.
BLOCK_LOOKBACKS = 64


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


# What one task may well sort; cuts for more rows than this times MOST_CUTS are made for fewer, larger chunks.
ROWS_PER_CHUNK = 1_000_000
MOST_CUTS = 1_000_000
MOST_PIECES = 4096


@dataclass(frozen=True)
class Chunks:
    """Time chunks of ``seconds``; ``cuts`` has the keys, ``_coarse`` and ``_cuts`` (times, rising) of dense ones."""

    seconds: int
    cuts: DataFrame | None = None

    @staticmethod
    def by_count(
        df: DataFrame,
        keys: Sequence[str],
        ts: str,
        settle: Settle | None,
        rows: int | None = None,
        seconds: int = CHUNK_SECONDS,
    ) -> Chunks:
        """Chunks of at most about ``rows`` rows: counts by key and chunk, then quantiles of the times in dense chunks.

        Without a way to settle them (``None``, or ``as_is``, which keeps one lazy plan), chunks are of fixed length.
        Cuts are settled: every branch of a plan has to see the same ones. There is at most one per ``rows`` rows
        and at most MOST_CUTS in all, so they can be sent to all tasks.
        """
        if settle in (None, as_is):
            return Chunks(seconds)
        rows = rows or ROWS_PER_CHUNK
        placed = Chunks(seconds).place(df.select(*keys, ts), keys, ts).withColumnRenamed("_chunk", "_coarse")
        local = [*keys, "_coarse"]
        sizes = placed.groupBy(*local).agg(F.count(F.lit(1)).alias("_n"))
        most, total = sizes.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
        rows = max(rows, -(-total // MOST_CUTS))
        if most <= rows:
            return Chunks(seconds)
        pieces = min(MOST_PIECES, -(-most // rows))
        steps = [i / pieces for i in range(1, pieces)]
        dense = placed.join(F.broadcast(sizes.where(F.col("_n") > rows).select(*local)), local, "left_semi")
        found = dense.groupBy(*local).agg(F.percentile_approx("_t", steps, 10 * pieces).alias("_all"), F.count(F.lit(1)).alias("_n"))
        # A chunk with fewer rows takes every second, third … cut.
        stride = F.greatest(F.lit(1), F.floor(F.lit(pieces * rows) / F.col("_n")))
        cuts = F.array_distinct(F.filter("_all", lambda c, i: (i + 1) % stride == 0))
        return Chunks(seconds, settle(found.select(*local, cuts.alias("_cuts"))))

    def place(self, df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
        """Add ``_t`` (microseconds) and ``_chunk``, which grows with the time."""
        t = micros(F.col(ts))
        coarse = F.floor(t / F.lit(self.seconds * MICROS))
        if self.cuts is None:
            return df.withColumns({"_t": t, "_chunk": coarse})
        placed = df.withColumns({"_t": t, "_coarse": coarse}).join(F.broadcast(self.cuts), [*keys, "_coarse"], "left")
        inside = F.coalesce(arrays.count_below(F.col("_cuts"), F.col("_t"), MOST_PIECES), F.lit(0))
        return placed.select(*df.columns, "_t", (F.col("_coarse") * MOST_PIECES + inside).alias("_chunk"))


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    forward: bool = True,
    backward: bool = True,
    chunk_seconds: int = CHUNK_SECONDS,
    strict: bool = False,
    times: bool = False,
    chunks: Chunks | None = None,
) -> DataFrame:
    """Add the closest non-null value before (``prev_*``) and after (``next_*``), with ``times`` also when.

    A row counts as its own neighbour unless ``strict``. Within a chunk this is a window; across chunks
    the first and last values of each chunk are carried over.
    """
    base = (chunks or Chunks(chunk_seconds)).place(df, keys, ts)
    local = [*keys, "_chunk"]

    def up_to(ordered):
        # A range frame takes in all rows of the same time.
        return ordered.rowsBetween(W.unboundedPreceding, -1) if strict else ordered.rangeBetween(W.unboundedPreceding, 0)

    up = up_to(W.partitionBy(*local).orderBy("_t"))
    # Descending order instead of a frame to the end: the latter costs n² in Spark.
    down = up_to(W.partitionBy(*local).orderBy(F.desc("_t")))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)

    edges, carried, inside, final = [], [], {}, []
    for side, wanted, pick, pick_t, window, across in (
        ("prev", forward, F.max_by, F.max, up, earlier),
        ("next", backward, F.min_by, F.min, down, later),
    ):
        for c in cols if wanted else ():
            seen = F.when(F.col(c).isNotNull(), F.col("_t"))
            parts = {f"{side}_{c}": (F.col(c), pick(F.col(c), seen))}
            if times:
                parts[f"{side}_{c}_at"] = (seen, pick_t(seen))
            for name, (value, at_edge) in parts.items():
                edges.append(at_edge.alias(f"_edge_{name}"))
                carried.append(F.last(f"_edge_{name}", ignorenulls=True).over(across).alias(f"_carry_{name}"))
                inside[name] = F.last(value, ignorenulls=True).over(window)
                final.append(F.coalesce(name, f"_carry_{name}").alias(name))
    carry = base.groupBy(*local).agg(*edges).select(*local, *carried)
    wide = base.withColumns(inside).join(carry, local, "left")
    return wide.select(*df.columns, "_t", *final)


def fill(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    order: Sequence[str] = ("forward",),
    chunk_seconds: int = CHUNK_SECONDS,
    chunks: Chunks | None = None,
) -> DataFrame:
    """Fill nulls from the same series: each direction in turn, as listed in ``order``."""
    side = {"forward": "prev", "backward": "next"}
    near = neighbours(
        df, keys, ts, cols, "forward" in order, "backward" in order, chunk_seconds=chunk_seconds, chunks=chunks
    )
    filled = {c: F.coalesce(*[F.col(f"{side[o]}_{c}") for o in order]) for c in cols}
    return near.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def interpolate(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    chunk_seconds: int = CHUNK_SECONDS,
    chunks: Chunks | None = None,
) -> DataFrame:
    """Time-weighted linear interpolation; leading nulls stay, trailing nulls repeat the last value."""
    near = neighbours(df, keys, ts, cols, chunk_seconds=chunk_seconds, times=True, chunks=chunks)

    def blend(c: str) -> Column:
        before, after = F.col(f"prev_{c}"), F.col(f"next_{c}")
        start, end = F.col(f"prev_{c}_at"), F.col(f"next_{c}_at")
        share = (F.col("_t") - start) / F.nullif(end - start, F.lit(0))
        return (
            F.when(F.col(c).isNotNull() | before.isNull(), F.col(c))
            .when(after.isNull(), before)
            .otherwise(before + (after - before) * share)
        )

    return near.select(*[blend(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    exprs: dict[str, tuple[int, Callable[[], Column]]],
    settle: Settle | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Aggregates over (t − seconds, t]: ``{name: (seconds, lambda: F.avg("price"))}``.

    Rows near the end of a block are copied to the next block, which drops them again. With ``settle``, blocks are
    counted first, and one of more than ``rows`` rows is cut into blocks as long as the longest window.
    """
    reach = max(seconds for seconds, _ in exprs.values()) * MICROS
    # Blocks are numbered by the time of their last look-back.
    step = F.floor(micros(F.col(ts)) / F.lit(reach))
    placed = df.withColumns({"_t": micros(F.col(ts)), "_step": step, "_coarse": F.floor(step / F.lit(BLOCK_LOOKBACKS))})
    dense = None
    if settle not in (None, as_is):
        sizes = placed.groupBy(*keys, "_coarse").agg(F.count(F.lit(1)).alias("_n"))
        dense = settle(sizes.where(F.col("_n") > (rows or ROWS_PER_CHUNK)).select(*keys, "_coarse", F.lit(True).alias("_dense")))
        # No more rows than the table has dense blocks; where there are very many, the join is left to their size.
        placed = placed.join(dense, [*keys, "_coarse"], "left")
    last = (F.col("_coarse") + 1) * BLOCK_LOOKBACKS - 1
    placed = placed.withColumn("_home", F.when(F.col("_dense"), F.col("_step")).otherwise(last) if dense is not None else last)
    near_end = F.col("_step") == F.col("_home")
    first_of_next = F.col("_home") + 1
    if dense is not None:
        # The next block, in the same coarse one or not, ends with its first look-back only if it is dense itself.
        ahead = dense.select(*keys, (F.col("_coarse") - 1).alias("_coarse"), F.col("_dense").alias("_next_dense"))
        placed = placed.join(ahead, [*keys, "_coarse"], "left")
        inside = F.col("_dense") & (F.col("_step") < last)
        next_block = F.when(inside | F.col("_next_dense"), first_of_next).otherwise(last + BLOCK_LOOKBACKS)
    else:
        next_block = last + BLOCK_LOOKBACKS
    own = F.col("_home")
    copied = placed.withColumn("_block", F.explode(F.when(near_end, F.array(own, next_block)).otherwise(F.array(own))))

    def frame(seconds: int):
        w = W.partitionBy(*keys, "_block").orderBy("_t")
        return w.rangeBetween(-seconds * MICROS + 1, 0)

    found = copied.withColumns({name: agg().over(frame(sec)) for name, (sec, agg) in exprs.items()})
    return found.where("_block = _home").select(*df.columns, *exprs)


def row_windows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    rows_back: int,
    exprs: Callable[[Callable], dict[str, Column]],
    columns: Sequence[str],
    ties: Sequence[str] = (),
    step_seconds: int = HOUR,
    chunk_seconds: int | None = None,
    settle: Settle | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Lags and row frames that look at most ``rows_back`` rows back, over ``columns``.

    ``exprs`` gets a function ``w``: ``w()`` is the ordered window for ``lag``, ``w(n)`` its frame of
    the current and the n − 1 rows before it.

    Each chunk is preceded by the last rows of the chunks before it: the rows themselves are
    shuffled once, and only ``rows_back`` rows of each chunk travel again. ``step_seconds`` is the usual
    distance of rows: it sets the length of chunks, so that these copies stay few. With ``settle``, chunks of more than
    ``rows`` rows (or 64 times ``rows_back``, if that is more) are cut by their counts.
    """
    length = chunk_seconds or max(CHUNK_SECONDS, BLOCK_LOOKBACKS * rows_back * step_seconds)
    chunks = Chunks.by_count(df, keys, ts, settle, max(rows or ROWS_PER_CHUNK, BLOCK_LOOKBACKS * rows_back), length)
    base = chunks.place(df, keys, ts)
    local = [*keys, "_chunk"]
    used = list(dict.fromkeys([*keys, "_t", "_chunk", *ties, *columns]))
    latest_first = W.partitionBy(*local).orderBy(F.desc("_t"), *[F.desc(c) for c in ties])
    # Spark keeps only the wanted rows of each chunk before this shuffle.
    tails = (
        base.select(*used).withColumn("_r", F.row_number().over(latest_first)).where(F.col("_r") <= rows_back).drop("_r")
    )
    # Which earlier chunks hold the last rows before a chunk: known from the sizes of the chunks alone.
    series = W.partitionBy(*keys)
    by_end = series.orderBy("_end")
    sizes = base.groupBy(*local).agg(F.least(F.count(F.lit(1)), F.lit(rows_back)).alias("_n"))
    sources = (
        sizes.withColumn("_end", F.sum("_n").over(series.orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_sources", F.collect_list("_chunk").over(by_end.rangeBetween(-(rows_back - 1), 0)))
        .withColumn("_into", F.lead("_chunk").over(by_end))
        .where("_into is not null")
        .select(*keys, "_into", F.explode("_sources").alias("_chunk"))
    )
    brought = tails.join(sources, local).drop("_chunk").withColumnRenamed("_into", "_chunk")
    line = base.withColumn("_own", F.lit(True)).unionByName(
        brought.withColumn("_own", F.lit(False)), allowMissingColumns=True
    )
    ordered = W.partitionBy(*local).orderBy("_t", *ties)

    def w(rows: int | None = None):
        return ordered if rows is None else ordered.rowsBetween(-(rows - 1), 0)

    added = exprs(w)
    kept = [c for c in df.columns if c not in added]
    return line.withColumns(added).where("_own").select(*kept, *added)


def shift_rows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    shifts: dict[str, tuple[str, int]],
    ties: Sequence[str] = (),
    step_seconds: int = HOUR,
    settle: Settle | None = None,
) -> DataFrame:
    """``{new: (column, k)}``: the value k rows earlier in the series."""
    reach = max(k for _, k in shifts.values())
    columns = list(dict.fromkeys(c for c, _ in shifts.values()))

    def lagged(w):
        return {new: F.lag(c, k).over(w()) for new, (c, k) in shifts.items()}

    return row_windows(df, keys, ts, reach, lagged, columns, ties, step_seconds, settle=settle)
