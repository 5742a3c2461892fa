"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in an order drawn from a hash, are cut into blocks of ``block`` documents. Time runs in slots
of one block. Block i (from 0) of a source with weight w is released at floor(i / w) and due at ceil((i + 1) / w); in
each slot the released block that is due first goes out. With weights that add up to one every block meets its
deadline, so after any number of slots each source is less than one block away from its target.

Weights are brought to whole shares of ``cycle`` slots (largest remainders, at least one each), that is to four digits
by default, and the bound holds for these. So the schedule repeats: it is worked out once for one cycle, a table of ``cycle`` rows (four per source, if that is more), and the
place of any block follows by division. Weights are a setting: there is one per source, and they are held on the
driver, a few numbers each.

Nothing is dropped: the mixture ends with the slot in which the last source has given all its documents, and
sources that are through begin again (another epoch). Ranks inside a source come from counts of hash buckets and
windows inside a bucket, so a source with a third of all rows is spread over many tasks.

Defined results: a null source is a source of its own; without target weights each source weighs its number of
documents to the power ``temperature``; if weights are given, a source of the table without one is an error, and weights
must be positive; repeated rows are documents each; rows of equal hash are ordered by id and text; an empty table
gives an empty one; all columns are kept.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricecast.llm.common import free_name
from pricecast.sources.scratch import settle


def shares(weights: dict[str | None, float], cycle: int) -> dict[str | None, int]:
    """Slots of a cycle for each source, at least one; the cycle is stretched for very many sources."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    cycle = max(cycle, 4 * len(weights))
    total = sum(weights.values())
    wanted = {s: cycle * w / total for s, w in weights.items()}
    slots = {s: max(1, int(w)) for s, w in wanted.items()}
    # What is missing goes to the largest remainders; what is too much comes from the largest shares.
    by_rest = sorted(weights, key=lambda s: (int(wanted[s]) - wanted[s], s is not None, s or ""))
    for i in range(cycle - sum(slots.values())):
        slots[by_rest[i % len(by_rest)]] += 1
    for _ in range(sum(slots.values()) - cycle):
        slots[max(slots, key=lambda s: (slots[s], s is not None, s or ""))] -= 1
    return slots


def schedule(slots: dict[str | None, int]) -> list[str | None]:
    """The source of each slot of a cycle: earliest deadline first among the released blocks."""
    cycle = sum(slots.values())
    order = sorted(slots, key=lambda s: (s is not None, s or ""))
    released: list[list[tuple[int, int]]] = [[] for _ in range(cycle)]
    for k, s in enumerate(order):
        for i in range(slots[s]):
            released[i * cycle // slots[s]].append((-(-(i + 1) * cycle // slots[s]), k))
    ready: list[tuple[int, int]] = []
    out = []
    for t in range(cycle):
        for job in released[t]:
            heapq.heappush(ready, job)
        due, k = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block misses its deadline")
        out.append(order[k])
    return out


def tempered(counts: dict[str | None, int], temperature: float) -> dict[str | None, float]:
    return {s: n**temperature for s, n in counts.items()}


def ranked(docs: DataFrame, source: str, doc_id: str, text: str, rows_per_bucket: int) -> tuple[DataFrame, dict]:
    """The documents with ``_rank`` from 0 inside their source, and the size of each source."""
    n = docs.count()
    buckets = max(1, math.ceil(n / rows_per_bucket))
    hashed = docs.withColumn("_hash", F.xxhash64(F.lit("mix"), F.col(doc_id), F.col(text)))
    hashed = hashed.withColumn("_bucket", F.floor((F.col("_hash").cast("double") / 2.0**64 + 0.5) * buckets).cast("long"))
    # Bucket numbers grow with the hash, so buckets are runs of the order inside a source.
    sizes = settle(hashed.groupBy(F.col(source).alias("_source"), "_bucket").agg(F.count("*").alias("_n")))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_source", F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(source, "_bucket").orderBy("_hash", doc_id, text)) - 1
    joined = hashed.withColumn("_place", place).join(
        offsets, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")), "left"
    )
    counts = {r._source: r.n for r in sizes.groupBy("_source").agg(F.sum("_n").alias("n")).collect()}
    return joined.withColumn("_rank", F.col("_before") + F.col("_place")).drop("_hash", "_bucket", "_place", "_source", "_b", "_before"), counts


def mixed(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    block: int = 64,
    temperature: float = 0.8,
    cycle: int = 10_000,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    rows_per_bucket: int = 2000,
) -> DataFrame:
    """All columns and ``position``, ``slot``, ``epoch``: one row for each time a document is given out."""
    spark = docs.sparkSession
    added = [free_name(docs.columns, c) for c in ("position", "slot", "epoch")]
    placed, counts = ranked(docs, source, doc_id, text, rows_per_bucket)
    if not counts:
        return docs.withColumns({c: F.lit(0).cast("long") for c in added}).limit(0)
    given = tempered(counts, temperature) if weights is None else {s: w for s, w in weights.items() if s in counts}
    if missing := [s for s in counts if s not in given]:
        raise ValueError(f"no target weight for {missing[:5]}")
    slots = shares(given, cycle)
    order = schedule(slots)
    cycle = len(order)
    where: dict[str | None, list[int]] = {s: [] for s in slots}
    for t, s in enumerate(order):
        where[s].append(t)

    def slot_of(s: str | None, i: int) -> int:
        return i // slots[s] * cycle + where[s][i % slots[s]]

    length = 1 + max(slot_of(s, math.ceil(n / block) - 1) for s, n in counts.items())
    # Blocks that fall into the mixture: whole cycles and what the last one has.
    blocks = {s: length // cycle * slots[s] + sum(t < length % cycle for t in where[s]) for s in slots}
    rows = [(s, counts[s], blocks[s] * block, slots[s], where[s]) for s in slots]
    plan = spark.createDataFrame(rows, "_source string, _size long, _wanted long, _slots long, _where array<int>")
    # At most one row per source, with the slots of one cycle in all.
    out = placed.withColumn("_key", F.col(source).cast("string")).join(F.broadcast(plan), F.col("_key").eqNullSafe(F.col("_source")))
    out = out.withColumn("_at", F.explode(F.sequence(F.col("_rank"), F.col("_wanted") - 1, F.col("_size"))))
    number = F.floor(F.col("_at") / block)
    slot = F.floor(number / F.col("_slots")) * cycle + F.get("_where", (number % F.col("_slots")).cast("int"))
    out = out.withColumn("_slot", slot.cast("long"))
    return out.select(
        *docs.columns,
        (F.col("_slot") * block + F.col("_at") % block).alias(added[0]),
        F.col("_slot").alias(added[1]),
        F.floor(F.col("_at") / F.col("_size")).cast("long").alias(added[2]),
    )


def in_order(mixture: DataFrame, columns: list[str]) -> DataFrame:
    """The mixture as it is to be read: files in order of position, sorted inside."""
    return mixture.repartitionByRange("position").sortWithinPartitions("position").select(*columns)
