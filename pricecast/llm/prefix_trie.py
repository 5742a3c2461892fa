"""A prefix trie of conversations, its subtree totals found by time-forward processing.

**Paths.** Turns are sorted by range partitioning, so a conversation of any length is spread over tasks; what a task needs of
the rows before it is carried from the last row of the tasks before (one row per partition). The key of a prefix is a polynomial
of its turns' digests modulo the prime 2^127 - 1, so keys of parts of a conversation can be joined to the key of the whole.
Rows of equal key are one node.

**Regions.** A node's class is the number of hexadecimal digits of its number of members, its band its depth / 64. A
region is a connected part of the trie of equal class and band; it has fewer than 16 nodes on each level, so at most 1024.
Classes fall and bands grow along a path, so a region's top is the first row with its class and band on the path of any
member.

**Totals.** Regions are dealt to shards. A shard's nodes are sorted in reverse level order (by Spark's external sort) and
processed in that order: a node takes the messages that wait for it in a priority queue, adds its own values and sends the sum
to its parent in the queue, unless it is the top of its region. The queue holds a fixed number of messages in memory and spills
sorted runs to the folder that Spark gives its tasks for spilling. This gives totals of regions. Regions
without others below them are done; all others are the nodes of a smaller trie, which is solved in the same way with coarser
classes and bands, or in one shard when it has at most ``single_shard`` nodes. A second pass over the shards of the
nodes, with the totals of the regions that hang below as first messages, gives the totals of all nodes.

**Ends.** Lists of conversations that end at a node are joined to text in pieces of 4,096 ids, and the pieces
hashed in order.

Memory in a task: one Arrow batch and ``queue_limit`` messages.

Defined results: rows with a null conv_id take no part; null roles and texts are empty; turns of equal number are ordered
by role and text, a null number comes first; repeated rows are turns each; a conversation whose base is absent loses its first
turns, and may have none; an empty table gives no nodes (and no root); other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast.sources.scratch import settle

# Fixed by the data contract.
HEADS_OF = 20
GREATEST_HEAD = 3
WORD = r"[^\x20\x09-\x0D]+"

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:16]) % PRIME
KEY = ["key1", "key2"]
UP = ["up1", "up2"]
TOP = ["top1", "top2"]

NUMBERED = "part int, conv_id long, i long, digest binary, words long"
LOCAL = "part int, conv_id long, depth long, key1 long, key2 long, up1 long, up2 long, words long"
TOTALS = "key1 long, key2 long, leaves long, saved long"

LEVEL_BITS = 6
"""A band has 2 ** LEVEL_BITS levels."""


def halves(key: int) -> tuple[int, int]:
    return key >> 64, (key & (1 << 64) - 1) - (1 << 63)


def whole(key1: int, key2: int) -> int:
    return (key1 << 64) + key2 + (1 << 63)


ROOT = halves(0)


def ordered(rows: DataFrame, *order: str | Column) -> DataFrame:
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def indexed(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, i (from 1, in the order of turns), digest of role and text, words of the text."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    # The last column only tells equal rows apart, so that any number of them can be dealt to several tasks.
    given = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"), F.monotonically_increasing_id().alias("tie")
    ).where("conv_id IS NOT NULL")
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256), 1, 32))
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    sorted_ = ordered(given, "conv_id", F.col("turn").asc_nulls_first(), "role", "text", "tie").select("conv_id", digest.alias("digest"), words.alias("words"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, i = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            rows = []
            for c, d, w in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                i = i + 1 if c == now else 1
                now = c
                rows.append((part, c, i, d, w))
            yield batch_of(NUMBERED, rows)

    numbered = settle(sorted_.mapInArrow(number, NUMBERED))
    before, conv, n = [], None, 0
    for part, first, (last, i) in sorted(numbered.groupBy("part").agg(F.min("conv_id"), F.max(F.struct("conv_id", "i"))).collect()):
        if first == conv:
            before.append((part, first, n))
        conv, n = last, i + (n if first == conv == last else 0)
    carried = F.broadcast(numbered.sparkSession.createDataFrame(before, "part int, conv_id long, before long"))
    return numbered.join(carried, ["part", "conv_id"], "left").select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "digest", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, ``place`` (its order), digest, words: the first turns of the base, then the conversation's own."""
    head = F.crc32(F.col("conv_id").cast("string")) % (GREATEST_HEAD + 1)
    own = turns.where(F.col("i") > head).select("conv_id", F.col("i").alias("place"), "digest", "words")
    heads = turns.where((F.col("i") <= GREATEST_HEAD) & (F.col("conv_id") % HEADS_OF == 0)).withColumnRenamed("conv_id", "base")
    convs = turns.where("i = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % HEADS_OF).alias("base"), head.alias("head"))
    begun = convs.join(heads, "base").where(F.col("i") <= F.col("head"))
    return own.unionByName(begun.select("conv_id", (F.col("i") - GREATEST_HEAD - 1).alias("place"), "digest", "words"))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), key, key of the parent, words: one row per conversation and turn."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, depth, key = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            rows = []
            for c, d, w in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if c != now:
                    now, depth, key = c, 0, 0
                up, depth = key, depth + 1
                key = (key * BASE + int.from_bytes(d)) % PRIME
                rows.append((part, c, depth, *halves(key), *halves(up), w))
            yield batch_of(LOCAL, rows)

    local = settle(ordered(turns, "conv_id", "place").select("conv_id", "digest", "words").mapInArrow(prefixes, LOCAL))
    # A conversation that goes on from one partition to the next: what the next one needs of it.
    last = F.max(F.struct("conv_id", "depth", *KEY))
    before, conv, depth, key = {}, None, 0, 0
    for part, first, end in sorted(local.groupBy("part").agg(F.min("conv_id"), last).collect()):
        if first == conv:
            before[part] = (first, depth, key)
        if first == conv == end[0]:
            depth, key = depth + end[1], (key * pow(BASE, end[1], PRIME) + whole(*end[2:])) % PRIME
        else:
            conv, depth, key = end[0], end[1], whole(*end[2:])
    if not before:
        return local.drop("part")

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, c, d, k1, k2, u1, u2, w in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                _, depth, key = before[part]
                power = pow(BASE, d - 1, PRIME)
                up = (key * power + whole(u1, u2)) % PRIME
                key = (key * power * BASE + whole(k1, k2)) % PRIME
                rows.append((part, c, depth + d, *halves(key), *halves(up), w))
            yield batch_of(LOCAL, rows)

    # One row per partition at most.
    carried = F.broadcast(local.sparkSession.createDataFrame([(p, c) for p, (c, _, _) in before.items()], "part int, conv_id long"))
    going_on = settle(local.join(carried, ["part", "conv_id"], "left_semi").select(*local.columns).mapInArrow(go_on, LOCAL))
    return local.join(carried, ["part", "conv_id"], "left_anti").unionByName(going_on).drop("part")


class SpillingQueue:
    """A priority queue of messages (order, key1, key2, leaves, saved); of more than ``limit``, sorted runs are spilled."""

    RECORD = struct.Struct("<5q")

    def __init__(self, limit: int):
        self.limit = limit
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []
        self.spilled = 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self.spill()

    def spill(self) -> None:
        self.heap.sort()
        # A file without a name, in the folder that Spark's own spills of this task are in; it ends with the task.
        file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        file.writelines(self.RECORD.pack(*m) for m in self.heap)
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                while block := file.read(self.RECORD.size * 1024):
                    yield from self.RECORD.iter_unpack(block)

        run = read()
        heapq.heappush(self.runs, (next(run), self.spilled, run))
        self.heap = []
        self.spilled += 1

    def take(self, order: int, key1: int, key2: int) -> tuple[int, int]:
        """Sums of the messages that wait for this node; all with an earlier one have been taken."""
        me, leaves, saved = (order, key1, key2), 0, 0
        while self.heap and self.heap[0][:3] == me:
            m = heapq.heappop(self.heap)
            leaves, saved = leaves + m[3], saved + m[4]
        while self.runs and self.runs[0][0][:3] == me:
            m, n, run = self.runs[0]
            leaves, saved = leaves + m[3], saved + m[4]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, n, run))
        return leaves, saved


def time_forward(nodes: DataFrame, queue_limit: int, one_shard: bool = False) -> DataFrame:
    """Totals over the part of each node's subtree that lies in its region; in one shard, regions do not count."""
    dealt = nodes.coalesce(1) if one_shard else nodes.repartition(*TOP)
    columns = ["depth", *KEY, "up_depth", *UP, *TOP, "leaves", "saved"]
    sorted_ = dealt.select(*columns).sortWithinPartitions(F.col("depth").desc(), *KEY)

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(queue_limit)
        for batch in batches:
            rows = []
            for depth, k1, k2, up_depth, u1, u2, t1, t2, leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = queue.take(-depth, k1, k2)
                leaves, saved = leaves + more[0], saved + more[1]
                if depth and (one_shard or (k1, k2) != (t1, t2)):
                    queue.push((-up_depth, u1, u2, leaves, saved))
                rows.append((k1, k2, leaves, saved))
            yield batch_of(TOTALS, rows)
        if queue.heap or queue.runs:
            raise AssertionError("a message has no node to go to")

    return sorted_.mapInArrow(process, TOTALS)


def band(level: int, depth: str = "depth") -> Column:
    return F.shiftright(F.col(depth), LEVEL_BITS * level)


def size_class(level: int, n: str = "n_convs") -> Column:
    """Hexadecimal digits less one, halved for each further level."""
    return F.shiftright(F.length(F.hex(n)) - 1, level - 1)


def with_tops(nodes: DataFrame, walk: DataFrame, level: int, root_class: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with the top of their region, and the regions on the paths of conversations in the form of ``walk``.

    ``walk`` has conv_id, depth, key and n_convs of nodes on the paths of conversations, without the root.
    """
    of = {"band": band(level), "class": size_class(level)}
    first = F.min(F.struct("depth", *KEY, "n_convs")).alias("first")
    passed = settle(walk.withColumns(of).groupBy("conv_id", "band", "class").agg(first))
    # What is of the root's band and class is in its region.
    in_root = (F.col("band") == 0) & (F.col("class") == root_class >> (level - 1))
    tops = passed.select(
        "conv_id",
        "band",
        "class",
        F.when(in_root, 0).otherwise(F.col("first.depth")).alias("top_depth"),
        *[F.when(in_root, r).otherwise(F.col(f"first.{k}")).alias(t) for k, t, r in zip(KEY, TOP, ROOT, strict=True)],
    )
    below = nodes.where("depth > 0").withColumns(of).join(tops, ["conv_id", "band", "class"]).drop("band", "class")
    root = nodes.where("depth = 0").withColumns({"top_depth": F.col("depth")} | {t: F.col(k) for k, t in zip(KEY, TOP, strict=True)})
    return below.unionByName(root), passed.select("conv_id", "first.*")


def totals(nodes: DataFrame, walk: DataFrame, root_class: int, level: int, single_shard: int, queue_limit: int) -> DataFrame:
    """key, leaves, saved: sums over the whole subtrees of nodes with depth, key, up_depth, up, conv_id, n_convs, leaves, saved."""
    if level > 1 and nodes.count() <= single_shard:
        return time_forward(nodes.withColumns({t: F.lit(r) for t, r in zip(TOP, ROOT, strict=True)}), queue_limit, one_shard=True)
    topped, walk = with_tops(nodes, walk, level, root_class)
    topped = settle(topped)
    local = settle(time_forward(topped, queue_limit))
    is_top = (F.col("key1") == F.col("top1")) & (F.col("key2") == F.col("top2"))
    tops = topped.where(is_top).drop("leaves", "saved", *TOP, "top_depth").join(local, KEY)
    # A region hangs below the node ``up``, which is in the region ``upper``.
    above = topped.select(*[F.col(k).alias(u) for k, u in zip(KEY, UP, strict=True)], *[F.col(t).alias(f"upper{i}") for i, t in enumerate(TOP, 1)], F.col("top_depth").alias("upper_depth"))
    hanging = settle(tops.where("depth > 0").join(above, UP))
    if hanging.isEmpty():
        return local
    upper = [F.col(f"upper{i}").alias(k) for i, k in enumerate(KEY, 1)]
    inner = hanging.select(*upper).distinct()
    done = hanging.join(inner, KEY, "left_anti")
    more = done.groupBy(*upper).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    places = hanging.select(*KEY, *[F.col(f"upper{i}").alias(u) for i, u in enumerate(UP, 1)], F.col("upper_depth").alias("up_depth"))
    smaller = tops.drop("up_depth", *UP).join(inner, KEY, "left_semi").join(places, KEY, "left").join(more, KEY, "left")
    own = {"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}
    smaller = settle(smaller.withColumns(own).drop("l", "s"))
    full = totals(smaller, walk, root_class, level + 1, single_shard, queue_limit).unionByName(done.select(*KEY, "leaves", "saved"))
    sent = hanging.select(*KEY, *UP).join(full, KEY).groupBy(*[F.col(u).alias(k) for u, k in zip(UP, KEY, strict=True)])
    sent = sent.agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    return time_forward(topped.join(sent, KEY, "left").withColumns(own), queue_limit)


def digests(ends: DataFrame, piece: int = 4096) -> DataFrame:
    """key, ends_sha256 of the ids, ascending and joined by commas, for each key of ``ends`` (conv_id, key)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = "key1 long, key2 long, first long, text string"
        now, held = None, []
        for batch in batches:
            rows = []
            for key1, key2, c in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if (key1, key2) != now or len(held) == piece:
                    if held:
                        rows.append((*now, held[0], ",".join(map(str, held))))
                    now, held = (key1, key2), []
                held.append(c)
            yield batch_of(schema, rows)
        if held:
            yield batch_of(schema, [(*now, held[0], ",".join(map(str, held)))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = "key1 long, key2 long, ends_sha256 string"
        now, state = None, hashlib.sha256()
        for batch in batches:
            rows = []
            for key1, key2, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if (key1, key2) != now:
                    if now is not None:
                        rows.append((*now, state.hexdigest()))
                    now, state = (key1, key2), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield batch_of(schema, rows)
        if now is not None:
            yield batch_of(schema, [(*now, state.hexdigest())])

    joined = ordered(ends.select(*KEY, "conv_id"), *KEY, "conv_id").mapInArrow(join, "key1 long, key2 long, first long, text string")
    dealt = joined.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "text")
    return dealt.mapInArrow(hashed, "key1 long, key2 long, ends_sha256 string")


def trie(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    single_shard: int = 100_000,
    queue_limit: int = 200_000,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    turns = indexed(conversations, conv_id, turn, role, text)
    convs = turns.where("i = 1").select("conv_id")
    n, smallest = convs.agg(F.count("*"), F.min("conv_id")).first()
    path = paths(rebuilt(turns))
    grouped = path.groupBy(*KEY).agg(
        F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in (*UP, "words")]
    )
    root = spark.createDataFrame([(*ROOT, 0, n, smallest, None, None, 0)] if n else [], "key1 long, key2 long, depth long, n_convs long, conv_id long, up1 long, up2 long, words long")
    nodes = settle(grouped.unionByName(root))

    children = nodes.where("depth > 0").groupBy(*[F.col(u).alias(k) for u, k in zip(UP, KEY, strict=True)]).agg(F.count("*").alias("n_children"))
    parents = nodes.select(*[F.col(k).alias(u) for k, u in zip(KEY, UP, strict=True)], F.col("conv_id").alias("parent_conv_id"))
    # The root may have very many children; their parent's name needs no join.
    below_root = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(smallest).cast("long")))
    named = nodes.where("depth > 1").join(parents, UP).unionByName(below_root).join(children, KEY, "left")
    valued = settle(
        named.withColumns(
            {
                "n_children": F.coalesce("n_children", F.lit(0).cast("long")),
                "leaves": F.col("n_children").isNull().cast("long"),
                "saved": (F.col("n_convs") - 1) * F.col("words"),
                "up_depth": F.col("depth") - 1,
            }
        )
    )
    walk = path.select("conv_id", "depth", *KEY).join(nodes.select(*KEY, "n_convs"), KEY)
    root_class = len(f"{n:x}") - 1
    summed = totals(valued.select("depth", *KEY, "up_depth", *UP, "conv_id", "n_convs", "leaves", "saved"), walk, root_class, 1, single_shard, queue_limit)

    last = path.groupBy("conv_id").agg(F.max(F.struct("depth", *KEY)).alias("last"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"last.{k}"), F.lit(r)).alias(k) for k, r in zip(KEY, ROOT, strict=True)])
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        valued.drop("leaves", "saved").join(summed, KEY).join(digests(ends), KEY, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )
