"""Near duplicates by a chosen-path similarity join over minwise signatures.

A document is its set of word shingles. Documents with equal sets form one class, so copies cost one row however
many they are. Classes go down ``trees`` random trees: at a node one minwise coordinate (sometimes two, so that a pair at
the threshold expects one common child) is chosen, and the classes with the same minwise token there go to the same
child. A node with at most ``leaf`` classes is compared exhaustively by signature; larger nodes branch on. The
estimates only select candidates; each link that counts is confirmed on the full sets.

Groups of near copies do not fall apart by branching. Every ``hub_every`` levels above the last the large nodes therefore get hubs:
members of a bounded sample that agree most with those no hub covers yet. Each member is confirmed against the hub most
like it; nodes with one component left are closed, and pairs inside a component are not compared again. What is still large
at the last level is compared block by block. No pair is capped away.

First, each member of a node gives its most similar partner in another component, and of these the best one of each
component is confirmed; the links found unite components and close nodes. Then each node tells which of its components
hang together by candidates. The members that still have a candidate in another component meet once more, now with their
full sets: all those that hang together, over all nodes, in one place or block by block, or in the nodes again where that
is less. All their pairs are confirmed there, and a spanning forest of the links is the output. So what leaves a node is
linear in its members. Links inside a component cannot change the result.

A pair at the threshold survives six levels of a tree with probability 0.47 or more and is found by one of 16 trees
with probability over 0.999; the signature test (four standard errors) loses less than one in 10,000.

Shuffles carry (node, class) numbers; signatures travel only with classes that share a node, sets only with
candidates and with members that have some. Sets are 64-bit hashes of shingles.

Defined results: null and empty texts have no shingles and are linked with nothing; rows with a null id are linked
with nothing and kept; rows that repeat an id are judged each by its own text (classes have numbers of their own, ids
only name the results); an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricecast.llm.components import components
from pricecast.sources.scratch import passing, settle

CACHED = 400_000
U = np.uint64


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80
    """Least intersection in percent of the union."""
    coordinates: int = 64
    trees: int = 16
    leaf: int = 200
    first_level: int = 3
    """Levels that are taken at once: tokens shared by chance fill nodes above, more of them the more documents."""
    depth: int = 6
    hub_every: int = 3
    hub_sample: int = 128
    hubs: int = 16

    @property
    def least_estimate(self) -> float:
        j = self.percent / 100
        return j - 4 * math.sqrt(j * (1 - j) / self.coordinates)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = Hashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted set; ASCII letters fold, words end at the six white-space characters of ASCII."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(_hashes.__getitem__, words), U, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, U)
    for i in range(size):
        out = mixed(out * U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def seeds(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_01)
    n = settings.coordinates
    return draw.integers(0, 2**63, n, dtype=np.uint64), draw.integers(0, 2**63, n, dtype=np.uint64) | U(1)


def signatures(docs: DataFrame, settings: Settings, doc_id: str, text: str) -> DataFrame:
    """doc_id, a hash of the text, n, digest and signature of every document, in full and by its low bytes; null for an empty set.

    Low bytes agree by chance once in 256 times, which only lets a few more candidates through.
    """
    flip, times = seeds(settings)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, settings.shingle) for t in part["text"].to_pylist()]
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                signed = np.empty((len(some), settings.coordinates), np.uint32)
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    starts = np.r_[0, np.cumsum(n[some])[:-1]]
                    for k in range(settings.coordinates):
                        signed[:, k] = np.minimum.reduceat((flat ^ flip[k]) * times[k], starts) >> U(32)
                rows: list = [None] * len(sets)
                brief: list = [None] * len(sets)
                for i, s in zip(some, signed, strict=True):
                    rows[i], brief[i] = s.tobytes(), s.astype(np.uint8).tobytes()
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part["doc_id"], "text_hash": part["text_hash"], "n": n, "digest": pa.array(digests, pa.binary()), "sig": pa.array(rows, pa.binary()), "brief": pa.array(brief, pa.binary())}
                )

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return given.mapInArrow(sign, "doc_id long, text_hash long, n long, digest binary, sig binary, brief binary")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def children(nodes: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child nodes: one chosen coordinate, in a quarter of the nodes a second one."""
    width = sigs.shape[1]
    draw = mixed(nodes + U(0x632BE59BD9B4E019))
    first = (draw % U(width)).astype(np.int64)
    step = ((draw >> U(16)) % U(width - 1)).astype(np.int64) + 1
    twice = (draw >> U(60)) < U(4)
    rows = np.arange(len(nodes))
    found_rows, found = [], []
    for who, where in ((rows, first), (rows[twice], ((first + step) % width)[twice])):
        value = sigs[who, where].astype(U) | (where.astype(U) << U(32))
        found_rows.append(who)
        found.append(mixed(nodes[who] * U(0x9E3779B97F4A7C15) + mixed(value + U(1))))
    return np.concatenate(found_rows), np.concatenate(found)


def branched(rows: DataFrame, settings: Settings, levels: int) -> DataFrame:
    """node, id some levels below; rows without a column ``node`` start at the roots of all trees."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mixed(np.arange(1, settings.trees + 1, dtype=U))
        for batch in batches:
            sigs = matrix(batch["sig"], settings.coordinates)
            ids = batch["id"].to_numpy()
            if batch.schema.get_field_index("node") >= 0:
                starts = [batch["node"].to_numpy().view(U)]
            else:
                starts = [np.full(len(ids), root, U) for root in roots]
            for nodes in starts:
                who = np.arange(len(ids))
                for _ in range(levels):
                    now, nodes = children(nodes, sigs[who])
                    who = who[now]
                yield pa.RecordBatch.from_pydict({"node": nodes.view(np.int64), "id": ids[who]})

    return rows.mapInArrow(branch, "node long, id long")


def open_members(members: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Members of nodes that hold more than one component, with the size of the node and their component ``g``.

    Without ``components`` (id, g) every class is one of its own.
    """
    if components is None:
        sizes = members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        return members.join(sizes, "node")
    members = members.join(components, "id")
    sizes = members.groupBy("node").agg(F.count("*").alias("size"), F.min("g").alias("_low"), F.max("g").alias("_high"))
    return members.join(sizes.where("_low < _high").select("node", "size"), "node")


def by_node(rows: DataFrame) -> DataFrame:
    """Rows sorted by node, each node whole in one task.

    A shuffle by the node alone would be left out behind a join on it, and adaptive execution may deal out the rows of such
    a join anew.
    """
    return rows.repartition(F.xxhash64("node")).sortWithinPartitions("node")


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches sorted by key. A run is bounded by what was sorted in."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        keys = now[key].to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield now.slice(0, cut)
        rest = now.slice(cut)
    if rest is not None:
        yield rest


def best_partners(key: np.ndarray, t: pa.Table, settings: Settings) -> pa.RecordBatch:
    """Of each row that has candidates in other components, the most similar one.

    ``root`` is the least of the components in the node that hang together with its own by candidates.
    """
    ids, g, n = t["id"].to_numpy(), t["g"].to_numpy(), t["n"].to_numpy()
    brief = t["brief"].combine_chunks().to_pylist()
    sigs = np.frombuffer(b"".join(brief), np.uint8).reshape(-1, settings.coordinates)
    # Of each member so far: how alike its best partner is, and which row that is.
    top, partner = np.zeros(len(ids)), np.full(len(ids), -1)
    # Components of a node are numbered in the order of ``g``; ``low`` leads each to a smaller one it hangs together with.
    order = np.lexsort((g, key))
    vertex = np.empty(len(ids), np.int64)
    vertex[order] = np.cumsum(np.r_[False, (key[order][1:] != key[order][:-1]) | (g[order][1:] != g[order][:-1])])
    low = np.arange(vertex[order[-1]] + 1)
    for shift in range(1, len(ids)):
        i = np.flatnonzero(key[:-shift] == key[shift:])
        if not len(i):
            break
        j = i + shift
        good = (g[i] != g[j]) & (100 * np.minimum(n[i], n[j]) >= settings.percent * np.maximum(n[i], n[j]))
        i, j = i[good], j[good]
        for at in range(0, len(i), 65536):
            a, b = i[at : at + 65536], j[at : at + 65536]
            alike = (sigs[a] == sigs[b]).mean(axis=1)
            near = alike >= settings.least_estimate
            a, b, alike = a[near], b[near], alike[near]
            # At one shift a row is the left one once and the right one once.
            for own, other in ((a, b), (b, a)):
                better = alike > top[own]
                top[own[better]], partner[own[better]] = alike[better], other[better]
            united(low, vertex[a], vertex[b])
    some = np.flatnonzero(partner >= 0)
    other = partner[some]
    least_g = g[order][np.searchsorted(vertex[order], np.arange(len(low)))]
    found = {"node": key[some], "a": ids[some], "b": ids[other], "ga": g[some], "gb": g[other], "alike": top[some], "root": least_g[low[vertex[some]]]}
    return pa.RecordBatch.from_pydict(found)


def united(low: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Unite x and y pair by pair; ``low`` leads every vertex to the least one it hangs together with, before and after."""
    apart = low[x] != low[y]
    if not apart.any():
        return
    for i, j in set(zip(low[x[apart]].tolist(), low[y[apart]].tolist(), strict=True)):
        while low[i] != i:
            i = low[i]
        while low[j] != j:
            j = low[j]
        low[max(i, j)] = min(i, j)
    while (low[low] != low).any():
        low[:] = low[low]


def compared(rows: DataFrame, settings: Settings) -> DataFrame:
    """node, member ``a``, its best candidate ``b`` and ``root`` among rows (node, id, g, n, brief); nodes have few rows each."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "node"):
            yield best_partners(t["node"].to_numpy(), t, settings)

    return by_node(rows).mapInArrow(compare, "node long, a long, b long, ga long, gb long, alike double, root long")


CELLS = 1 << 22


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    first = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(first) - 1
    # What only one set has is in no intersection.
    shared = np.bincount(column)[column] > 1
    own, column = own[shared], np.cumsum(first[shared]) - 1
    out = np.zeros((len(sets), len(sets)), np.int64)
    width = max(1, CELLS // len(sets))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        at = slice(*np.searchsorted(column, [low, low + width]))
        held = np.zeros((len(sets), int(column[at][-1]) - low + 1), np.float32)
        held[own[at], column[at] - low] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def forest(ids: np.ndarray, g: np.ndarray, sets: list[np.ndarray], settings: Settings) -> tuple[list, list]:
    """Links between different components that span all there are, by full sets: fewer than there are members."""
    n, common = np.array([len(s) for s in sets]), common_counts(sets)
    linked = (100 * common >= settings.percent * (n[:, None] + n - common)) & (g[:, None] != g)
    left, a, b = np.ones(len(ids), bool), [], []
    for start in range(len(ids)):
        reached = [start] if left[start] else []
        left[start] = False
        for i in reached:
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            reached.extend(new.tolist())
            a.extend(np.minimum(ids[i], ids[new]).tolist())
            b.extend(np.maximum(ids[i], ids[new]).tolist())
    return a, b


def linked_in_nodes(rows: DataFrame, settings: Settings) -> DataFrame:
    """Confirmed links among rows (node, id, g, shingles); nodes have few rows each."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "node"):
            nodes = t["node"].to_numpy()
            cuts = np.r_[0, np.flatnonzero(nodes[1:] != nodes[:-1]) + 1, len(nodes)].tolist()
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                part = t.slice(low, high - low)
                sets = [np.frombuffer(x.as_buffer(), U) for x in part["shingles"]]
                a, b = forest(part["id"].to_numpy(), part["g"].to_numpy(), sets, settings)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return by_node(rows).mapInArrow(link, "a long, b long").distinct()


def best_links(found: DataFrame) -> DataFrame:
    """The most promising pair of each component."""
    edge = F.struct("alike", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both = found.select(F.explode(F.array("ga", "gb")).alias("g"), edge.alias("edge"))
    return both.groupBy("g").agg(F.max("edge").alias("edge")).select("edge.a", "edge.b").distinct()


def hub_links(members: DataFrame, settings: Settings) -> DataFrame:
    """Candidate pairs of members of large nodes, each with the hub most like it; ``members`` has node, id, g, n, sig."""
    order = Window.partitionBy("node").orderBy(F.xxhash64("id", "node"), "id")
    drawn = members.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= settings.hub_sample).drop("_k")
    width, least = settings.coordinates, settings.least_estimate

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "node"):
            nodes = t["node"].to_numpy()
            cuts = np.r_[0, np.flatnonzero(nodes[1:] != nodes[:-1]) + 1, len(nodes)]
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = t.slice(low, high - low).combine_chunks()
                sigs = matrix(part["sig"].combine_chunks(), width)
                alike = np.stack([(sigs == s).mean(1) for s in sigs])
                left, picked = np.ones(len(sigs), bool), []
                while left.any() and len(picked) < settings.hubs:
                    best = int(np.where(left, (alike * left).sum(1), -1).argmax())
                    picked.append(best)
                    left &= alike[best] < settings.percent / 100
                yield from part.select(["node", "id", "g", "n", "sig"]).take(sorted(picked)).to_batches()

    hubs = by_node(drawn).mapInArrow(choose, members.select("node", "id", "g", "n", "sig").schema)
    # One row of at most ``hubs`` hubs for each node.
    hubs = settle(hubs.groupBy("node").agg(F.collect_list(F.struct("id", "g", "n", "sig")).alias("hubs")))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                of = b["hubs"].flatten()
                h_id, h_g, h_n, h_sig = (of.field(c) for c in ("id", "g", "n", "sig"))
                own = np.repeat(np.arange(b.num_rows), pc.list_value_length(b["hubs"]).to_numpy())
                ids, g, n, h_id = b["id"].to_numpy(), b["g"].to_numpy(), b["n"].to_numpy(), h_id.to_numpy()
                alike = (matrix(b["sig"], width)[own] == matrix(h_sig, width)).mean(axis=1)
                h_n = h_n.to_numpy()
                sizes = 100 * np.minimum(n[own], h_n) >= settings.percent * np.maximum(n[own], h_n)
                good = np.flatnonzero((g[own] != h_g.to_numpy()) & sizes & (alike >= least))
                good = good[np.lexsort((h_id[good], -alike[good], own[good]))]
                good = good[np.r_[True, own[good][1:] != own[good][:-1]][: len(good)]]
                x, y = ids[own[good]], h_id[good]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return members.join(hubs, "node").select("id", "g", "n", "sig", "hubs").mapInArrow(nearest, "a long, b long").distinct()


FILTER_BITS = 1 << 26
"""Size of the id filter that is sent to the tasks, 8 MB at any input; with very many ids it lets more through."""


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit for a hash of each id, set in the tasks and joined on the way."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = (mixed(b["id"].to_numpy().view(U)) % U(FILTER_BITS)).astype(np.int64)
            word, bit = np.unique(at >> 6), at
            held = np.zeros(len(word), np.int64)
            np.bitwise_or.at(held, np.searchsorted(word, bit >> 6), np.left_shift(1, bit & 63))
            yield pa.RecordBatch.from_pydict({"word": word, "bits": held})

    words = ids.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def sets_of(docs: DataFrame, ids: DataFrame, settings: Settings, doc_id: str, text: str) -> DataFrame:
    """id, shingles of the classes listed (id, doc, digest): the filter thins the texts before anything is shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(ids.select(F.col("doc").alias("id"))))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b["doc"].is_valid())
            at = (mixed(b["doc"].to_numpy(zero_copy_only=False).astype(np.int64).view(U)) % U(FILTER_BITS)).astype(np.int64)
            some = np.flatnonzero((bits.value[at >> 6] >> (at & 63)) & 1)
            for first in range(0, len(some), 256):
                part = b.take(pa.array(some[first : first + 256]))
                sets = [shingles(t, settings.shingle).tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc": part["doc"],
                        "digest": pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()),
                        "shingles": pa.array(sets, pa.binary()),
                    }
                )

    given = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    made = given.mapInArrow(make, "doc long, digest binary, shingles binary")
    # Rows that repeat an id and its text give one set; each class is asked for once, by its number.
    return settle(made.dropDuplicates(["doc", "digest"]).join(ids, ["doc", "digest"]).select("id", "shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Those of the pairs whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b["x"], b["y"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                good[i] = 100 * common >= settings.percent * (len(x) + len(y) - common)
            keep = pa.array(good)
            yield pa.RecordBatch.from_pydict({"a": b["a"].filter(keep), "b": b["b"].filter(keep)})

    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return settle(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))


def linked_classes(docs: DataFrame, rows: DataFrame, settings: Settings, doc_id: str, text: str) -> DataFrame:
    """Classes (id, doc, digest) with their components ``g``.

    A class is a set of shingles; ``id`` is its number, ``doc`` the smallest document id that has it.
    """
    by_set = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest")
    classes = by_set.agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("brief").alias("brief"))
    classes = settle(classes.withColumn("id", F.monotonically_increasing_id()))
    signed = classes.select("id", "n", "sig", "brief", F.col("id").alias("g"))
    ids = classes.select("id", "doc", "digest")
    components_so_far = None
    members = settle(open_members(branched(signed.select("id", "sig"), settings, settings.first_level)))
    small = [members.where(F.col("size") <= settings.leaf)]
    level = settings.first_level
    while True:
        large = members.where(F.col("size") > settings.leaf).select("node", "id")
        if large.isEmpty():
            break
        if level >= settings.depth:
            small.append(blocked(open_members(large, signed.select("id", "g")), settings))
            break
        if level % settings.hub_every == 0:
            pairs = settle(hub_links(settle(large.join(signed, "id").select("node", "id", "g", "n", "sig")), settings))
            sets = sets_of(docs, involved(pairs, ids), settings, doc_id, text)
            signed = settle(grouped(signed, confirmed(pairs, sets, settings)))
            components_so_far = signed.select("id", "g")
        # To the next level with hubs at once: a dense group, which no level divides, leaves a row for each only there.
        step = min(settings.hub_every - level % settings.hub_every, settings.depth - level)
        if components_so_far is not None:
            large = open_members(large, components_so_far).select("node", "id")
        members = settle(open_members(branched(large.join(signed, "id").select("node", "id", "sig"), settings, step), components_so_far))
        small.append(members.where(F.col("size") <= settings.leaf))
        level += step
    met = settle(union([s.select("node", "id") for s in small]))
    signed = signed.select("id", "n", "brief", "g")

    def candidates() -> DataFrame:
        still_open = open_members(met, signed.select("id", "g")).select("node", "id", "g")
        return settle(compared(still_open.join(signed.select("id", "n", "brief"), "id").select("node", "id", "g", "n", "brief"), settings))

    found = candidates()
    # Who has any candidate has a best one, so these are all the sets that are needed.
    sets = sets_of(docs, involved(found, ids), settings, doc_id, text)
    signed = settle(grouped(signed, confirmed(settle(best_links(found)), sets, settings)))
    doubtful = meeting(candidates(), settings).join(sets, "id")
    signed = settle(grouped(signed, settle(linked_in_nodes(doubtful, settings))))
    return ids.join(signed.select("id", "g"), "id")


def meeting(found: DataFrame, settings: Settings) -> DataFrame:
    """node, id, g: where the members that have candidates meet, so that each candidate pair meets at least once.

    What hangs together by candidates is one place, or one for each pair of blocks; where that takes more rows than the
    nodes have, they meet in the nodes.
    """
    members = settle(found.groupBy(F.col("a").alias("id")).agg(F.first("ga").alias("g"), F.count("*").alias("times")))
    edges = settle(found.where("ga <> root").select(F.col("ga").alias("a"), F.col("root").alias("b")).distinct())
    labels = components(edges).withColumnRenamed("id", "g")
    members = settle(members.join(labels, "g", "left").select("id", "g", "times", F.coalesce("label", "g").alias("node")))
    sizes = members.groupBy("node").agg(F.count("*").alias("_all"), F.sum("times").alias("_times"))
    many = settle(sizes.where((F.col("_all") > settings.leaf) & (F.col("_all") * F.ceil(F.col("_all") / settings.leaf) > F.col("_times"))).select("node"))
    once = blocked(members.join(many, "node", "left_anti").select("node", "id", "g"), settings).join(members.select("id", "g"), "id")
    if many.isEmpty():
        return once.select("node", "id", "g")
    again = members.join(many, "node", "left_semi").select("id", "g")
    return once.select("node", "id", "g").unionByName(found.select("node", F.col("a").alias("id")).join(again, "id").select("node", "id", "g"))


def grouped(signed: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with their components ``g``, united by new links; links between the same components are one edge."""
    of = signed.select("id", "g")
    ends = links.join(of.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(of.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    edges = ends.where("ga <> gb").select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct()
    labels = settle(components(settle(edges))).withColumnRenamed("id", "g")
    return signed.join(labels, "g", "left").withColumn("g", F.coalesce("label", "g")).drop("label")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def involved(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    listed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return settle(ids.join(listed, "id", "left_semi"))


def blocked(large: DataFrame, settings: Settings) -> DataFrame:
    """Members of large nodes under a key for each pair of blocks of the node.

    The largest component of a node is not compared with itself: its members are cut into blocks that meet the
    blocks of the others, and the others' blocks meet each other.
    """
    by_g = large.groupBy("node", "g").agg(F.count("*").alias("n")).groupBy("node")
    sizes = by_g.agg(F.max(F.struct("n", "g")).alias("top"), F.sum("n").alias("all"))

    def blocks(n: Column) -> Column:
        return F.greatest(F.ceil(n / settings.leaf), F.lit(1)).cast("long")

    sizes = sizes.select("node", F.col("top.g").alias("_top"), blocks(F.col("top.n")).alias("_main"), blocks(F.col("all") - F.col("top.n")).alias("_rest"))
    rows = large.join(sizes, "node").withColumn("_is_main", F.col("g") == F.col("_top"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("_is_main"), F.col("_main")).otherwise(F.col("_rest")))
    rows = rows.withColumn("_own", own)

    def numbers(n: Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), n - 1)

    meet = F.when(F.col("_is_main"), F.transform(numbers(F.col("_rest")), lambda i: F.xxhash64("node", F.lit(0), "_own", i))).otherwise(
        F.concat(
            F.transform(numbers(F.col("_main")), lambda i: F.xxhash64("node", F.lit(0), i, "_own")),
            F.transform(numbers(F.col("_rest")), lambda i: F.xxhash64("node", F.lit(1), F.least(i, F.col("_own")), F.greatest(i, F.col("_own")))),
        )
    )
    return rows.select(F.explode(meet).alias("node"), "id")


def judged(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, cluster (a number of its group; null without a set or id), component_id, kept of every row."""
    with passing(docs.sparkSession) as keep:
        rows = settle(signatures(docs, settings, doc_id, text))
        named = settle(linked_classes(docs, rows, settings, doc_id, text))
        smallest = named.groupBy("g").agg(F.min("doc").alias("_found"))
        of_set = named.join(smallest, "g").select("digest", F.col("g").alias("_cluster"), "_found")
        placed = rows.select("doc_id", "text_hash", "n", "digest").join(of_set, "digest", "left")
        has_id = F.col("doc_id").isNotNull()
        # Without a class a document stands alone.
        component = F.when(has_id, F.coalesce("_found", "doc_id"))
        return keep(
            placed.select(
                "doc_id",
                "text_hash",
                F.col("n").alias("n_shingles"),
                F.when(has_id, F.col("_cluster")).alias("cluster"),
                component.alias("component_id"),
                (~has_id | (F.col("doc_id") == component)).alias("kept"),
            )
        )


def deduplicated(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return judged(docs, settings, doc_id, text).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, and all that are linked with nothing.

    Of a group the row with the smallest id stays, of several texts under that id the one with the smallest hash. Rows
    without an id or without words stay all.
    """
    kept = judged(docs, settings, doc_id, text).where("kept")
    one = kept.where("cluster IS NOT NULL").groupBy("cluster").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.count("*").alias("_rows"))
    one = settle(one.select("one.*", "_rows"))
    alone = kept.where("cluster IS NULL").select("doc_id", "text_hash", F.lit(1).cast("long").alias("_rows"))
    staying = one.unionByName(alone).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_rows").distinct()
    hashed = docs.withColumn("_text_hash", F.xxhash64(text))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash"))
    several = one.where("_rows > 1")
    if several.isEmpty():
        return hashed.join(staying, same, "left_semi").select(*docs.columns)
    # Only rows of an id that is kept more than once can repeat each other.
    single = hashed.join(staying.where("_rows = 1"), same, "left_semi")
    repeated = hashed.join(staying.where("_rows > 1"), same, "left_semi").dropDuplicates([doc_id, "_text_hash"])
    return single.unionByName(repeated).select(*docs.columns)
