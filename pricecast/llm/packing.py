"""Packing documents into windows whose tokens come from the sources in target proportions.

Every source is a queue of tokens, document after document. Deficit round-robin serves the queues: in each round
a queue's deficit counter grows by its quantum, its target share of ``window`` tokens; while the counter holds a packet
(``packet`` tokens, or what is left of the queue), one is sent and paid for. What is not spent is carried to the next
round. The packets sent, one after the other, are one stream, and windows are cut from it: every window gets each
source's share up to about one packet, and no position of a window is empty.

A counter after r rounds is a product and a remainder, so any place of the stream follows by division from the
position of a token in its queue. No task depends on another one: each begins with the deficits that all windows before it
have left. Only when a queue runs out do the quanta change (the rest shares its part by weight); the driver works out these
phases, at most one per queue, from the sizes of the queues.

Tokens are made once and written with their place among the tokens of the same source and task; sums over tasks give the place
in the queue. The tokens are not shuffled.

Target proportions are weights by source; by default the sources' own shares of all tokens, so that every window
looks like the whole corpus and the queues run out together. By default the ``queues`` - 1 sources with most tokens have a
queue each and all others share one, so the plan that goes to the tasks is bounded; given weights must not name more
sources than that. Shares are rounded to 1 / 2**27 at a window of 2048.

What is left after the last whole window is cut into sequences of powers of two. So nothing is padded.

Memory in a task: one batch of documents, a bounded cache of encoded words.

Defined results: a null text is an empty one, and has one token, the end id; a null source is a source of its own; null and
repeated ids and repeated rows are documents each; if weights are given, a source of the table without one is an error, and
weights must be positive; an empty table gives no pieces; only id, source and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricecast.llm.words import WordEncoder
from pricecast.sources.scratch import settle

UNIT = 1 << 16
"""Parts of a token in which deficits are counted."""

TOKENS = "part int, source string, before long, doc_id long, n_tokens long, ids binary"
PIECES = "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, source: str, text: str) -> DataFrame:
    """Ids of each document, and how many tokens of its source come before it in its task (``part``)."""
    given = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(text, F.lit("")).alias("text")
    )
    end = np.array([end_id], np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder.at(tokenizer), TaskContext.get().partitionId()
        sent: dict[str | None, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                sources = rows["source"].to_pylist()
                ids = [np.append(i, end) for i in encoder.encode(rows["text"].to_pylist())]
                before = []
                for s, i in zip(sources, ids, strict=True):
                    before.append(sent.get(s, 0))
                    sent[s] = before[-1] + len(i)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part] * len(ids), pa.int32()),
                        "source": rows["source"],
                        "before": pa.array(before, pa.int64()),
                        "doc_id": rows["doc_id"],
                        "n_tokens": pa.array(map(len, ids), pa.int64()),
                        "ids": pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
                    }
                )

    return given.mapInArrow(encode, TOKENS)


@dataclass
class Plan:
    """Phases of the round-robin as arrays [phase, queue]: tokens sent before, deficits at the start, quanta."""

    packet: int
    window: int
    sizes: np.ndarray
    sent: np.ndarray
    deficit: np.ndarray
    quantum: np.ndarray

    @staticmethod
    def of(sizes: list[int], weights: list[float], window: int, packet: int) -> Plan:
        """All in Python's whole numbers; one phase for each time that queues run out."""
        n = len(sizes)
        sent = [0] * n
        # Counters start at different parts of a packet (multiples of the golden ratio), so that queues take turns.
        deficit = [40503 * q % 65536 * min(packet, sizes[q]) * UNIT // 65536 for q in range(n)]
        open_ = [q for q in range(n) if sizes[q]]
        rows: list[tuple[list[int], list[int], list[int]]] = []
        while open_:
            total = sum(weights[q] for q in open_)
            quantum = [0] * n
            for q in open_:
                quantum[q] = max(1, round(window * UNIT * weights[q] / total))
            rows.append((sent[:], deficit[:], quantum))
            rounds = {q: -(-((sizes[q] - sent[q]) * UNIT - deficit[q]) // quantum[q]) for q in open_}
            upto = min(rounds.values())
            for q in open_:
                units = deficit[q] + upto * quantum[q]
                served = sizes[q] - sent[q] if rounds[q] == upto else units // (packet * UNIT) * packet
                sent[q] += served
                deficit[q] = 0 if rounds[q] == upto else units - served * UNIT
            open_ = [q for q in open_ if rounds[q] > upto]
        rows.append((sent, [0] * n, [0] * n))
        sent_at, deficits, quanta = (np.array(x, np.int64).reshape(len(rows), n) for x in zip(*rows, strict=True))
        return Plan(packet, window, np.array(sizes, np.int64), sent_at, deficits, quanta)

    @property
    def tokens(self) -> int:
        return int(self.sizes.sum())

    def served(self, phase: int, rounds: np.ndarray) -> np.ndarray:
        """[round, queue]: tokens sent in the phase up to and with these rounds."""
        units = self.deficit[phase] + rounds[:, None] * self.quantum[phase]
        left = self.sizes - self.sent[phase]
        return np.where(units >= left * UNIT, left, units // (self.packet * UNIT) * self.packet)

    def visits(self, queue: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of tokens [begin, end) of a queue, cut where the stream turns to another one: run, from, to, place in the stream."""
        out: tuple[list, list, list, list] = ([], [], [], [])
        ahead = self.sent[:, queue]
        first, last = np.searchsorted(ahead, begin.min(), "right") - 1, np.searchsorted(ahead, end.max() - 1, "right") - 1
        for phase in range(int(first), int(last) + 1):
            base = ahead[phase]
            x, y = np.maximum(begin, base), np.minimum(end, ahead[phase + 1])
            runs = np.flatnonzero(x < y)
            if not len(runs):
                continue
            low = (x[runs] - base) // self.packet
            n = (y[runs] - 1 - base) // self.packet - low + 1
            which = np.repeat(runs, n)
            number = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            x = np.maximum(x[which], base + number * self.packet)
            y = np.minimum(y[which], base + (number + 1) * self.packet)
            due = np.minimum((number + 1) * self.packet, self.sizes[queue] - base) * UNIT - self.deficit[phase, queue]
            rounds, at = np.unique(-(-due // self.quantum[phase, queue]), return_inverse=True)
            place = np.empty(len(rounds), np.int64)
            for i in range(0, len(rounds), 4096):
                some = rounds[i : i + 4096]
                before, now = self.served(phase, some - 1), self.served(phase, some)
                # The queue's own tokens start at its share of ``before``.
                place[i : i + 4096] = self.sent[phase].sum() + before.sum(1) + (now - before)[:, :queue].sum(1) - before[:, queue]
            for o, v in zip(out, (which, x, y, place[at] + x - base), strict=True):
                o.append(v)
        run, x, y, place = (np.concatenate(o) for o in out)
        order = np.lexsort((x, run))
        run, x, y, place = run[order], x[order], y[order], place[order]
        # Packets that follow each other in the stream are one run.
        starts = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (place[1:] != place[:-1] + y[:-1] - x[:-1])])
        return run[starts], x[starts], y[np.r_[starts[1:], len(y)] - 1], place[starts]

    def sequences(self) -> np.ndarray:
        """Where the sequences of what is left after the last whole window begin: powers of two, the largest first."""
        whole, left = divmod(self.tokens, self.window)
        powers = []
        while left:
            powers.append(1 << (left.bit_length() - 1))
            left -= powers[-1]
        return whole * self.window + np.cumsum([0, *powers]).astype(np.int64)

    def cut(self, x: np.ndarray, y: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs cut at the ends of sequences: number of the run, from, to, sequence, offset in it."""
        tail = self.sequences()
        whole = tail[0] // self.window

        def sequence(p: np.ndarray) -> np.ndarray:
            return np.where(p < tail[0], p // self.window, whole + np.searchsorted(tail, p, "right") - 1)

        low = sequence(place)
        n = sequence(place + y - x - 1) - low + 1
        run = np.repeat(np.arange(len(x)), n)
        number = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        begins = np.where(number < whole, number * self.window, tail[np.clip(number - whole, 0, len(tail) - 1)])
        ends = np.where(number < whole, (number + 1) * self.window, tail[np.clip(number - whole + 1, 0, len(tail) - 1)])
        shift = x[run] - place[run]
        first = np.maximum(begins, place[run])
        return run, first + shift, np.minimum(ends, place[run] + (y - x)[run]) + shift, number, first - begins


def packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    weights: dict[str | None, float] | None = None,
    window: int = 2048,
    packet: int = 128,
    queues: int = 256,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    if weights is not None and (len(weights) > queues or any(not w > 0 for w in weights.values())):
        raise ValueError(f"weights must be positive, and at most {queues}")
    spark = docs.sparkSession
    tokens = settle(tokenised(docs, tokenizer, end_id, doc_id, source, text))
    sums = settle(tokens.groupBy("part", "source").agg(F.sum("n_tokens").alias("n")))
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    largest = [(r.source, r.n) for r in by_source.orderBy(F.col("n").desc(), F.col("source").asc_nulls_first()).limit(queues + 1).collect()]
    if weights is not None and (missing := [s for s, _ in largest if s not in weights]):
        raise ValueError(f"no target weight for {missing[:5]}")
    if not largest:
        return spark.createDataFrame([], PIECES)
    named = largest if len(largest) <= queues else largest[: queues - 1]
    sizes = [n for _, n in named]
    if len(named) < len(largest):
        sizes.append(by_source.agg(F.sum("n")).first()[0] - sum(sizes))
    shares = [float(n) for n in sizes] if weights is None else [weights[s] for s, _ in named]
    plan = spark.sparkContext.broadcast(Plan.of(sizes, shares, window, packet))

    # At most ``queues`` rows; all other sources are in the last queue.
    numbers = spark.createDataFrame([(s, q) for q, (s, _) in enumerate(named)], "named string, queue int")
    queued = sums.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("named")), "left").select(
        "part", "source", "n", F.coalesce("queue", F.lit(len(sizes) - 1)).alias("queue")
    )

    def ahead(order: str, *within: str) -> Column:
        rows = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(rows), F.lit(0))

    inside = queued.withColumn("own", ahead("source", "queue", "part"))
    by_part = queued.groupBy("queue", "part").agg(F.sum("n").alias("n")).withColumn("parts", ahead("part", "queue"))
    places = settle(
        inside.join(by_part.drop("n"), ["queue", "part"]).select(
            F.col("part").alias("p"), F.col("source").alias("s"), "queue", (F.col("own") + F.col("parts")).alias("base")
        )
    )
    placed = tokens.join(places, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "queue", (F.col("base") + F.col("before")).alias("begin"), "n_tokens", "ids"
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield from pieces_of(p, batch.slice(at, 512))

    return placed.mapInArrow(pieces, PIECES)


def pieces_of(plan: Plan, docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    queue, begin, n = (docs[c].to_numpy() for c in ("queue", "begin", "n_tokens"))
    ids = docs["ids"].to_pylist()
    for q in np.unique(queue):
        own = np.flatnonzero(queue == q)
        run, x, y, place = plan.visits(int(q), begin[own], begin[own] + n[own])
        piece, x, y, sequence, offset = plan.cut(x, y, place)
        doc = own[run[piece]]
        x, y = x - begin[doc], y - begin[doc]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": docs["doc_id"].take(pa.array(doc)),
                "source": docs["source"].take(pa.array(doc)),
                "start": x,
                "length": y - x,
                "ids": pa.array([ids[d][4 * a : 4 * b] for d, a, b in zip(doc.tolist(), x.tolist(), y.tolist(), strict=True)], pa.binary()),
                "doc_tokens": n[doc],
                "sequence_id": sequence,
                "offset": offset,
            }
        )


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence, at most a window of tokens: its ids and which documents they are from."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    joined = pieces.groupBy("sequence_id").agg(ordered.alias("pieces"))
    return joined.select(
        "sequence_id",
        F.aggregate("pieces", F.lit(b""), lambda all_, piece: F.concat(all_, piece["ids"])).alias("ids"),
        F.transform("pieces", lambda p: F.struct(p["offset"].alias("offset"), p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"))).alias("documents"),
    )
