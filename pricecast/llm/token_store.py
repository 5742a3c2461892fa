"""Token ids of whole texts in entropy-coded files.

Documents are put in ascending order of their id (range partitioning), each partition is a shard, each shard a
sequence of blocks of whole documents. Ids are made once and kept in the shared folder; their counts over all
documents give one frequency table (at most a row per vocabulary entry, so its size is bounded by the tokenizer),
and with it every block is coded on its own. A file is a Parquet file of records; a record holds the block's document index, the
checkpoints, the coded words and the checksums, so any block, and any segment of a block, is read independently.

Memory in a task: one block (``block_ids`` ids and at most one more document) and a cache of encoded words of a
fixed number of entries; the cache only saves time.

Defined results: null and empty texts give only the end id; null document ids come first; repeated ids follow each
other, ordered by text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricecast.llm import rans
from pricecast.sources.scratch import new_folder, settle

# Cuts that the byte-level pattern makes in any text whose only white space is blanks and line feeds.
# A word of Latin letters also ends before these signs.
CHUNK = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]++(?![^ \n,.!?;:#$%&*|])| ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]")
# Everything else that Python or the tokenizer may take for white space.
OTHER_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CACHED = 350_000

_encoders: dict[str, Encoder] = {}


class Numbered(dict):
    """Numbers of chunks in the order in which they were first seen."""

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        return n


class Encoder:
    """Ids of texts; one per worker process and tokenizer file.

    Each chunk is encoded once while it is remembered. New chunks are encoded together, a line each: a line feed
    between two chunks is a token of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        (self.line_feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.numbers = Numbered()
        self.uses = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        """Of each known chunk in ``ids``, and the end."""
        self.ids = np.zeros(0, np.uint32)

    def forget(self) -> None:
        """Make room; of what is known, the chunks used most often stay."""
        uses = self.uses[: len(self.numbers)]
        stay = np.sort(np.argsort(-uses, kind="stable")[: CACHED // 2])
        stay = stay[uses[stay] > 2]
        chunks = list(self.numbers)
        old, starts, ids = [chunks[i] for i in stay], self.starts, self.ids
        self.numbers = Numbered(zip(old, range(len(old)), strict=True))
        self.uses = np.zeros(len(old), np.int64)
        sizes = starts[stay + 1] - starts[stay]
        ends = np.cumsum(sizes)
        self.starts = np.r_[0, ends]
        self.ids = ids[np.repeat(starts[stay] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]

    @staticmethod
    def at(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def learn(self) -> None:
        """Encode the chunks that have a number but no ids yet."""
        known = len(self.starts) - 1
        new = list(islice(self.numbers, known, None))
        sizes = np.zeros(len(new), np.int64)
        plain = np.array([c.strip("\n ") != "" for c in new], bool)
        # Runs of blanks and line feeds would melt into the lines between chunks.
        runs = {i: np.array(self.tokenizer.encode(new[i], add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(~plain)}
        lines = np.flatnonzero(plain)
        parts: dict[int, np.ndarray] = {}
        groups = [lines[at : at + 512] for at in range(0, len(lines), 512)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["\n".join([new[i] for i in group]) for group in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.r_[np.flatnonzero(ids == self.line_feed), len(ids)]
            begins = np.r_[0, ends[:-1] + 1]
            if len(ends) != len(group):
                raise ValueError("a chunk does not end at its line")
            sizes[group] = ends - begins
            parts[int(group[0])] = ids[ids != self.line_feed]
        for i, r in runs.items():
            sizes[i] = len(r)
        ordered = np.empty(int(sizes.sum()), np.uint32)
        starts = np.cumsum(sizes) - sizes
        for group in groups:
            flat, n = parts[int(group[0])], sizes[group]
            ordered[np.repeat(starts[group], n) + np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        for i, r in runs.items():
            ordered[starts[i] : starts[i] + len(r)] = r
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(sizes)]
        self.ids = np.concatenate([self.ids, ordered])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Texts with other white space are encoded as a whole, all others by their chunks."""
        if len(self.numbers) > CACHED:
            self.forget()
        whole = [bool(OTHER_SPACE.search(t)) for t in texts]
        numbers = []
        for t, w in zip(texts, whole, strict=True):
            chunks = [] if w else CHUNK.findall(t)
            numbers.append(np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks)))
        self.learn()
        if numbers:
            seen = np.bincount(np.concatenate(numbers), minlength=len(self.numbers))
            seen[: len(self.uses)] += self.uses
            self.uses = seen
        out = []
        for t, w, own in zip(texts, whole, numbers, strict=True):
            if w:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            begins = self.starts[own]
            sizes = self.starts[own + 1] - begins
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.ids[np.repeat(begins - ends + sizes, sizes) + np.arange(total)])
        return out


BLOCKS = "shard int, block long, start long, doc_ids array<long>, sizes array<long>, ids binary, counted array<struct<id:long,n:long>>"
PACKED = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int64()),
        ("start", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("ids", pa.binary()),
        ("counted", pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))),
    ]
)


def blocks_of(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int, doc_id: str, text: str) -> DataFrame:
    """The blocks of each shard, and behind them a row with how often each id occurs in the shard."""
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    end = np.array([end_id], np.uint32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.at(tokenizer), TaskContext.get().partitionId()
        doc_ids: list = []
        held: list[np.ndarray] = []
        size = start = block = 0
        total = np.zeros(0, np.int64)

        def row() -> pa.RecordBatch:
            nonlocal total
            ids = np.concatenate(held).astype("<u4")
            found = np.bincount(ids, minlength=len(total))
            found[: len(total)] += total
            total = found
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "block": [block],
                    "start": [start],
                    "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                    "sizes": pa.array([[len(h) for h in held]], pa.list_(pa.int64())),
                    "ids": pa.array([ids.tobytes()], pa.binary()),
                    "counted": pa.nulls(1, PACKED.field("counted").type),
                }
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for d, e in zip(part["doc_id"].to_pylist(), encoder.encode(part["text"].to_pylist()), strict=True):
                    doc_ids.append(d)
                    held.append(np.append(e, end))
                    size += len(e) + 1
                    if size >= block_ids:
                        yield row()
                        doc_ids, held, start, block, size = [], [], start + size, block + 1, 0
        if held:
            yield row()
        some = np.flatnonzero(total)
        if len(some):
            counts = pa.StructArray.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])
            of_shard = {"shard": pa.array([shard], pa.int32()), "counted": pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), counts)}
            yield pa.RecordBatch.from_pydict({f.name: of_shard.get(f.name, pa.nulls(1, f.type)) for f in PACKED})

    return ordered.mapInArrow(pack, BLOCKS)


def counts_of(blocks: DataFrame) -> DataFrame:
    """id, n over all documents, summed over the counts of the shards."""
    counted = blocks.where("counted IS NOT NULL").select(F.explode("counted").alias("c"))
    return counted.groupBy("c.id").agg(F.sum("c.n").alias("n"))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    block_ids: int = 1 << 18,
    lanes: int = 1024,
    steps_per_segment: int = 128,
) -> None:
    """Encode all documents and write ``path``/frequencies and ``path``/records."""
    spark = docs.sparkSession
    made = settle(blocks_of(docs, tokenizer, end_id, block_ids, doc_id, text))
    counts_of(made).coalesce(1).write.parquet(f"{path}/frequencies")
    table = spark.sparkContext.broadcast(frequencies(spark, path))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                known = np.array([d is not None for d in r["doc_ids"]], "u1")
                doc_ids = np.array([d or 0 for d in r["doc_ids"]], np.int64)
                ids = np.frombuffer(r["ids"], "<u4")
                record = rans.pack(doc_ids, known, np.array(r["sizes"]), ids, r["start"], table.value, lanes, steps_per_segment)
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array([r["shard"]], pa.int32()), "block": [r["block"]], "n_ids": [len(ids)], "record": [record]}
                )

    blocks = made.where("counted IS NULL").drop("counted")
    blocks.mapInArrow(code, "shard int, block long, n_ids long, record binary").write.parquet(f"{path}/records")


def frequencies(spark: SparkSession, path: str) -> rans.Frequencies:
    """The shared table; its rows are bounded by the vocabulary."""
    rows = spark.read.parquet(f"{path}/frequencies").orderBy("id").collect()
    return rans.Frequencies.of_counts(np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows], np.int64))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (little-endian 32-bit, end id included) of every document in the files."""
    records = spark.read.parquet(f"{path}/records")
    # One number per shard, that is per file.
    totals = sorted((r.shard, r.n) for r in records.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    first, at = {}, 0
    for shard, n in totals:
        first[shard], at = at, at + n
    table = spark.sparkContext.broadcast((frequencies(spark, path), first))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, starts = table.value
        by_slot = shares.by_slot()
        for batch in batches:
            for shard, record in zip(batch["shard"].to_pylist(), batch["record"], strict=True):
                block = rans.unpack(record.as_py())
                ids = block.ids(shares, by_slot).astype("<u4").tobytes()
                ends = np.cumsum(block.sizes.astype(np.int64))
                begins = ends - block.sizes
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(block.doc_ids, mask=block.known == 0),
                        "start": begins + block.start + starts[shard],
                        "ids": pa.array([ids[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    }
                )

    return records.select("shard", "record").mapInArrow(read, "doc_id long, start long, ids binary")


def stored_tokens(docs: DataFrame, tokenizer: str, end_id: int, **settings) -> DataFrame:
    """Write the files to a new place in the shared folder and read the documents back from them."""
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, **settings)
    return read_documents(spark, path)
