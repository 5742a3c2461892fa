"""Ranked lexical search by presence masks: the k best documents for each item of a query table.

Items are taken in blocks of at most ``block_bytes`` of text (one item more at most); a block's terms are the
vocabulary that goes to the tasks. For each block

1. every document is cut into terms once; a row with its length and its vocabulary terms goes to the shared folder
   (the first block also gives the totals over all terms), and document frequencies are summed over these rows;
2. every task goes through its documents in groups. In a group each vocabulary term has a bitmap of the documents that
   hold it. The bitmaps of an item's terms, turned around, give each document a mask of matched terms; documents are
   grouped by mask. The greatest share that each term reaches in the group bounds the score of every mask. Masks are evaluated
   in the order of falling bounds and the documents of a mask are scored exactly, until the next bound is below the
   item's k-th best score of the task so far;
3. the k best of every task are merged.

Nothing is left out: a bound equal to the k-th score is still evaluated, because ties go to the smaller id.

Scores: a term's weight w is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 75 + 25 n N div L, and its score
sums w * (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included, all in whole numbers.

Memory in a task: one group of documents (``group_cells`` bits of presence at most), the vocabulary and k rows per item of the block.

Defined results: null and empty texts have no terms, and count neither in N nor as results; an item without terms has
no results; an item id that is repeated is one item, by its smallest text (nulls first); a null item id is an item;
null document ids come first among equal scores; repeated document rows are documents each; empty tables give an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricecast.sources.scratch import settle

# Fixed by the data contract, as bytes of UTF-8: a term is a run of ASCII letters and digits and of all non-ASCII
# characters; only A to Z are lower-cased.
TO_TERMS = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))

MATCHED = "doc_id long, n long, terms array<int>, times array<int>"
FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_TERMS).split() if text else []


class Items:
    """A block of items: the distinct terms of all, and each item's columns and repeats."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]]):
        self.ids = [i for i, _ in rows]
        counted = [Counter(terms_of(text)) for _, text in rows]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        self.columns = [np.array(sorted(map(self.vocabulary.get, c)), np.int64) for c in counted]
        names = list(self.vocabulary)
        self.repeats = [np.array([c[names[i]] for i in own], np.int64) for c, own in zip(counted, self.columns, strict=True)]


def blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int | None, bytes | None]]]:
    """Items in the order of their ids; the driver holds one block at a time."""
    given = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    once = given.groupBy("item_id").agg(F.min(F.struct(F.col("text").isNotNull().alias("known"), "text"))["text"].alias("text"))
    block, size = [], 0
    for r in once.orderBy(F.col("item_id").asc_nulls_first()).toLocalIterator():
        block.append((r.item_id, None if r.text is None else r.text.encode()))
        size += len(block[-1][1] or b"")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def matched(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """doc_id, number of terms, and the vocabulary terms of each document that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for d, t in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                    terms = terms_of(t)
                    if terms:
                        found = Counter(map(number, terms))
                        found.pop(None, None)
                        rows.append((d, len(terms), list(found), list(found.values())))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "terms", "times"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(match, MATCHED)


def frequencies(rows: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each vocabulary term: counted in each task, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch["terms"].flatten().to_numpy(), minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": held, "n": total[held]})

    out = np.zeros(n_terms, np.int64)
    if n_terms:
        for r in rows.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            out[r.term] = r.n
    return out


class Best:
    """The k best documents of an item in a task: scores falling, then ids rising, null first."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a bound has to reach: a score of one, or that of the k-th."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        kept = score >= self.least
        score, doc, known = (np.concatenate([a, b[kept]]) for a, b in ((self.score, score), (self.doc, doc), (self.known, known)))
        order = np.lexsort((doc, known, -score))[: self.k]
        self.score, self.doc, self.known = score[order], doc[order], known[order]


class Group:
    """A group of documents: their vocabulary terms, the bitmap and the greatest share of each term."""

    def __init__(self, batch: pa.RecordBatch, n_terms: int, n_docs: int, n_words: int):
        self.doc = batch["doc_id"].fill_null(0).to_numpy()
        self.known = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        held = batch["terms"]
        terms = held.flatten().to_numpy().astype(np.int64)
        times = batch["times"].flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(self.doc)), np.diff(held.offsets.to_numpy()))
        # Python's whole numbers: 25 n N may exceed 64 bits before the division.
        m = np.array([75 + 25 * n * n_docs // n_words for n in batch["n"].to_pylist()], np.int64)
        share = 1_000_000_000 * times // (1000 * times + 12 * m[row])
        self.n_terms = n_terms
        order = np.lexsort((terms, row))
        self.cells = (row * n_terms + terms)[order]
        self.shares = share[order]
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, terms, share)
        self.here = np.unique(terms)
        present = np.zeros((len(self.here), len(self.doc)), bool)
        present[np.searchsorted(self.here, terms), row] = True
        self.bitmaps = np.packbits(present, axis=1)

    def masks(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct masks as rows of bits, the documents sorted by mask, and where each mask begins."""
        place = np.searchsorted(self.here, columns)
        place[place == len(self.here)] = 0
        mine = self.bitmaps[place] * (self.here[place] == columns)[:, None].astype(np.uint8)
        bits = np.unpackbits(mine, axis=1, count=len(self.doc))
        packed = np.packbits(bits, axis=0)
        # A mask of any width as one value: eight bytes where they suffice, else raw bytes.
        width = 8 if len(packed) <= 8 else len(packed)
        wide = np.zeros((len(self.doc), width), np.uint8)
        wide[:, : len(packed)] = packed.T
        value = wide.view(np.uint64 if width == 8 else f"V{width}").ravel()
        _, first, which = np.unique(value, return_index=True, return_inverse=True)
        by_mask = np.argsort(which, kind="stable")
        return bits[:, first].T, by_mask, np.r_[0, np.cumsum(np.bincount(which, minlength=len(first)))]

    def exact(self, docs: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        wanted = docs[:, None] * self.n_terms + columns[None, :]
        at = np.searchsorted(self.cells, wanted)
        at[at == len(self.cells)] = 0
        return np.where(self.cells[at] == wanted, self.shares[at], 0) @ weights

    def search(self, columns: np.ndarray, weights: np.ndarray, best: Best) -> None:
        highest = weights * self.most[columns]
        if not len(self.here) or highest.sum() < best.least:
            return
        bits, by_mask, begins = self.masks(columns)
        bounds = bits.astype(np.int64) @ highest
        falling = np.argsort(-bounds, kind="stable")
        sizes = np.diff(begins)[falling]
        at = 0
        while at < len(falling) and bounds[falling[at]] >= best.least:
            # Masks in the order of their bounds, some documents at a time, so that the least score rises early.
            upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 4 * best.k, "right")) + at)
            chosen = falling[at:upto]
            chosen = chosen[bounds[chosen] >= best.least]
            docs = np.concatenate([by_mask[begins[g] : begins[g + 1]] for g in chosen])
            best.add(self.exact(docs, columns, weights), self.doc[docs], self.known[docs])
            at = upto


def found_in(rows: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_words: int, k: int, group_cells: int) -> DataFrame:
    """The k best of each task for each item of the block."""
    shared = rows.sparkSession.sparkContext.broadcast((items.columns, [weights[c] * r for c, r in zip(items.columns, items.repeats, strict=True)]))
    n_terms = len(items.vocabulary)
    size = max(64, min(8192, group_cells // max(1, n_terms)))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                if held and sum(h.num_rows for h in held) + part.num_rows > size:
                    yield pa.concat_batches(held)
                    held = []
                held.append(part)
        if held:
            yield pa.concat_batches(held)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, weighed = shared.value
        best = [Best(k) for _ in columns]
        for batch in groups(batches):
            group = Group(batch, n_terms, n_docs, n_words)
            for own, w, b in zip(columns, weighed, best, strict=True):
                if len(own):
                    group.search(own, w, b)
        for i, b in enumerate(best):
            if len(b.doc):
                item = np.full(len(b.doc), i, np.int32)
                yield pa.RecordBatch.from_pydict({"item": item, "doc_id": pa.array(b.doc, mask=~b.known), "score": b.score})

    return rows.mapInArrow(search, FOUND)


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 1 << 20,
    group_cells: int = 1 << 25,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    out, totals = None, None
    for block in blocks(items, item_id, item_text, block_bytes):
        own = Items(block)
        rows = settle(matched(docs, own.vocabulary, doc_id, text))
        if totals is None:
            totals = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, n_words = totals
        if not n_docs:
            break
        df = frequencies(rows, len(own.vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        found = found_in(rows, own, weights, n_docs, n_words, k, group_cells)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
        placed = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(own.ids)), "item int, item_id long")
        part = settle(placed.join(names, "item").select("item_id", "rank", "doc_id", "score"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
