"""Quality by a vote of the nearest labelled documents in a latent semantic space.

A document is a vector of hashed terms: its words, the shapes of its words (capitals, digits, signs), and a few
figures on repetition and length. Term frequencies are damped and weighted by inverse document frequencies counted over
all documents; a truncated singular value decomposition of a bounded sample of labelled documents gives the latent space. The
vectors of the sample (2 * ``per_class`` rows of ``rank`` numbers at most) are sent to all tasks; a task projects its
documents block by block, takes the exact cosines with all labelled vectors as one matrix product, and the ``k``
nearest vote with weights that grow with similarity. Votes are weighted by how much rarer a class is in the sample
than among all training labels, so the score estimates a probability.

Bounds: ``per_class`` labelled documents of each class, ``TERMS`` terms. Everything else covers all documents.

Defined results: null and empty texts are scored like very short ones; without any training label the score is 0.5;
repeated rows are scored alike; an empty table gives an empty one; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast.llm.common import free_name
from pricecast.llm.labelled import class_sizes, sample, training_labels
from pricecast.sources.scratch import settle

WORDS, SHAPES, FIGURES = 1024, 992, 32
TERMS = WORDS + SHAPES + FIGURES
PART_WEIGHTS = (0.5, 1.0, 1.0)
"""Of words, shapes and figures in a document's vector."""
BLOCK = 256
CACHED = 400_000
CACHED_CHARS = 16_000_000

_runs = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    return _runs.sub(r"\1", "".join(kinds))


class Terms(dict):
    """Numbers of words; the terms of a number are in ``word`` and ``shape``."""

    def __init__(self):
        super().__init__()
        self.word, self.shape = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.chars = 0

    def __missing__(self, w: str) -> int:
        n = len(self)
        if n == len(self.word):
            self.word, self.shape = np.resize(self.word, 2 * n), np.resize(self.shape, 2 * n)
        self.word[n] = zlib.crc32(w.lower().encode("utf-8", "replace")) % WORDS
        self.shape[n] = WORDS + zlib.crc32(shape(w).encode("utf-8", "replace")) % SHAPES
        self[w] = n
        self.chars += len(w)
        return n


_terms = Terms()


def counts(texts: list[str]) -> np.ndarray:
    """Terms of at most ``BLOCK`` documents, one row each."""
    global _terms
    if len(_terms) > CACHED or _terms.chars > CACHED_CHARS:
        _terms = Terms()
    known = _terms
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        words = text.split()
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        row[:WORDS] = np.bincount(known.word[ids], minlength=WORDS)[:WORDS]
        row[WORDS : WORDS + SHAPES] = np.bincount(known.shape[ids], minlength=WORDS + SHAPES)[WORDS:]
        figures = row[WORDS + SHAPES :]
        n = len(ids)
        figures[min(15, n.bit_length())] = 1
        if n:
            distinct = len(np.unique(ids)) / n
            figures[16 + min(7, int(8 * distinct))] = 1
            figures[24] = 4 * float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0
            lines = text.split("\n")
            figures[25] = 4 * (1 - len(set(lines)) / len(lines))
    return out


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, weighted, each part and then the whole brought to length."""
    v = x.copy()
    v[:, : WORDS + SHAPES] = np.log1p(v[:, : WORDS + SHAPES])
    v *= idf
    at = 0
    for size, weight in zip((WORDS, SHAPES, FIGURES), PART_WEIGHTS, strict=True):
        part = v[:, at : at + size]
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        at += size
    return v


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def latent_space(x: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors by subspace iteration, as a matrix terms x rank."""
    rank = min(rank, *x.shape)
    start = np.random.default_rng(seed).standard_normal((x.shape[1], rank + min(16, x.shape[1] - rank))).astype(np.float32)
    basis = np.linalg.qr(x.T @ (x @ start))[0]
    for _ in range(3):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ vt.T)[:, :rank].astype(np.float32)


@dataclass(frozen=True)
class Voters:
    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    y: np.ndarray
    votes: np.ndarray
    """Of each labelled document, by its class."""
    prior: float
    k: int
    power: float

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.y):
            return np.full(len(texts), self.prior)
        near = unit(weighted(counts(texts), self.idf) @ self.space) @ self.vectors.T
        k = min(self.k, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** self.power * self.votes[best]
        faint = 1e-3
        return ((weight * self.y[best]).sum(1) + faint * self.prior) / (weight.sum(1) + faint)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents with each term, and all documents; each task adds its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            texts = batch[0].to_pylist()
            for at in range(0, len(texts), BLOCK):
                part = [t or "" for t in texts[at : at + BLOCK]]
                total[:TERMS] += (counts(part) > 0).sum(0)
                total[TERMS] += len(part)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": found, "n": total[found]})

    rows = docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(TERMS + 1, np.int64)
    for r in rows:
        total[r.term] = r.n
    return total[:TERMS], int(total[TERMS])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", per_class: int = 2000, rank: int = 48, k: int = 25, power: float = 6.0) -> Voters:
    train = settle(training_labels(labels, label))
    sizes = class_sizes(train)
    known = sizes[0] + sizes[1]
    found, n_docs = document_frequencies(docs, text)
    idf = np.log1p(n_docs / (1.0 + found)).astype(np.float32)
    idf[WORDS + SHAPES :] = 1.0

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for at in range(0, len(texts), BLOCK):
                x = counts(texts[at : at + BLOCK])
                rows = [(np.flatnonzero(r), r) for r in x]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"].slice(at, BLOCK),
                        "y": batch["y"].slice(at, BLOCK),
                        "term": pa.array([i.astype("<u2").tobytes() for i, _ in rows], pa.binary()),
                        "n": pa.array([r[i].astype("<f4").tobytes() for i, r in rows], pa.binary()),
                    }
                )

    rows = sample(docs, train, per_class, text).select("doc_id", "y", "text").mapInArrow(vectors, "doc_id long, y int, term binary, n binary").orderBy("doc_id").collect()
    x = np.zeros((len(rows), TERMS), np.float32)
    for at, r in enumerate(rows):
        x[at, np.frombuffer(r.term, "<u2")] = np.frombuffer(r.n, "<f4")
    y = np.array([r.y for r in rows], np.float64)
    if not len(rows):
        return Voters(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, y, 0.5, k, power)
    x = weighted(x, idf)
    space = latent_space(x, rank)
    drawn = [max(1, int((y == c).sum())) for c in (0, 1)]
    votes = np.where(y == 1, sizes[1] / drawn[1], sizes[0] / drawn[0])
    return Voters(idf, space, unit(x @ space).astype(np.float32), y, votes / votes.max(), sizes[1] / known, k, power)


def score(docs: DataFrame, voters: Voters, text: str = "text", into: str = "score") -> DataFrame:
    """Add the score; the voters' vectors are bounded by the sample."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)
    column = free_name(docs.columns, into)
    kept = docs.drop(text)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[text].to_pylist()
            found = [sent.value.score([t or "" for t in texts[at : at + BLOCK]]) for at in range(0, len(texts), BLOCK)]
            columns = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(found) if found else np.empty(0))], names=[*names, column])

    return docs.select(*names, text).mapInArrow(vote, schema)
