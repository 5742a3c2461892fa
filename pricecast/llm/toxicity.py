"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the words and the four-letter beginnings of words of a bounded sample of labelled documents: all of them with
``fit_whole``, or with ``fit`` only those that stand out among toxic examples (two-proportion z of their document
shares). Inverse document frequencies of these terms are counted over all documents; with all words, a term that
stands out weighs 1 + z times as much, and no term is left out.
The labelled vectors are laid out in blocks of similar examples; for each term the index has its postings by block
and the largest weight in the block. A document's bound for a block is the product of its weights with these maxima,
and a block is opened only if the bound exceeds the k-th cosine found so far, so the neighbours are exact. With all
words, the terms of many examples are multiplied first, in single precision with a bound of its error; as no weight is
negative, the k-th of these partial cosines is a floor of the k-th cosine, and a block's bound is its largest partial
cosine plus the maxima of the other terms. Examples of opened blocks that can be among the k nearest are multiplied
again in double precision.
Nearer examples weigh more; the pseudo-vote of the base rate keeps scores of distant documents low. The neighbours and
their cosines are the evidence.

Bounds: ``per_class`` labelled documents of each class; ``max_terms`` terms in ``fit``. Everything else covers all documents.

Defined results: null and empty texts and texts without any term get the smoothed share of toxic examples among
training documents (in ``fit``, among those without terms); without training labels the score is 0; repeated rows are scored alike; an empty
table gives an empty one; other columns pass through. Words that no example has are not part of a document's vector.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricecast.llm.common import free_name
from pricecast.llm.labelled import class_sizes, sample, training_labels
from pricecast.sources.scratch import settle

EDGES = re.compile(r"^\W+|\W+$")
ASCII_EDGES = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != "_")
CACHED = 400_000
BLOCK = 64
NEIGHBOURS = "array<struct<doc_id:long,cosine:double,label:int>>"


def terms_of(token: str) -> tuple[str, str]:
    """The word in a token and, marked, its beginning."""
    word = token.lower().strip(ASCII_EDGES)
    if not word.isalnum() and not (word[:1].isalnum() and word[-1:].isalnum()):
        word = EDGES.sub("", word)
    return word, f"{word[:4]}*" if len(word) > 4 else ""


class Numbers(dict):
    """Numbers of the two terms of a token, n for none, as one number; forgets what it saw when it is full."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, token: str) -> int:
        if len(self) > CACHED:
            self.clear()
        none = len(self.terms)
        word, beginning = terms_of(token)
        n = self[token] = self.terms.get(word, none) * (none + 1) + self.terms.get(beginning, none)
        return n


def term_counts(texts: list[str], numbers: Numbers, n_terms: int) -> np.ndarray:
    out = np.zeros((len(texts), n_terms), np.float32)
    for row, text in zip(out, texts, strict=True):
        words = text.split()
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        for own in np.divmod(ids, n_terms + 1):
            row += np.bincount(own, minlength=n_terms + 1)[:n_terms]
    return out


@dataclass(frozen=True)
class Index:
    terms: dict[str, int]
    idf: np.ndarray
    doc_ids: np.ndarray
    y: np.ndarray
    votes: np.ndarray
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    """Of each block: place in the block, term, weight."""
    maxima: np.ndarray
    """Blocks x terms."""
    base: float
    k: int

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k nearest of each row, nearest first, ties to the earlier place; 0 and -1 where fewer share a term."""
        k, n = self.k, len(q)
        cosines, places = np.zeros((n, k)), np.full((n, k), -1, np.int64)
        bounds = q @ self.maxima.T
        # Blocks that promise most to most documents first: the sooner the k-th cosine is high, the fewer are opened.
        for b in np.argsort(-bounds.sum(0), kind="stable"):
            ask = np.flatnonzero((bounds[:, b] > 0) & (bounds[:, b] * (1 + 1e-9) >= cosines[:, -1]))
            if not len(ask):
                continue
            place, term, weight = self.postings[b]
            held = np.zeros((self.maxima.shape[1], BLOCK))
            held[term, place] = weight
            found = q[ask] @ held
            both = np.hstack([cosines[ask], found])
            where = np.hstack([places[ask], np.where(found > 0, b * BLOCK + np.arange(BLOCK), -1)])
            order = np.lexsort((np.where(where < 0, np.iinfo(np.int64).max, where), -both), axis=1)[:, :k]
            cosines[ask], places[ask] = np.take_along_axis(both, order, 1), np.take_along_axis(where, order, 1)
        return cosines, places

    def score(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.full(len(counts), self.base)
        cosines, places = np.zeros((len(counts), self.k)), np.full((len(counts), self.k), -1, np.int64)
        some = np.flatnonzero(counts.sum(1) > 0) if len(self.idf) else np.empty(0, np.int64)
        if len(some) and len(self.y):
            cosines[some], places[some] = self.search(self.vectors(counts[some]))
            c, p = cosines[some], places[some]
            weight = np.where(p >= 0, self.votes[p] / (1.05 - np.minimum(c, 1)), 0)
            pseudo = 0.5
            out[some] = ((weight * self.y[p]).sum(1) + pseudo * self.base) / (weight.sum(1) + pseudo)
        return out, cosines, places

    def judge(self, texts: list[str], numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.score(term_counts(texts, numbers, len(self.terms)))


def sparse_counts(texts: list[str], numbers: Numbers, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count, in the order of rows and terms."""
    ids = [np.empty(0, np.int64)]
    for text in texts:
        words = text.split()
        ids.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    first = np.repeat(np.arange(len(texts)) * n_terms, [len(x) for x in ids[1:]])
    keys = np.concatenate([(own + first)[own < n_terms] for own in np.divmod(np.concatenate(ids), n_terms + 1)])
    if len(texts) * n_terms < 2**31:
        # Half as wide, sorted in half the time.
        keys = keys.astype(np.int32)
    found, n = np.unique(keys, return_counts=True)
    return *np.divmod(found.astype(np.int64), max(n_terms, 1)), n


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start to before its end, and how many each span has."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum()), n


@dataclass(frozen=True)
class WholeIndex:
    """All terms of the examples. Terms of many examples are a matrix; the others have postings in the order of term and place."""

    terms: dict[str, int]
    weights: np.ndarray
    doc_ids: np.ndarray
    y: np.ndarray
    votes: np.ndarray
    common: np.ndarray
    """Column in ``matrix`` of each term, or -1."""
    matrix: np.ndarray
    """Examples x terms of many examples."""
    pairs: np.ndarray
    """First pair (term, block) of each term, and the end."""
    blocks: np.ndarray
    maxima: np.ndarray
    postings: np.ndarray
    """First posting of each pair, and the end."""
    places: np.ndarray
    values: np.ndarray
    base: float
    k: int

    @cached_property
    def single(self) -> np.ndarray:
        """The matrix in single precision; made where it is used, not sent."""
        return self.matrix.astype(np.float32)

    @property
    def product_error(self) -> float:
        """Most by which a product of rows in single precision is off, as a share of it: no term is negative."""
        steps = (self.matrix.shape[1] + 8) * 2.0**-24
        return steps / (1 - steps)

    def vectors(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        v = (1 + np.log(counts)) * self.weights[terms]
        return v / np.maximum(np.sqrt(np.bincount(rows, v * v, n)), 1e-12)[rows]

    def search(self, rows: np.ndarray, terms: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k nearest of n documents, nearest first, ties to the earlier place; 0 and -1 where fewer share a term."""
        cosines, places = np.zeros((n, self.k)), np.full((n, self.k), -1, np.int64)
        n_examples = len(self.y)
        k = min(self.k, n_examples)
        if not k:
            return cosines, places
        column = self.common[terms]
        many = column >= 0
        q = np.zeros((n, self.matrix.shape[1]), np.float32)
        q[rows[many], column[many]] = v[many]
        found = q @ self.single.T
        error = self.product_error
        floor = np.partition(found, n_examples - k, axis=1)[:, n_examples - k] * (1 - error)
        bounds = np.maximum.reduceat(found, np.arange(0, n_examples, BLOCK), axis=1) * (1 + 2 * error)
        columns, own_ends, own_v = column[many], np.searchsorted(rows[many], np.arange(n + 1)), v[many]
        rows, terms, v = (x[~many] for x in (rows, terms, v))
        ends = np.searchsorted(rows, np.arange(n + 1))
        for d in range(n):
            own, w = terms[ends[d] : ends[d + 1]], v[ends[d] : ends[d + 1]]
            pair, times = spans(self.pairs[own], self.pairs[own + 1])
            w, block = np.repeat(w, times), self.blocks[pair]
            opened = (bounds[d] + np.bincount(block, w * self.maxima[pair], bounds.shape[1])) * (1 + 1e-9) >= floor[d]
            kept = np.flatnonzero(opened[block])
            pair = pair[kept]
            at, times = spans(self.postings[pair], self.postings[pair + 1])
            others = np.bincount(self.places[at], np.repeat(w[kept], times) * self.values[at], n_examples)
            cosine = found[d] + others
            # No true cosine is farther than this from the one found; rounding to 12 places is part of it.
            off = 2 * error * bounds[d].max() + 1e-9
            near = np.flatnonzero((cosine >= floor[d] - off) & (cosine > 0))
            near = near[opened[near // BLOCK]]
            if len(near) > k:
                about = cosine[near]
                near = near[about >= np.partition(about, len(near) - k)[len(near) - k] - 2 * off]
            mine = slice(own_ends[d], own_ends[d + 1])
            # Equal vectors must tie, whatever the order of their sums.
            cosine = np.round(self.matrix[near[:, None], columns[mine]] @ own_v[mine] + others[near], 12)
            order = np.argsort(-cosine, kind="stable")[:k]
            order = order[cosine[order] >= 1e-12]
            cosines[d, : len(order)], places[d, : len(order)] = cosine[order], near[order]
        return cosines, places

    def judge(self, texts: list[str], numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            rows, terms, counts = sparse_counts(part, numbers, len(self.terms))
            parts.append(self.search(rows, terms, self.vectors(rows, terms, counts, len(part)), len(part)))
        c, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(self.y):
            return np.full(len(texts), self.base), c, p
        weight = np.where(p >= 0, self.votes[p] / (1.05 - np.minimum(c, 1)), 0)
        return ((weight * self.y[p]).sum(1) + 0.5 * self.base) / (weight.sum(1) + 0.5), c, p


def word_standing(examples: DataFrame) -> DataFrame | None:
    """Each term with the number of toxic examples that have it and its z; None without examples of both classes."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch["y"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = sorted({t for w in set(text.split()) for t in terms_of(w)} - {""})
                yield pa.RecordBatch.from_pydict({"word": pa.array(found, pa.string()), "y": pa.array([y] * len(found), pa.int32())})

    size = {r.y: r.n for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return None
    n1, n0 = float(size[1]), float(size[0])
    seen = examples.select("y", "text").mapInArrow(words, "word string, y int").groupBy("word")
    seen = seen.agg(F.sum(F.col("y")).alias("a"), F.sum(1 - F.col("y")).alias("b"))
    share = (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    z = (F.col("a") / n1 - F.col("b") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return seen.withColumn("z", z)


def standing_out(examples: DataFrame, max_terms: int, least_z: float) -> list[str]:
    """Words whose share of toxic examples is above that of the others by at least ``least_z`` standard errors."""
    seen = word_standing(examples)
    if seen is None:
        return []
    rows = seen.where(F.col("a") >= 2).where(F.col("z") >= least_z).orderBy(F.desc("z"), "word").limit(max_terms).collect()
    return [r.word for r in rows]


def document_frequencies(docs: DataFrame, terms: dict[str, int], text: str) -> tuple[np.ndarray, int]:
    sent, n_terms = docs.sparkSession.sparkContext.broadcast(terms), len(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, total = Numbers(sent.value), np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            texts = batch[0].to_pylist()
            for at in range(0, len(texts), 256):
                part = [t or "" for t in texts[at : at + 256]]
                total += np.bincount(sparse_counts(part, numbers, n_terms)[1], minlength=n_terms + 1)
                total[-1] += len(part)
        found = np.flatnonzero(total)
        for at in range(0, len(found), 50_000):
            own = found[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"term": own, "n": total[own]})

    rows = docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(n_terms + 1, np.int64)
    total[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return total[:-1], int(total[-1])


def fit_whole(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", per_class: int = 3000, k: int = 15) -> WholeIndex:
    """The index over all words of all sampled examples."""
    train = settle(training_labels(labels, label))
    sizes = class_sizes(train)
    examples = settle(sample(docs, train, per_class, text))
    seen = word_standing(examples)
    if seen is None:
        # Nothing to tell apart: every example has the one label there is, whatever its words.
        y = 1.0 if sizes[1] else 0.0
        n = sizes[1] if sizes[1] else sizes[0]
        none = np.empty(0, np.int64)
        return WholeIndex({}, np.empty(0), none, np.empty(0), np.empty(0), none, np.zeros((0, 0)), np.zeros(1, np.int64), none, np.empty(0), np.zeros(1, np.int64), none, np.empty(0), y * n / (n + 1.0), k)
    standing = seen.select("word", F.when(F.col("a") >= 2, F.greatest("z", F.lit(0.0))).otherwise(0.0).alias("z")).orderBy("word").toArrow()
    terms = {w: i for i, w in enumerate(standing["word"].to_pylist())}
    n_terms = len(terms)
    found, n_docs = document_frequencies(docs, terms, text)
    weights = np.log(1 + n_docs / (1.0 + found)) * (1 + standing["z"].to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, term, n = sparse_counts(part["text"].to_pylist(), numbers, n_terms)
                ends = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, n)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["y"], *lists], names=["doc_id", "y", "term", "n"])

    rows = examples.select("doc_id", "y", "text").mapInArrow(counted, "doc_id long, y int, term array<int>, n array<int>").orderBy("doc_id").toArrow().combine_chunks()
    ids, y = rows["doc_id"].to_numpy(), rows["y"].to_numpy().astype(np.float64)
    drawn = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    worth = np.where(y == 1, sizes[1] / drawn[1], sizes[0] / drawn[0])
    base = float((worth * y).sum() / (worth.sum() + 1.0))
    lengths = np.array([len(x) for x in rows["term"]], np.int64)
    place = np.repeat(np.arange(len(ids)), lengths)
    term, n = (np.concatenate([np.empty(0, np.int64), *(x.values.to_numpy() for x in rows[c])]) for c in ("term", "n"))
    v = (1 + np.log(n)) * weights[term]
    v /= np.sqrt(np.bincount(place, v * v, len(ids)))[place]
    # Examples with the same strongest terms share blocks, which keeps the maxima tight.
    by_weight = np.lexsort((term, -v, place))
    first = np.cumsum(lengths) - lengths
    strongest = [np.where(lengths > i, term[by_weight][np.minimum(first + i, len(term) - 1)], -1) for i in (0, 1)]
    order = np.lexsort((ids, strongest[1], strongest[0]))
    place = np.argsort(order)[place]
    ids, y, worth = ids[order], y[order], worth[order]
    held_by = np.bincount(term, minlength=n_terms)
    many = np.flatnonzero(held_by * 16 > len(ids))
    common = np.full(n_terms, -1, np.int64)
    common[many] = np.arange(len(many))
    matrix = np.zeros((len(ids), len(many)))
    dense = common[term] >= 0
    matrix[place[dense], common[term[dense]]] = v[dense]
    term, place, v = term[~dense], place[~dense], v[~dense]
    order = np.lexsort((place, term))
    term, place, v = term[order], place[order], v[order]
    n_blocks = -(-len(ids) // BLOCK)
    pair, starts = np.unique(term * n_blocks + place // BLOCK, return_index=True)
    maxima = np.maximum.reduceat(v, starts) if len(v) else np.empty(0)
    pairs = np.searchsorted(pair // n_blocks, np.arange(n_terms + 1))
    return WholeIndex(terms, weights, ids, y, worth / worth.max(), common, matrix, pairs, pair % n_blocks, maxima, np.append(starts, len(v)), place, v, base, k)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", per_class: int = 3000, max_terms: int = 512, least_z: float = 5.0, k: int = 15) -> Index:
    train = settle(training_labels(labels, label))
    sizes = class_sizes(train)
    examples = settle(sample(docs, train, per_class, text))
    terms = {w: i for i, w in enumerate(standing_out(examples, max_terms, least_z))}
    found, n_docs = document_frequencies(docs, terms, text)
    idf = np.log(1 + n_docs / (1.0 + found))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(terms)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for at in range(0, len(texts), 256):
                x = term_counts(texts[at : at + 256], numbers, len(terms))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"].slice(at, 256),
                        "y": batch["y"].slice(at, 256),
                        "counts": pa.array([r.astype("<f4").tobytes() for r in x], pa.binary()),
                    }
                )

    rows = examples.select("doc_id", "y", "text").mapInArrow(vectors, "doc_id long, y int, counts binary").orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r.counts, "<f4") for r in rows]).reshape(len(rows), len(terms))
    y = np.array([r.y for r in rows], np.float64)
    ids = np.array([r.doc_id for r in rows], np.int64)
    drawn = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    worth = np.where(y == 1, sizes[1] / drawn[1], sizes[0] / drawn[0])
    without = x.sum(1) == 0
    base = float((worth * y)[without].sum() / (worth[without].sum() + 1.0))
    plan = Index(terms, idf, ids, y, worth, [], np.zeros((0, len(terms))), base, k)
    v = plan.vectors(x)[~without]
    ids, y, worth = ids[~without], y[~without], worth[~without]
    # Examples with the same strongest terms share blocks, which keeps the maxima tight.
    strongest = v.argsort(axis=1)[:, ::-1][:, :2] if len(terms) else np.zeros((len(v), 2), np.int64)
    order = np.lexsort((ids, strongest[:, -1], strongest[:, 0])) if len(v) else np.empty(0, np.int64)
    v, ids, y, worth = v[order], ids[order], y[order], worth[order]
    postings, maxima = [], []
    for at in range(0, math.ceil(len(v) / BLOCK)):
        part = v[at * BLOCK : (at + 1) * BLOCK]
        place, term = np.nonzero(part)
        postings.append((place, term, part[place, term]))
        maxima.append(part.max(0))
    return Index(terms, idf, ids, y, worth / worth.max() if len(worth) else worth, postings, np.array(maxima).reshape(len(maxima), len(terms)), base, k)


def score(docs: DataFrame, index: Index | WholeIndex, text: str = "text") -> DataFrame:
    """Add the score and the neighbours it rests on; the index is bounded by the sample."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    kept = docs.drop(text)
    names = kept.columns
    column = free_name(docs.columns, "score")
    evidence = free_name(docs.columns, "neighbours")
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType()), T.StructField(evidence, T._parse_datatype_string(NEIGHBOURS))])
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        numbers = Numbers(own.terms)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                scores, cosines, places = own.judge([t or "" for t in part[text].to_pylist()], numbers)
                held = places >= 0
                found = places[held]
                near = pa.StructArray.from_arrays([pa.array(own.doc_ids[found]), pa.array(cosines[held]), pa.array(own.y[found].astype(np.int32))], fields=list(kind.value_type))
                ends = pa.array(np.append(0, np.cumsum(held.sum(1))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), pa.array(scores), pa.ListArray.from_arrays(ends, near, kind)], names=[*names, column, evidence])

    return docs.select(*names, text).mapInArrow(judge, schema)
