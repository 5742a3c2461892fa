"""Scores learnt from labels: held-out accuracy, no use of held-out labels, defined results at the edges."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricecast.llm import neighbour_quality, toxicity
from pricecast.llm.common import held_out
from pricecast.llm.labelled import training_labels
from pricecast.llm.queries import QUERIES
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        junk, toxic = i % 4 == 0, i % 3 == 0
        text = prose(i, 80)
        text = " ".join(f"{w}###" for w in text.split()) if junk else text
        text = f"{text} you horrid nitwit" if toxic else text
        rows.append((i, text))
        labels.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (5000, None, 7)], "doc_id long, quality int, toxic int")


def test_training_labels_leave_out_what_is_held_out(labelled):
    _, labels = labelled
    train = {r.doc_id for r in training_labels(labels, "quality").collect()}
    out = {r.doc_id for r in labels.where(held_out(F.col("doc_id"))).collect()}
    assert train and out and not train & out and None not in train and 5000 not in train


def test_quality_on_held_out_documents(labelled):
    docs, labels = labelled
    voters = neighbour_quality.fit(docs, labels, per_class=100, k=5)
    assert len(voters.y) <= 200
    found = {r.doc_id: r.score for r in neighbour_quality.score(docs, voters).join(labels.where(held_out(F.col("doc_id"))), "doc_id").collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(found) > 40 and all((s >= 0.5) == bool(truth[i]) for i, s in found.items())


def test_toxicity_on_held_out_documents(labelled):
    docs, labels = labelled
    index = toxicity.fit(docs, labels, label="toxic", per_class=150)
    assert {"horrid", "nitwit"} <= set(index.terms)
    rows = toxicity.score(docs, index).join(labels.where(held_out(F.col("doc_id"))), "doc_id").collect()
    assert len(rows) > 40 and all((r.score >= 0.5) == bool(r.toxic) for r in rows)
    assert all(n.label == 1 for r in rows if r.toxic for n in r.neighbours)
    assert all(not r.neighbours for r in rows if not r.toxic)


def test_block_max_search_equals_all_cosines():
    draw = np.random.default_rng(3)
    n, terms, k = 500, 30, 7
    v = np.where(draw.random((n, terms)) < 0.1, draw.random((n, terms)), 0)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    postings, maxima = [], []
    for at in range(0, n, toxicity.BLOCK):
        part = v[at : at + toxicity.BLOCK]
        place, term = np.nonzero(part)
        postings.append((place, term, part[place, term]))
        maxima.append(part.max(0))
    index = toxicity.Index({}, np.ones(terms), np.arange(n), np.zeros(n), np.ones(n), postings, np.array(maxima), 0.0, k)
    q = v[:40]
    cosines, places = index.search(q)
    whole = q @ v.T
    for row, c, p in zip(whole, cosines, places, strict=True):
        order = np.lexsort((np.arange(n), -row))[:k]
        np.testing.assert_allclose(c, np.where(row[order] > 0, row[order], 0), atol=1e-12)
        assert all(abs(row[x] - y) < 1e-12 for x, y in zip(p, c, strict=True) if x >= 0)


def test_toxicity_over_all_words_equals_all_cosines(labelled, spark):
    docs, labels = labelled
    index = toxicity.fit_whole(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    train = {r.doc_id: r.y for r in training_labels(labels, "toxic").collect() if r.doc_id in texts}
    assert sorted(index.doc_ids) == sorted(train) and set(index.y) == {0, 1}
    held = {i: Counter(t for w in texts[i].split() for t in toxicity.terms_of(w) if t) for i in texts}
    assert set(index.terms) == {t for i in train for t in held[i]}
    assert 0 < (index.common >= 0).sum() < len(index.terms)

    frequency = Counter(t for c in held.values() for t in c)
    n = Counter(train.values())
    seen = {c: Counter(t for i in train if train[i] == c for t in held[i]) for c in (0, 1)}
    weight = {}
    for t in index.terms:
        a, b = seen[1][t], seen[0][t]
        share = (a + b + 1) / (n[1] + n[0] + 2)
        z = (a / n[1] - b / n[0]) / math.sqrt(share * (1 - share) * (1 / n[1] + 1 / n[0]))
        weight[t] = math.log(1 + len(texts) / (1 + frequency[t])) * (1 + (max(z, 0) if a >= 2 else 0))

    def vector(i):
        v = {t: (1 + math.log(c)) * weight[t] for t, c in held[i].items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    examples = {i: vector(i) for i in train}
    rows = toxicity.score(docs, index).collect()
    for r in rows:
        v = vector(r.doc_id)
        cosines = sorted((sum(x * e.get(t, 0) for t, x in v.items()) for e in examples.values()), reverse=True)[:15]
        assert [x.cosine for x in r.neighbours] == pytest.approx([c for c in cosines if c > 0], abs=1e-9)
    assert all(len(r.neighbours) == 15 for r in rows if texts[r.doc_id])
    assert {r.score for r in rows if not texts[r.doc_id]} == {index.base}
    truth = {r.doc_id: r.toxic for r in labels.where(held_out(F.col("doc_id"))).collect()}
    assert all((r.score >= 0.5) == bool(truth[r.doc_id]) for r in rows if r.doc_id in truth)


def whole_index(x, k):
    """The index of dense vectors; terms of more than a sixteenth of them are the matrix."""
    n, n_terms = x.shape
    n_blocks = -(-n // toxicity.BLOCK)
    many = np.flatnonzero((x > 0).sum(0) * 16 > n)
    common = np.full(n_terms, -1, np.int64)
    common[many] = np.arange(len(many))
    term, place = np.nonzero(np.where(common >= 0, 0, x).T)
    v = x[place, term]
    pair, starts = np.unique(term * n_blocks + place // toxicity.BLOCK, return_index=True)
    pairs = np.searchsorted(pair // n_blocks, np.arange(n_terms + 1))
    maxima = np.maximum.reduceat(v, starts)
    return toxicity.WholeIndex({}, np.ones(n_terms), np.arange(n), np.zeros(n), np.ones(n), common, x[:, many], pairs, pair % n_blocks, maxima, np.append(starts, len(v)), place, v, 0.0, k)


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def test_neighbours_closer_than_single_precision_keep_their_order():
    draw = np.random.default_rng(5)
    n, k = 700, 9
    share = np.append(np.full(30, 0.4), np.full(200, 0.02))
    x = np.where(draw.random((n, 230)) < share, draw.random((n, 230)) + 0.1, 0)
    # A hundred that differ by far less than single precision tells, some of them copies.
    x[300:400] = x[300] * (1 + 1e-8 * draw.random((100, 230)))
    x[350:360] = x[349]
    x = unit(x)
    index = whole_index(x, k)
    assert index.single.dtype == np.float32 and 0 < (index.common >= 0).sum() < 230
    q = unit(np.vstack([x[:20] + 0.1 * x[20:40], x[300:310] * (draw.random((10, 230)) + 0.5), np.zeros((1, 230)), np.eye(230)[200:202]]))
    rows, terms = np.nonzero(q)
    cosines, places = index.search(rows, terms, q[rows, terms], len(q))
    for whole, c, p in zip(q @ x.T, cosines, places, strict=True):
        order = np.argsort(-np.round(whole, 12), kind="stable")[:k]
        order = order[whole[order] >= 1e-12]
        np.testing.assert_allclose(c[: len(order)], whole[order], atol=2e-12)
        assert (p[len(order) :] == -1).all() and (c[len(order) :] == 0).all()
        # Equal to the last kept digit, two may change places.
        np.testing.assert_allclose(whole[p[: len(order)]], whole[order], atol=2e-12)
        assert len(set(p[: len(order)])) == len(order)
    assert (np.diff(cosines, axis=1) <= 0).all()
    tied = [(c, p) for c, p in zip(cosines, places, strict=True) if (np.diff(c[:k]) == 0).any()]
    assert all(p[i] < p[i + 1] for c, p in tied for i in range(k - 1) if c[i] == c[i + 1] > 0)


def test_words_are_cut_at_their_edges_and_plain_ones_without_the_pattern(monkeypatch):
    tokens = ["Word", "word,", "(Don't)", "_a_", "--", "", "\u0130", "x\u0130", "\u00abna\u00efve\u00bb", ",\u00ab,x", "a#b##", "\u4e2d\u6587\u3002", "\u00b2x\u0301", "'\u2026'", "\x7fab\x00"]
    for t in tokens:
        word = toxicity.EDGES.sub("", t.lower())
        assert toxicity.terms_of(t) == (word, f"{word[:4]}*" if len(word) > 4 else "")
    monkeypatch.setattr(toxicity, "EDGES", None)
    assert [toxicity.terms_of(t)[0] for t in ("Plain", "(plain),", "don't!", "\u00dcber.")] == ["plain", "plain", "don't", "\u00fcber"]


def test_the_toxicity_query_compares_texts_without_toxic_words(spark):
    rows = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.evidence for r in rows if len((texts[r.doc_id] or "").split()) > 20)


def test_scores_without_labels_and_documents(awkward, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["_score"] for r in neighbour_quality.score(awkward, neighbour_quality.fit(awkward, none)).collect()} == {0.5}
    assert {r["_score"] for r in toxicity.score(awkward, toxicity.fit(awkward, none)).collect()} == {0.0}
    assert neighbour_quality.score(no_docs, neighbour_quality.fit(no_docs, none)).count() == 0
    assert toxicity.score(no_docs, toxicity.fit(no_docs, none)).count() == 0


def test_awkward_rows_get_a_score(labelled, awkward):
    docs, labels = labelled
    for scored in (
        neighbour_quality.score(awkward, neighbour_quality.fit(docs, labels, per_class=50)),
        toxicity.score(awkward, toxicity.fit(docs, labels, per_class=50)),
    ):
        rows = scored.collect()
        assert len(rows) == 13 and all(0 <= r["_score"] <= 1 for r in rows)


def test_toxicity_over_all_words_at_the_edges(labelled, awkward, no_docs, spark):
    docs, labels = labelled
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["_score"] for r in toxicity.score(awkward, toxicity.fit_whole(awkward, none)).collect()} == {0.0}
    assert toxicity.score(no_docs, toxicity.fit_whole(no_docs, none)).count() == 0
    rows = toxicity.score(awkward, toxicity.fit_whole(docs, labels, per_class=50)).collect()
    assert len(rows) == 13 and all(0 <= r["_score"] <= 1 for r in rows)
    few = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert all(len(r.neighbours) <= 2 for r in toxicity.score(awkward, toxicity.fit_whole(awkward, few)).collect())


def test_the_shape_is_that_of_the_whole_word(monkeypatch):
    assert neighbour_quality.shape("a" * 64 + "0#" * 2) == "a0#0#"
    long, longer = "x" * 70, "x" * 70 + "7"
    monkeypatch.setattr(neighbour_quality, "CACHED_CHARS", 10)
    x = neighbour_quality.counts([long, longer])
    shapes = x[:, neighbour_quality.WORDS : neighbour_quality.WORDS + neighbour_quality.SHAPES]
    assert (shapes[0] != shapes[1]).any()
    again = neighbour_quality.counts([longer])
    assert set(neighbour_quality._terms) == {longer} and (again[0] == x[1]).all()
