"""Token files, pieces, mixtures and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricecast.llm import mixing, pieces, rans, surrogates, token_store
from pricecast.llm.queries import QUERIES
from tests.llm.conftest import prose
from tests.llm.test_rows import brute_measures
from tests.llm.test_search import brute_components

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCRAPS = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "the", "123", "!", "\r\n", "\xa0", "中", "<s>", "<|endoftext|>", "ing,", "☃", "é", "x" * 20, "\x00", "\x1c", "#", "Ⅷ"]


def scraps(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(SCRAPS) for _ in range(draw.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize(("n", "lanes", "steps"), [(0, 4, 2), (1, 4, 2), (37, 4, 2), (5000, 64, 7), (5000, 1, 1000)])
def test_blocks_decode_by_segment(n, lanes, steps):
    draw = np.random.default_rng(n)
    ids = (draw.exponential(300, n)).astype(np.uint32) % 3000
    seen, counts = np.unique(np.r_[ids, 2999], return_counts=True)
    table = rans.Frequencies.of_counts(seen, counts, bits=13)
    assert table.share.sum() == 2**table.bits
    record = rans.pack(np.array([5, 0]), np.array([1, 0]), np.array([n, 0]), ids, 17, table, lanes, steps)
    block = rans.unpack(record)
    assert (block.start, block.doc_ids.tolist(), block.sizes.tolist()) == (17, [5, 0], [n, 0])
    assert np.array_equal(block.ids(table, table.by_slot()), ids)
    for i in reversed(range(len(block.marks))):  # in any order, each alone
        assert np.array_equal(block.segment(i, table, table.by_slot()), ids[i * block.span : (i + 1) * block.span])
    broken = bytearray(record)
    broken[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.unpack(bytes(broken))


def test_encoder_equals_the_tokenizer():
    encoder, texts = token_store.Encoder.at(BPE), scraps(3000, 4)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    encoder.forget()
    again = encoder.encode(texts[:200])
    assert all(np.array_equal(a, b) for a, b in zip(again, encoder.encode(texts[:200]), strict=True))


def test_token_files_round_trip(awkward, no_docs):
    got = token_store.stored_tokens(awkward, BPE, end_id=2, block_ids=500, lanes=8, steps_per_segment=5).orderBy("start").collect()
    encoder = token_store.Encoder.at(BPE)
    rows = sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start) == (r.doc_id, at)
        assert zlib.crc32(g.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_store.stored_tokens(no_docs, BPE, end_id=2).count() == 0


@pytest.fixture(scope="module")
def processor():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("dictionary", [0, 5, 100_000])
def test_pieces_equal_the_library(spark, processor, dictionary):
    texts = [*scraps(150, 9), prose(3, 300), None, "", "x" * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ids long, text string")
    encoded = pieces.encode(docs, PIECES, dictionary=dictionary)
    rows = pieces.decode(encoded, PIECES, ids="_ids").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["_ids"] == processor.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_words_merged_together_equal_words_alone():
    model, draw = pieces.Model.load(PIECES), random.Random(5)
    letters = "▁ \n中abcdehtZ😀éñ,.12\ud800"
    words = ["".join(draw.choice(letters) for _ in range(draw.choice([1, 2, 5, 6, 7, 13, 24, 48, 49, 90]))) for _ in range(3000)]
    words += [w for t in scraps(500, 11) for w in pieces.words_of(t)] + ["", "t" * 48]
    flat, sizes = model.merged_many(words)
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [model.merged(w) for w in words]
    assert [len(x) for x in model.merged_many([])] == [0, 0]


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    model, texts = pieces.Model.load(PIECES), scraps(300, 12)
    for fold, rule in (("merges", model.merged), ("viterbi", model.best_path)):
        known = pieces.Known(model, fold, ["▁the"], np.array([0, len(rule("▁the"))]), np.array(rule("▁the"), np.int32))
        for at in range(0, len(texts), 10):
            for t, ids in zip(texts[at : at + 10], known.encode(texts[at : at + 10]), strict=True):
                assert ids.tolist() == [i for w in pieces.words_of(t) for i in rule(w)]
            assert len(known) == len(known.starts) - 1


def test_viterbi_finds_the_best_path(spark):
    texts = scraps(60, 10)
    model = pieces.Model.load(PIECES)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in pieces.encode(docs, PIECES, fold="viterbi").collect():
        assert r.ids == [i for w in pieces.words_of(r.text) for i in model.best_path(w)]
    value = {i: s for i, s in enumerate(model.scores)}
    for w in {w for t in texts for w in pieces.words_of(t) if all(c in model.ranks for c in w)}:
        assert sum(value[i] for i in model.best_path(w)) >= sum(value[i] for i in model.merged(w)) - 1e-6


def test_pieces_on_an_empty_table(no_docs):
    assert pieces.encode(no_docs, PIECES).count() == 0


def test_schedule_keeps_within_a_block():
    for weights, cycle in (({"a": 5.0, "b": 3.0, None: 1.0}, 100), ({str(i): 1.0 + i for i in range(30)}, 1000), ({"x": 1.0}, 10), ({"big": 1e6, "tiny": 1.0}, 50)):
        slots = mixing.shares(weights, cycle)
        order = mixing.schedule(slots)
        assert Counter(order) == slots and min(slots.values()) >= 1
        n, seen = len(order), Counter()
        for t, s in enumerate(order, 1):
            seen[s] += 1
            assert all(abs(seen[x] - t * slots[x] / n) < 1 for x in slots)
    with pytest.raises(ValueError, match="positive"):
        mixing.shares({"a": 0.0}, 10)


def test_mixture_gives_every_document_and_the_weights(spark, awkward, no_docs):
    rows = [(i, f"t{i}", "a" if i < 200 else "b" if i < 260 else None) for i in range(275)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("slot", F.lit(1))
    got = mixing.mixed(docs, {"a": 2.0, "b": 1.0, None: 1.0, "absent": 9.0}, block=4, rows_per_bucket=10).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(got)))
    assert {r.doc_id for r in got} == set(range(275))
    sources = [r.source for r in got[::4]]
    for t in range(1, len(sources) + 1):
        assert abs(sources[:t].count("a") - t / 2) < 1 and abs(sources[:t].count("b") - t / 4) < 1
    for s in ("a", "b", None):  # whole epochs before the next begins
        times = Counter(r.doc_id for r in got if r.source == s)
        assert max(times.values()) - min(times.values()) <= 1
    with pytest.raises(ValueError, match="no target weight"):
        mixing.mixed(docs, {"a": 1.0})
    assert mixing.mixed(awkward).select("doc_id").distinct().count() == 11
    assert mixing.mixed(no_docs).count() == 0
    ordered = mixing.in_order(mixing.mixed(docs, block=4), docs.columns)
    assert ordered.columns == docs.columns and ordered.count() >= 275


def test_pipeline_stages_against_brute_force(spark, processor):
    rows, base = [], prose(70, 90)
    for i in range(60):
        text = prose(i, 70)
        if i % 7 == 0:
            text = "too short"
        if i % 5 == 0:
            text = f"{base} tail{i}"
        if i % 11 == 3:
            text += f" write to me.{i}@mail.example.com"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    docs = spark.createDataFrame([*rows, (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    ruled = corpus_pipeline.rules(spark, docs, "")
    good = [r for r in rows if brute_measures(r[1])["n_words"] >= 50]
    assert {r.doc_id for r in ruled.collect()} == {r[0] for r in good} and ruled.columns == docs.columns
    single = corpus_pipeline.near_duplicates(spark, ruled, "")
    component, _ = brute_components([r[:2] for r in good], size=5)
    assert {r.doc_id for r in single.collect()} == {i for i, c in component.items() if i == c} and single.columns == docs.columns
    private = corpus_pipeline.private_data(spark, single, "")
    texts = {r.doc_id: r.text for r in private.collect()}
    assert not any("mail.example.com" in t for t in texts.values()) and any("example.org" in t for t in texts.values())
    clean = {r[0]: r[1] for r in good if "@" not in r[1] and r[0] in texts}
    assert all(texts[i] == t for i, t in clean.items())
    mixed = corpus_pipeline.mixture(spark, private, "")
    assert {r.doc_id for r in mixed.collect()} == set(texts) and mixed.columns == docs.columns
    encoded = corpus_pipeline.encoding(spark, mixed, "").collect()
    assert all(r.ids == processor.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids) for r in encoded)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixture", "pieces"]


def test_pipeline_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_surrogate_key_changes_the_replacement(spark):
    docs = spark.createDataFrame([("mail a.b@c.de",)], "text string")
    one, two = (surrogates.pseudonymised(docs, k).first().text for k in "xy")
    assert one != two


def test_the_mixing_query_carries_the_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text")
    got = QUERIES["op5_mixing"](spark, "/root/testdata/sf0.001").collect()
    want = mixing.mixed(docs).collect()
    assert sorted((r.position, r.doc_id, r.text_crc32) for r in got) == sorted((r.position, r.doc_id, zlib.crc32(r.text.encode())) for r in want)
