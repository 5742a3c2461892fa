"""Prefix trie, ranked search and packing against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricecast.llm import packing, prefix_trie, ranked_search, words

WORDS = public_tokenizers.path("word_bpe_49k.json")


def brute_trie(rows):
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            given[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in given.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    value = {n: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n, m in members.items()}
    leaves, saved = Counter(), Counter()
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += value[n]
    out = []
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == n)))
        parent = min(members[n[:-1]]) if n else None
        out.append((min(m), len(n), parent, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def turns():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3 if t < 3 else c}") for c in range(-45, 90) for t in range(abs(c) % 6)]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 240) for t in range(5)]  # one large group of copies
    rows += [(500, t, "user", f"long {t}  with\twords") for t in range(400)] + [(501, t, "user", f"long {t}  with\twords") for t in range(150)]
    rows += [(None, 0, "user", "lost"), (300, None, None, None), (300, 0, None, "x"), (300, 0, "a", "x"), (301, 0, "user", ""), (301, 0, "user", "")]
    return rows + [(7, 1, "user", "again")] * 3


@pytest.mark.parametrize("single_shard, queue_limit", [(100_000, 100_000), (5, 3)])
def test_trie_equals_brute_force(spark, single_shard, queue_limit):
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string").repartition(7).withColumn("depth", F.lit("clash"))
    got = prefix_trie.trie(df, single_shard=single_shard, queue_limit=queue_limit)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(turns())


def test_trie_of_no_conversations_and_of_one_without_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    (root,) = prefix_trie.trie(spark.createDataFrame([(c, 0, "user", "gone with the head")], schema)).collect()
    assert tuple(root)[:7] == (c, 0, None, 1, 0, 1, 0) and root.ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest()


def test_spilling_queue_gives_all_messages_in_order():
    draw = np.random.default_rng(1)
    sent = [(int(a), int(b), 0, 1, int(b)) for a, b in draw.integers(-20, 20, (500, 2))]
    queue = prefix_trie.SpillingQueue(7)
    for m in sent:
        queue.push(m)
    for place in sorted({m[:3] for m in sent}):
        want = [m for m in sent if m[:3] == place]
        assert queue.take(*place) == (len(want), sum(m[4] for m in want))
    assert queue.spilled > 10 and not queue.heap and not queue.runs


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranked(docs, items, k):
    cut = [(d, Counter(lowered(t))) for d, t in docs if lowered(t)]
    n, total = len(cut), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in cut:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in lowered(text) if c[t])
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 40, "group_cells": 1}])
def test_ranked_search_equals_brute_force(spark, awkward, settings):
    draw = np.random.default_rng(3)
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    docs += [(100 + i, " ".join(f"w{j}" for j in draw.zipf(1.4, 40) if j < 200)) for i in range(400)]
    docs += [(1000 + i, "W1 w2, ÄHRE İx w3") for i in range(30)]  # equal scores
    items = [(1, "w1 w2 w2 w9 w30 Ähre"), (2, None), (3, ""), (4, "nothing of it here"), (None, "w5-w6"), (6, " ".join(f"w{j}" for j in range(90))), (7, "to the of and word")]
    items_df = spark.createDataFrame([*items, (4, "zzz"), (6, items[5][1])], "item_id long, text string").withColumn("rank", F.lit("clash"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("score", F.lit("clash"))
    got = ranked_search.ranked(df, items_df, 7, **settings)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ranked(docs, items, 7)


def test_ranked_search_of_empty_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ranked_search.ranked(no_docs, items).count() == 0
    assert ranked_search.ranked(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def library(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_are_encoded_as_whole_texts(monkeypatch):
    monkeypatch.setattr(words, "REMEMBERED", 300)
    draw = np.random.default_rng(8)
    signs = [" ", "\n", "\t", " ", ",", ".", "'s", "'S", "İ", "Éa", "ab", "Zq", "é", "<|endoftext|>", "12", "中", "☃", "-", "|", "̸", "ß"]
    texts = ["".join(draw.choice(signs, draw.integers(0, 60))) for _ in range(400)]
    encoder = words.WordEncoder(WORDS)
    got = [i.tolist() for at in range(0, len(texts), 50) for i in encoder.encode(texts[at : at + 50])]
    assert got == library(texts)


def round_robin(sizes, weights, window, packet, deficit):
    """The stream as (queue, place in the queue) pairs, one visit after the other."""
    unit, sent, out, before = packing.UNIT, [0] * len(sizes), [], None
    while any(s < n for s, n in zip(sent, sizes, strict=True)):
        now = [q for q, n in enumerate(sizes) if sent[q] < n]
        if now != before:
            total = sum(weights[q] for q in now)
            quantum = {q: max(1, round(window * unit * weights[q] / total)) for q in now}
            before = now
        for q in now:
            deficit[q] += quantum[q]
            while sent[q] < sizes[q] and deficit[q] >= (size := min(packet, sizes[q] - sent[q])) * unit:
                out += [(q, sent[q] + i) for i in range(size)]
                sent[q] += size
                deficit[q] -= size * unit
    return out


@pytest.mark.parametrize("sizes, weights", [([900, 300, 37, 1, 0], [900, 300, 37, 1, 1]), ([200, 700, 50], [5, 1, 3.5]), ([13], [1]), ([1000, 1000], [1, 1e-9])])
def test_round_robin_in_closed_form_equals_the_loop(sizes, weights):
    plan = packing.Plan.of(sizes, weights, 64, 16)
    want = round_robin(sizes, weights, 64, 16, plan.deficit[0].tolist())
    got = [None] * sum(sizes)
    for q, n in enumerate(sizes):
        if n:
            cuts = sorted({0, n, *np.random.default_rng(q).integers(0, n, 9).tolist()})
            run, x, y, place = plan.visits(q, np.array(cuts[:-1]), np.array(cuts[1:]))
            for a, b, p in zip(x, y, place, strict=True):
                for i in range(b - a):
                    assert got[p + i] is None
                    got[p + i] = (q, a + i)
    assert got == want


def check_packing(docs, got, window, sources=None):
    """Every id in one piece, sequences without gaps, full or of a power of two."""
    ids = library([t or "" for _, t in docs])
    whole = Counter((d, np.array([*i, 1], "<u4").tobytes()) for (d, _), i in zip(docs, ids, strict=True))
    rows = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    at, filled = 0, defaultdict(int)
    for r in rows:
        assert r.offset == filled[r.sequence_id] and r.length > 0 and len(r.ids) == 4 * r.length
        filled[r.sequence_id] += r.length
    assert sorted(filled) == list(range(len(filled)))
    assert all(n == window or n & (n - 1) == 0 for n in filled.values()) and all(n <= window for n in filled.values())
    assert sum(filled.values()) == sum(len(b) // 4 * n for (_, b), n in whole.items())
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length, r.ids, r.doc_tokens))
    for d, n in Counter(d for d, _ in docs).items():
        if n == 1:
            pieces = sorted(by_doc[d])
            text = b"".join(p[2] for p in pieces)
            assert whole[(d, text)] == 1 and all(p[3] == len(text) // 4 for p in pieces)
            assert [p[0] for p in pieces] == np.cumsum([0, *[p[1] for p in pieces]])[:-1].tolist()


def test_packing_of_awkward_and_empty_tables(awkward, no_docs):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    for queues in (256, 2, 1):
        got = packing.packed(awkward.withColumn("offset", F.lit("clash")), WORDS, window=256, packet=32, queues=queues).collect()
        check_packing(docs, got, 256)
    assert packing.packed(no_docs, WORDS).count() == 0


def test_windows_hold_the_target_proportions(spark):
    draw = np.random.default_rng(4)
    docs = [(i, "s" + str(min(3, int(draw.integers(0, 8)))), " ".join(["word"] * int(draw.integers(1, 300)))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(6)
    weights = {"s0": 4.0, "s1": 3.0, "s2": 2.0, "s3": 1.0}
    got = packing.packed(df, WORDS, weights=weights, window=512, packet=16).collect()
    check_packing([(d, t) for d, _, t in docs], got, 512)
    left = Counter()
    for r in got:
        left[r.source] = max(left[r.source], r.sequence_id)
    first_out = min(left.values())
    held = defaultdict(Counter)
    for r in got:
        held[r.sequence_id][r.source] += r.length
    assert first_out > 20
    for s in range(first_out):
        assert all(abs(held[s][source] - 51.2 * w) <= 48 for source, w in weights.items())
    # Over all windows so far the difference does not grow: deficits are carried.
    for source, w in weights.items():
        assert abs(sum(held[s][source] for s in range(first_out)) - first_out * 51.2 * w) <= 48
    with pytest.raises(ValueError):
        packing.packed(df, WORDS, weights={"s0": 1.0})


def test_sequences_hold_the_ids_of_their_pieces(spark):
    df = spark.createDataFrame([(i, "a", "some words " * i) for i in range(1, 60)], "doc_id long, source string, text string")
    pieces = packing.packed(df, WORDS, window=128, packet=32)
    rows = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    for p in pieces.collect():
        whole = rows[p.sequence_id]
        assert bytes(whole.ids)[4 * p.offset : 4 * (p.offset + p.length)] == bytes(p.ids)
        assert (p.offset, p.doc_id, p.start, p.length) in [tuple(d) for d in whole.documents]
