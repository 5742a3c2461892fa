"""Ids with several texts, and groups whose members are alike but not linked."""

import random

import numpy as np
from pyspark.sql import functions as F

from pricecast.llm import near_dedup

from .conftest import prose


def test_an_id_with_two_texts_loses_no_row(spark):
    a, b = prose(21, 100), prose(22, 100)
    rows = [(1, a), (5, a + " tail"), (5, b), (9, b + " end"), (5, b), (7, None), (7, ""), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.deduplicated(df).collect())
    n = [len(near_dedup.shingles(t, 5)) for t in (a, a + " tail", b, b + " end")]
    assert got == sorted([(1, n[0], 1, True), (5, n[1], 1, False), (5, n[2], 5, True), (5, n[2], 5, True), (9, n[3], 5, False), (7, 0, 7, True), (7, 0, 7, True), (0, n[0], 0, True)])
    stays = sorted((r.doc_id or 0, r.text or "") for r in near_dedup.one_of_each(df).collect())
    assert stays == sorted([(1, a), (5, b), (7, ""), (7, ""), (0, a)])


def edited(seed: int, base: list[str], edits: int) -> str:
    draw, words = random.Random(seed), list(base)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"edit{draw.randrange(10**9)}"
    return " ".join(words)


def test_candidates_of_a_group_of_similar_texts_stay_linear(spark, monkeypatch):
    """Texts with six edits each are 0.6 to 0.8 alike: few pairs are linked, nearly all look like candidates."""
    base = prose(5, 400).split()
    texts = [edited(i, base, random.Random(i).choice([2, 4, 6])) for i in range(240)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    counted = []
    real = near_dedup.confirmed

    def confirmed(pairs, sets, settings):
        counted.append(pairs.count())
        return real(pairs, sets, settings)

    monkeypatch.setattr(near_dedup, "confirmed", confirmed)
    settings = near_dedup.Settings(leaf=60)
    got = {r.doc_id: r.component_id for r in near_dedup.deduplicated(df, settings).collect()}
    sets = [near_dedup.shingles(t, 5) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in range(len(texts))}
    assert sum(counted) < 40 * len(texts)


def test_what_leaves_a_node_is_linear_in_its_members(spark, monkeypatch):
    """Of 300 similar texts each goes with its set to the places of pairs of blocks, not to all its nodes."""
    base = prose(8, 300).split()
    texts = [edited(i, base, 1 + i % 7) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    settings = near_dedup.Settings(leaf=60)
    met, real_links = [], near_dedup.linked_in_nodes

    def linked_in_nodes(rows, settings):
        met.append(rows.groupBy("id").count().agg(F.max("count"), F.sum("count")).first())
        return real_links(rows, settings)

    monkeypatch.setattr(near_dedup, "linked_in_nodes", linked_in_nodes)
    got = {r.doc_id: r.component_id for r in near_dedup.deduplicated(df, settings).collect()}
    assert len(met) == 1
    sets = [near_dedup.shingles(t, 5) for t in texts]
    common, n = near_dedup.common_counts(sets), np.array([len(x) for x in sets])
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(0, 300, 17) for j in range(300) if i != j)
    linked = (100 * common >= 80 * (n[:, None] + n - common)) | np.eye(300, dtype=bool)
    low, before = np.arange(300), None
    while not np.array_equal(low, before):
        low, before = np.where(linked, low, 300).min(axis=1), low
    low = low.tolist()
    assert got == dict(enumerate(low))
    # Five blocks at most meet five others; a spanning forest has fewer links than members.
    assert met[0][0] <= 2 * 5 and met[0][1] <= 10 * 300
    a, b = near_dedup.forest(np.arange(300), np.arange(300), sets, settings)
    assert len(a) < 300 and len(set(zip(a, b, strict=True))) == 300 - len(set(low))


def test_each_member_meets_the_hub_most_like_it(spark):
    settings = near_dedup.Settings(coordinates=8, trees=1)
    sigs = [np.full(8, 1, np.uint32)] * 6
    rows = [(5, i, i, 10, s.tobytes()) for i, s in enumerate(sigs)] + [(5, 6 + i, 6 + i, 10, np.r_[np.full(6, 1), 50 + i, 60 + i].astype(np.uint32).tobytes()) for i in range(6)]
    members = spark.createDataFrame([(n, i, g, k, bytearray(s)) for n, i, g, k, s in rows], "node long, id long, g long, n long, sig binary")
    pairs = near_dedup.hub_links(members, settings).collect()
    assert 0 < len(pairs) <= len(rows)


def test_a_node_stays_whole_behind_a_join_on_it(spark):
    """Without a shuffle of its own, rows of a node could be dealt to several tasks by a join turned into a broadcast."""
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("node"))
    joined = rows.join(rows.groupBy("node").count().hint("merge"), "node")
    rows = joined.select("node", "id", F.col("id").alias("g"), F.col("id").alias("n"), F.lit(b"x" * 64).alias("brief"))
    plan = near_dedup.compared(rows, near_dedup.Settings())._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan


def test_levels_taken_at_once_equal_single_levels(spark):
    draw = np.random.default_rng(4)
    rows = [(i, bytearray(draw.integers(0, 3, 64).astype(np.uint32).tobytes())) for i in range(40)]
    settings = near_dedup.Settings(trees=3)
    signed = spark.createDataFrame(rows, "id long, sig binary")
    one = near_dedup.branched(signed, settings, 1)
    for _ in range(2):
        one = near_dedup.branched(one.join(signed, "id").select("node", "id", "sig"), settings, 1)
    at_once = near_dedup.branched(signed, settings, 3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, at_once.collect()))
