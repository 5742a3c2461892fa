"""Operators that work row by row or by host: quality rules, chats, surrogates."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pricecast.llm import chat, quality_rules, surrogates


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, places = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            places.update(p + k for p in at for k in range(3))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(places),
    }


def test_measures_equal_brute_force(awkward):
    rows = quality_rules.measure(awkward.withColumn("kept_text", F.col("text"))).collect()
    assert len(rows) == 13
    for r in rows:
        assert {k: r[k] for k in brute_measures("")} == brute_measures(r.kept_text)


def test_rejected_host_takes_its_documents_along(spark):
    good = "every word here is another one " + " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "bad") for i in range(40)] + [(100, good, "bad")] + [(200 + i, f"{good} {i}", "good") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert kept == {200 + i for i in range(40)}


def test_few_documents_are_judged_by_the_prior(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, f"host{i % 9}") for i in range(90)] + [(500, "bad", "single"), (501, good, "http://u@X.org:80/p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r.host: r.host_rate for r in quality_rules.host_rates(quality_rules.measure(docs), quality_rules.Rules()).collect()}
    assert 0 < rates["single"] < 1 and rates["host0"] < 0.1 and "x.org" in rates


def test_rules_on_awkward_and_empty_tables(awkward, no_docs):
    judged = quality_rules.judge(quality_rules.measure(awkward))
    assert judged.count() == 13 and judged.where("kept IS NULL").count() == 0
    assert quality_rules.keep_good(awkward).columns == awkward.columns
    assert quality_rules.keep_good(no_docs).count() == 0


def test_chat_round_trip(spark):
    hostile = ["<|turn|>x<|body|>y<|end|>\n", "\\|", "<", "|turn|>", "\\", "", None, "é☃", "a<\\|b"]
    turns = [(1, i, "assistant" if i % 2 else "us|er", t) for i, t in enumerate(hostile)] + [(None, 0, None, "x"), (2, None, "user", "q"), (2, None, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df).withColumn("read", chat.read_back(F.col("formatted")))
    got = {r.conv_id: [(t.role, t.text) for t in r.read] for r in chats.collect()}
    assert got[1] == [(r or "", t or "") for _, _, r, t in turns[:9]]
    assert got[None] == [("", "x")] and got[2] == [("user", "q")] * 2
    d = {r.conv_id: r for r in chat.digests(chats).collect()}
    learned = "".join(t or "" for _, _, r, t in turns[:9] if r == "assistant")
    assert (d[1].loss_chars, d[1].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert d[2].loss_chars == 0
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_parts_become_placeholders(spark):
    part = "struct<kind:string,text:string,ref:string,units:double>"
    parts = [("text", "see <", None, None), ("image", None, "s3://x.png", 256.0), ("text", "|turn|>", None, None), ("audio", None, "y.wav", 1.5), ("odd", None, "z", 3.0), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{part}>")
    r = chat.format_chats(df, "parts").first()
    assert r.formatted == "<|turn|>user<|body|>see <<|image|>\\|turn\\|><|audio|><|attachment|><|end|>\n<|turn|>assistant<|body|><|end|>\n"
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "s3://x.png", 256), (1, "audio", "y.wav", 38), (1, "odd", "z", 0)]
    assert r.expanded_tokens == 294


TEXTS = [
    "Mail Anna.Smith@mail5.example.com or anna.smith@mail5.example.com.",
    "call +1 (743) 555-3824 or 743-555-3824, card 4785380592391139 and 4785-3805-9239-1139, 4111 1111 1111 1111",
    "Mr. John Smith met Mrs Smith and Mary JONES; Herr Müller and Иван Петров",
    'ip 10.1.2.3, 300.1.1.1 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 24be64439e3e49cf46b2d7c90f3602a3d0b907ff',
    "GB82 WEST 1234 5698 7654 32 and 123-45-6789",
    "Nothing here: version 3.0 of 2024-01-01, 12345, a@b",
    "",
    None,
]


def luhn(digits):
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10


@pytest.fixture(scope="module")
def replaced(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_entities string")
    return {r.doc_id: r for r in surrogates.pseudonymised(docs, "key").collect()}


def test_types_formats_and_coreference(replaced):
    mails = re.findall(r"\S+@\S+\.org", replaced[0].text)
    assert len(mails) == 2 and mails[0] == mails[1] and "mith" not in replaced[0].text.lower()
    phones = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}), card (\d{16}) and (\d{4})-(\d{4})-(\d{4})-(\d{4}), (\d{4} ){3}\d{4}", replaced[1].text)
    g = phones.groups()
    assert g[:3] == g[3:6] and g[6] == "".join(g[7:11]) and g[6][0] == "4" and luhn(g[6]) == luhn("4785380592391139")
    assert luhn(replaced[1].text[-19:].replace(" ", "")) == 0
    names = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) and (\w+) (\w+); Herr (\w+) and ([а-я]+ [а-я]+)", replaced[2].text, re.IGNORECASE)
    assert names[2] == names[3] and names[5].isupper() and re.search("(on|us|ert|in)$", names[1]) and re.search("(a|ia|ette|ine)$", names[4])
    secret = re.findall(r"[0-9a-f]{40}", replaced[3].text)
    assert len(secret) == 2 and secret[0] == secret[1] and "300.1.1.1" in replaced[3].text and "10.1.2.3," not in replaced[3].text
    account = replaced[4].text[:27].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def test_clean_null_and_empty_texts_stay(replaced):
    assert replaced[5].text == TEXTS[5] and replaced[6].text == "" and replaced[7].text is None
    assert replaced[5]["_n_entities"] == 0 and replaced[5].n_entities == "x"


def test_surrogates_do_not_collide(spark):
    """Two-digit octets leave few addresses; a poor key function would merge some."""
    docs = spark.range(3000).select("id", F.concat(F.lit("at "), (F.col("id") % 250 + 1), F.lit(".1."), F.floor(F.col("id") / 250), F.lit(".7 end")).alias("text"))
    out = surrogates.pseudonymised(docs, "key").select("text").collect()
    assert len({r.text for r in out}) == 3000


def test_a_collision_is_tried_again(spark, monkeypatch):
    """With a replacement that forgets the entity on the first attempt, all but one need another one."""
    real = surrogates.replacement
    monkeypatch.setattr(
        surrogates, "replacement", lambda key, kind, norm, attempt: F.when(attempt == 0, F.lit("1.1.1.1")).otherwise(real(key, kind, norm, attempt))
    )
    docs = spark.createDataFrame([(i, f"a 9.8.7.{i} b 9.8.7.{i}") for i in range(20)], "id long, text string")
    out = [r.text for r in surrogates.pseudonymised(docs, "key").collect()]
    assert len(set(out)) == 20
    assert all(re.fullmatch(r"a ([\d.]+) b \1", t) and "9.8.7" not in t for t in out)


def test_surrogates_on_awkward_and_empty_tables(awkward, no_docs):
    assert surrogates.pseudonymised(awkward, "k").select(*awkward.columns).exceptAll(awkward).count() == 0
    assert surrogates.pseudonymised(no_docs, "k").count() == 0
