"""Quality rules at host level.

Each document is measured and judged by rules. The failures are added up by host, each host's failure rate is
shrunk towards the corpus by a beta prior that is fitted to the rates of all hosts (moments), and the verdict on
the host goes back to its documents. A host with few documents is therefore judged mostly by the prior, and a
single bad page cannot condemn it.

Only SQL functions are used. The one shuffle of the measures is the aggregate by host, combined on the map side,
so a host with a third of all rows costs one row per task. Texts are never shuffled.

Defined results: null and empty texts have no words and fail the rule on length; a null host is a host of its own;
repeated rows are judged alike, each on its own; an empty table gives an empty table; other columns pass through,
and a column of the input that has the name of a measure is replaced by the measure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast.llm.common import SPACE, whole_text
from pricecast.sources.scratch import settle

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    """Words in repeated three-word windows, of all words."""
    max_symbol_percent: int = 30
    """Symbols for each hundred words."""
    max_dup_line_percent: int = 60
    max_capital_percent: int = 50
    """A-Z among the characters of words."""
    max_host_rate: float = 0.6
    """A host whose shrunk failure rate is above is rejected as a whole."""


def host_of(source: Column) -> Column:
    """The host of an address; any other name of a source stands for itself."""
    return F.when(
        source.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"),
        F.lower(F.regexp_extract(source, "://(?:[^/?#]*@)?([^/?#:]*)", 1)),
    ).otherwise(source)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of every whole text."""
    body = whole_text(F.col(text))
    kept = [c for c in docs.columns if c.lower() not in MEASURES]
    words = docs.select(
        *kept,
        F.array_remove(F.split(body, SPACE), "").alias("_words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("_lines"),
        F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(body) - F.length(F.regexp_replace(body, "[A-Z]+", ""))).cast("long").alias("n_capitals"),
    )
    w = F.col("_words")
    n = F.size(w)
    windows = F.when(
        n > 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
    ).otherwise(F.array().cast("array<string>"))
    placed = words.withColumn("_windows", windows)
    every = F.col("_windows")
    ordered = F.when(
        F.size(F.array_distinct(every)) < F.size(every),
        F.sort_array(F.transform(every, lambda t, i: F.struct(t.alias("t"), i.alias("i")))),
    )
    placed = placed.withColumn("_ordered", ordered)
    o = F.col("_ordered")
    pairs = F.zip_with(
        F.slice(o, F.lit(1), F.size(o) - 1),
        F.slice(o, F.lit(2), F.size(o) - 1),
        lambda a, b: F.when(a["t"] == b["t"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)),
    )
    repeated = F.when(o.isNull(), F.lit(0)).otherwise(
        F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    )
    lines = F.col("_lines")
    return placed.select(
        *kept,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        "n_capitals",
    )


def failures(rules: Rules) -> dict[str, Column]:
    c = F.col
    return {
        "base_failed": (c("n_words") < rules.min_words) | (100 * c("n_repeat_words") > rules.max_repeat_percent * c("n_words")),
        "symbols_failed": 100 * c("n_symbols") > rules.max_symbol_percent * c("n_words"),
        "lines_failed": 100 * c("n_dup_lines") > rules.max_dup_line_percent * c("n_lines"),
        "capitals_failed": 100 * c("n_capitals") > rules.max_capital_percent * c("word_chars"),
    }


def host_rates(measured: DataFrame, rules: Rules, source: str = "source") -> DataFrame:
    """host, n_docs, n_failed and the shrunk rate; one row per host.

    The prior has the mean m and the variance v of the hosts' own rates: alpha + beta = m (1 - m) / v - 1. Without
    spread between hosts (or with one host) that sum is taken as 1, so the prior weighs as much as one document.
    """
    failed = None
    for f in failures(rules).values():
        failed = f if failed is None else failed | f
    hosts = measured.groupBy(host_of(F.col(source)).alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("_m"), F.var_pop(rate).alias("_v"))
    m, v = F.col("_m"), F.col("_v")
    weight = F.when(v > 1e-9, F.greatest(m * (1 - m) / v - 1, F.lit(1.0))).otherwise(F.lit(1.0))
    prior = prior.select("_m", weight.alias("_weight"))
    # The prior is one row by construction.
    return hosts.join(F.broadcast(prior)).select(
        "host",
        "n_docs",
        "n_failed",
        ((F.col("n_failed") + F.col("_m") * F.col("_weight")) / (F.col("n_docs") + F.col("_weight"))).alias("host_rate"),
    )


def judge(measured: DataFrame, rules: Rules = Rules(), source: str = "source") -> DataFrame:
    """Add the failed rules, ``host_rate`` and ``kept`` to measured documents.

    A document is kept if it fails no rule and its host is not rejected.
    """
    hosts = settle(host_rates(measured, rules, source)).select(F.col("host").alias("_host"), "host_rate")
    named = measured.withColumns(failures(rules)).withColumn("_own", host_of(F.col(source)))
    joined = named.join(hosts, F.col("_own").eqNullSafe(F.col("_host")), "left")
    failed = F.col("base_failed") | F.col("symbols_failed") | F.col("lines_failed") | F.col("capitals_failed")
    return joined.withColumn("kept", ~failed & (F.col("host_rate") <= rules.max_host_rate)).drop("_own", "_host")


def keep_good(docs: DataFrame, rules: Rules = Rules(), text: str = "text", source: str = "source") -> DataFrame:
    """The documents that pass, with the columns they came with.

    The measured documents are written once: the hosts and the verdicts both need the measures, and a filter on
    them must not be moved into their computation.
    """
    names = docs.columns
    places = [f"_{i}" for i in range(len(names))]  # no clash with a measure
    text, source = places[names.index(text)], places[names.index(source)]
    good = judge(settle(measure(docs.toDF(*places), text)), rules, source).where("kept")
    return good.select(*places).toDF(*names)
