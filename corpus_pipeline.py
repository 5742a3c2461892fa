"""Documents through the stages of a corpus build, each stage on all that the one before kept.

quality rules -> near duplicates -> surrogates for personal data -> mixture of sources -> pieces.

All stages but the last return the columns of documents. Between stages the documents are a table in the shared
folder. Null and repeated ids, null and empty texts and empty tables are treated as each operator states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricecast.llm import mixing, near_dedup, pieces, quality_rules, surrogates
from pricecast.sources.scratch import settle

SURROGATE_KEY = "corpus-2024"


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents, and all of rejected hosts, go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id; rows without an id stay.

    Groups are those of five-word shingles at 0.8. Rows that share an id are judged each by its own text.
    """
    return near_dedup.one_of_each(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; all documents stay."""
    return surrogates.pseudonymised(docs, SURROGATE_KEY).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources come more than once, so that shares follow the tempered weights; none goes."""
    return mixing.in_order(mixing.mixed(docs), docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_pieces and the piece ids of each row."""
    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("personal data", private_data),
    ("mixture", mixture),
    ("pieces", encoding),
]
# Near duplicates are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
