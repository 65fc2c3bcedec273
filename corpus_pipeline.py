"""A training-corpus pipeline of operators, each stage written as Parquet and read again.

The stages take ``documents`` (doc_id, text, lang, source, n_chars) and all but
the last return those columns; other columns are dropped. Each works on all rows
that its predecessor kept. Null texts count as empty; rows without an id are
judged by their text like any other; repeated rows are one near-duplicate group;
empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbars.llm import bpe, contamination, pii, quality, simhash
from pairbars.llm.work import table, work_dir, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of ``docs`` outside the held-out fold."""
    docs = docs.select(COLUMNS)
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id."""
    return simhash.one_of_each(docs.select(COLUMNS))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which at least one word in twenty lies in a window of a benchmark item."""
    return contamination.uncontaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the new text."""
    docs = docs.select(COLUMNS)
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and the decoded text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.decode(bpe.encode(docs, path), path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_first),
    ("decontamination", keep_clean),
    ("pii", redact),
    ("bpe", encode),
]
#: No SQL: neither trained models nor byte-pair merges can be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = table(spark, sf_dir, "documents"), work_dir(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), where, name)
    return docs
