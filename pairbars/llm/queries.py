"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairbars.llm import audit, bpe, contamination, lengths, licences, mixture, pii, quality, resample, rules, simhash, spans, toxicity
from pairbars.llm.work import table, work_dir, written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learnt from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, truncated totals and shares of documents for every context limit at which they change."""
    hist = lengths.histogram(bpe.lengths(table(spark, sf_dir, "documents"), WORD_BPE))
    return lengths.suffix_sums(written(hist, work_dir(spark), "histogram"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and the decoded text of every document."""
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE), WORD_BPE))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.train(docs)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learnt from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in strings of 400 bytes that occur more than once."""
    return spans.digests(spans.repeated_spans(table(spark, sf_dir, "documents")))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the cascade's verdict for every document."""
    return rules.judge(table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licence of every document, in a tree of sources and languages."""
    docs = licences.document_paths(table(spark, sf_dir, "documents"))
    return licences.scan(docs, licences.default_templates(spark))


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return contamination.digests(contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of every order, for each language."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document by the word statistics of the benchmark texts."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document go into a mix of the sources by weight."""
    return mixture.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_bpe": op3_bpe,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_rules": op8_rules,
    "op9_licences": op9_licences,
    "op10_contamination": op10_contamination,
    "op11_filter_audit": op11_filter_audit,
    "op12_resample": op12_resample,
    "op13_mixture": op13_mixture,
}

SQL: dict[str, str] = {
    "op8_rules": rules.SQL,
    "op9_licences": licences.SQL,
    "op10_contamination": contamination.SQL,
    "op11_filter_audit": audit.SQL,
    "op12_resample": resample.SQL,
    "op13_mixture": mixture.SQL,
}
