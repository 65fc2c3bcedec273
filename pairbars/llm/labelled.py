"""Held-out folds and bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column | str, folds: int, fold: int) -> Column:
    """True for ids whose crc32, taken as text, leaves ``fold``; a null id is never held out."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled documents outside the held-out fold: ``doc_id``, ``text``, ``y``.

    The choice is by a hash of the id, so it is the same on every run and
    independent of the label. The chosen ids are few (``max_rows``), so they are
    broadcast to the documents. Null labels and ids are left out; of repeated
    labels of an id the smallest counts; of repeated documents see ``one_of_each``.
    """
    ids = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")


def one_of_each(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each ``doc_id``, that with the smallest ``columns``: no more rows than ids, and the same on every run."""
    return rows.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("x")).select("doc_id", "x.*")
