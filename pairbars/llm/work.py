"""Shared helpers: the work folder, and text batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbars.functions.work import work_dir, written  # noqa: F401  the text operators take these from here

CHUNK_CHARS = 1 << 20


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the work folder that later ones have been made from."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in map(hadoop.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text; a null text becomes empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts a batch into runs of whole rows with about ``size`` characters of text."""
    column = batch.column(text)
    start, gathered, texts = 0, 0, []
    for i, value in enumerate(column):
        value = value.as_py() or ""
        texts.append(value)
        gathered += len(value)
        if gathered >= size:
            yield batch.slice(start, i + 1 - start), texts
            start, gathered, texts = i + 1, 0, []
    if texts:
        yield batch.slice(start), texts


def copied(df: DataFrame, copies: str, index: str, piece: int = 4096) -> DataFrame:
    """Each row as often as ``copies`` says, numbered from 0 in ``index``; made in pieces, so no array grows with a count."""
    first = df.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col(copies) - 1, F.lit(piece)))))
    last = F.least((F.col("_piece") + 1) * piece, F.col(copies)) - 1
    return first.withColumn(index, F.explode(F.sequence(F.col("_piece") * piece, last))).drop("_piece", copies)
