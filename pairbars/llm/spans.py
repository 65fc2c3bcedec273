"""Suffix-array dedup by bucket refinement: which bytes lie in a string of ``LENGTH`` bytes that starts elsewhere too.

A bucket holds the places whose strings of some length are equal. The buckets of
q-grams of eight bytes come first; the bucket of twice the length at a place is
that of the pair of identifiers at the place and at a later offset, and every level
reuses the identifiers of the level before: 8, 16, 32, up to 256, then any length
up to 512 by an overlapping offset. Buckets of one place are dropped on the way, so
later levels see fewer places:

1. An entry for every suffix would be several times the input. Each string of
   ``LENGTH`` bytes is held by the place of its smallest q-gram of ``q`` bytes, its
   anchor, which depends on the string alone, so equal strings have their anchors at
   equal offsets. There are about two anchors a window. Anchors are dealt to buckets
   by their q-gram; buckets of one drop out.
2. The offsets of the strings of an anchor fall in cells of ``cell`` offsets. Of a
   cell, the bytes common to all its strings (needed) and those of all its strings
   together (enough) get bucket identifiers. Where the needed part is in a bucket
   of one, no string of the cell repeats; where the whole is not, all do.
3. Only cells that are still open, those at the edges of repeated passages, are
   refined to a bucket for each single string, along with one cell of each settled
   bucket that may hold the same strings.

Identifiers are digests of 128 bits in place of ranks, so that tasks need not agree
on a numbering; those that decide what is removed are compared in full. They hold
the cell's number, so an occurrence is never counted twice. The anchors' q-grams
have 64 bits only: they choose candidates. The documents are kept in a bucketed
table in the work folder, so the three joins with them don't shuffle texts again.

Edge cases: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose
nothing; equal rows, also with equal ids, are different places, so they remove
each other; a text of any length is worked through in segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbars.llm import passages
from pairbars.llm.refine import anchors, at_places, bucketed, lists, mapped, mixed, paired
from pairbars.llm.work import partitions, removed, with_text, work_dir, written

LENGTH = 400
Q = 48
CELL = 64


def _anchor_rows(length: int, q: int) -> Callable[..., dict[str, np.ndarray]]:
    def work(data: np.ndarray, stops: np.ndarray) -> dict[str, np.ndarray]:
        place, first, last, gram = anchors(data, stops, length, q)
        text = np.searchsorted(stops, place, side="right")
        begin = np.append(0, stops)[text]
        return {"text": text, "a": (place - begin).astype(np.int32), "lo": (place - last).astype(np.int32), "hi": (place - first).astype(np.int32), "h": gram.view(np.int64)}

    return work


def _cell_rows(length: int, cell: int) -> Callable[..., dict[str, np.ndarray]]:
    def work(data: np.ndarray, stops: np.ndarray, found: list[np.ndarray]) -> dict[str, np.ndarray]:
        text, a, lo, hi = (x.astype(np.int64) for x in found)
        n = hi // cell - lo // cell + 1
        text, a, lo, hi = np.repeat(text, n), np.repeat(a, n), np.repeat(lo, n), np.repeat(hi, n)
        c = lo // cell + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        low, high = c * cell, c * cell + cell - 1
        begin = np.append(0, stops)[text]
        first, end = a - high, a - low + length
        inside = (first >= 0) & (begin + end <= stops[text])
        # in a text with no room for all strings of a cell, the cell can't be settled at once
        needed, whole = at_places(data, [(begin + a - low, length - cell + 1), (begin[inside] + first[inside], length + cell - 1)])
        salt = [mixed(c.astype(np.uint64) + np.uint64(1), lane) for lane in range(2)]
        out = {"text": text, "a": a.astype(np.int32), "lo": np.maximum(lo, low).astype(np.int32), "hi": np.minimum(hi, high).astype(np.int32)}
        for lane in range(2):
            filled = np.zeros(len(a), np.uint64)
            filled[inside] = whole[lane] ^ ~salt[lane][inside]
            out |= {f"n{lane}": (needed[lane] ^ salt[lane]).view(np.int64), f"e{lane}": filled.view(np.int64)}
        return out

    return work


def _single_rows(length: int) -> Callable[..., dict[str, np.ndarray]]:
    def work(data: np.ndarray, stops: np.ndarray, found: list[np.ndarray]) -> dict[str, np.ndarray]:
        text, a, lo, hi = (x.astype(np.int64) for x in found)
        n = hi - lo + 1
        start = np.repeat(a - hi, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = np.repeat(text, n)
        ((x, y),) = at_places(data, [(np.append(0, stops)[text] + start, length)])
        return {"text": text, "start": start.astype(np.int32), "h0": x.view(np.int64), "h1": y.view(np.int64)}

    return work


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, cell: int = CELL) -> DataFrame:
    """Removes every byte of a repeated string of ``length`` bytes.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs), ``removed`` (the runs as start and end), ``kept`` (the bytes left) and
    ``shares_passage`` (a run of over 50 words is in another document too, see
    ``passages``; it may be shorter than ``length``) for every row of ``docs``.
    """
    if not 0 < q < length or not 0 < cell < length:
        raise ValueError("q and cell must be smaller than length")
    spark, where = docs.sparkSession, work_dir(docs.sparkSession)
    texts = bucketed(with_text(docs, id_col, text_col), where, partitions(spark))
    plain = texts.select("row", "text")
    sharing = passages.sharing(plain)
    # what one side of a join sums up is written first: the join then is between two shuffles, of which Spark can split a hot key
    held = written(mapped(plain, _anchor_rows(length, q), "a int, lo int, hi int, h long", ["a", "lo", "hi", "h"]), where, "anchors")
    several = written(held.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), where, "grams")
    near = lists(held.join(several, "h"), "a", "lo", "hi")
    fields = ["a", "lo", "hi", "n0", "n1", "e0", "e1"]
    cells = mapped(plain.join(near, "row"), _cell_rows(length, cell), "a int, lo int, hi int, n0 long, n1 long, e0 long, e1 long", fields)
    cells = written(cells, where, "cells")
    removed(spark, f"{where}/anchors", f"{where}/grams")

    settled = F.col("n") > 1
    wholes = cells.groupBy("n0", "n1", "e0", "e1").agg(F.count("*").alias("n"))
    wholes = written(wholes.select("n0", "n1", "e0", "e1", "n", (settled & ((F.col("e0") != 0) | (F.col("e1") != 0))).alias("sure")), where, "wholes")
    parts = wholes.groupBy("n0", "n1").agg(F.sum("n").alias("total"), F.bool_or(~F.col("sure")).alias("open"))
    parts = written(parts.filter("total > 1").select("n0", "n1", "open"), where, "parts")
    marks = written(wholes.join(parts, ["n0", "n1"]).select("n0", "n1", "e0", "e1", "sure", "open"), where, "marks")
    left = cells.join(marks, ["n0", "n1", "e0", "e1"]).select("row", "a", "lo", "hi", "e0", "e1", "sure", "open")
    left = written(left, where, "left")
    removed(spark, *[f"{where}/{name}" for name in ("cells", "wholes", "parts", "marks")])

    # a string of an open cell may repeat in a settled one: of the settled cells that hold the same strings one takes part
    one = left.filter("sure and open").groupBy("e0", "e1").agg(F.min(F.struct("row", "a", "lo", "hi")).alias("x")).select("x.*")
    open_cells = left.filter("not sure").select("row", "a", "lo", "hi").unionByName(one)
    singles = mapped(plain.join(lists(open_cells, "a", "lo", "hi"), "row"), _single_rows(length), "start int, h0 long, h1 long", ["start", "h0", "h1"])
    singles = written(singles, where, "singles")
    strings = written(singles.groupBy("h0", "h1").agg(F.count("*").alias("n")).filter("n > 1").select("h0", "h1"), where, "strings")
    runs = singles.join(strings, ["h0", "h1"]).select("row", "start", (F.col("start") + length).alias("end"))
    sure = left.filter("sure").select("row", (F.col("a") - F.col("hi")).alias("start"), (F.col("a") - F.col("lo") + length).alias("end"))
    covered = runs.unionByName(sure).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    marked = texts.join(covered, "row", "left").join(sharing.withColumn("shares", F.lit(True)), "row", "left")
    return _removed(marked.select("doc_id", "text", "found", F.coalesce("shares", F.lit(False)).alias("shares")))


def _removed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[list] = [[], [], [], [], []]
                for text, found in zip(part.column("text"), part.column("found"), strict=True):
                    data = text.as_py().encode("utf-8", "replace")
                    removed, kept = [], data
                    if found.is_valid:
                        values = found.values
                        starts, ends = np.asarray(values.field(0)), np.asarray(values.field(1))
                        change = np.zeros(len(data) + 1, np.int64)
                        np.add.at(change, starts, 1)
                        np.add.at(change, ends, -1)
                        gone = np.cumsum(change)[:-1] > 0
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                        removed = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    for column, value in zip(out, (len(data), len(data) - len(kept), len(removed), removed, kept), strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(span), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)], part.column("shares")], ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept", "shares_passage"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, removed array<struct<start:long,end:long>>, kept binary, shares_passage boolean")


def digests(found: DataFrame) -> DataFrame:
    """The numbers of each row, the SHA-256 of the bytes left, and whether it shares a passage."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")
