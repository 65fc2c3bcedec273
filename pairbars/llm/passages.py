"""Documents that share a passage: a run of ``LENGTH`` words that another document has too.

The same refinement as in ``spans``, over words in place of bytes. Each run of
``LENGTH`` words is held by the smallest q-gram of words in it. Q-grams of one
document drop out. Of an anchor, all its runs together get one bucket identifier;
where that bucket holds two documents, all the runs are shared. Only the other
anchors are refined to a bucket for each run, along with two documents of each
settled bucket that may hold the same runs.

Words are ``[^\\x20\\x09-\\x0D]+``, as they are. Identifiers have 128 bits; those of
q-grams, which only choose candidates, have 64.

Edge cases: null and empty texts, and those of fewer words, share nothing; equal
rows, also with equal ids, are different documents; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbars.llm.refine import Ids, anchors, lists, mapped, mixed, paired, refined
from pairbars.llm.work import removed, work_dir, written

LENGTH = 51
Q = 13
PIECE = 1 << 14
_ODD = np.random.default_rng(21).integers(1, 1 << 63, (2, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_ids(data: np.ndarray, stops: np.ndarray) -> tuple[Ids, np.ndarray]:
    """Identifiers of the words of texts end to end, and the numbers of words up to the texts' ends."""
    inside = (data != 32) & (data - np.uint8(9) > 4)
    begins, finals = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finals[:-1] &= ~inside[1:]
    for edge, at in ((begins, stops[stops < len(data)]), (finals, stops[stops > 0] - 1)):
        edge[at] = inside[at]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finals) + 1
    ids = [np.empty(len(starts), np.uint64) for _ in range(2)]
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray((len(data),), "<u8", padded, strides=(1,))  # the eight bytes from every place
    for s in range(0, len(starts), PIECE):
        begin, n = starts[s : s + PIECE], ends[s : s + PIECE] - starts[s : s + PIECE]
        parts = (n + 7) // 8
        first = np.cumsum(parts) - parts
        place = np.arange(parts.sum()) - np.repeat(first, parts)
        part = eights[np.repeat(begin, parts) + 8 * place]
        last = first + parts - 1
        part[last] &= np.uint64(2**64 - 1) >> (8 * (8 * parts - n)).astype(np.uint64)
        place = place.astype(np.uint64)
        for lane in range(2):
            x = mixed(part * _ODD[lane, 0] + place * _ODD[lane, 1], lane)
            ids[lane][s : s + PIECE] = mixed(np.add.reduceat(x, first) + n.astype(np.uint64), lane)
    return ids, np.searchsorted(starts, stops)


def _marks(length: int, q: int) -> Callable[..., dict[str, np.ndarray]]:
    def work(data: np.ndarray, stops: np.ndarray) -> dict[str, np.ndarray]:
        ids, ends = word_ids(data, stops)
        place, first, last, gram = anchors(ids[0], ends, length, q, lambda part, n: refined([part], 1, n)[0])
        text = np.searchsorted(ends, place, side="right")
        begin = np.append(0, ends)[text]
        return {"text": text, "first": (first - begin).astype(np.int32), "last": (last - begin).astype(np.int32), "h": gram.view(np.int64)}

    return work


def _runs(length: int, each: bool) -> Callable[..., dict[str, np.ndarray]]:
    """Identifiers of the runs of anchors: of each run, or of all those of an anchor together."""

    def work(data: np.ndarray, stops: np.ndarray, found: list[np.ndarray]) -> dict[str, np.ndarray]:
        ids, ends = word_ids(data, stops)
        run = refined(ids, 1, length)
        text, first, last = (x.astype(np.int64) for x in found[:3])
        begin = np.append(0, ends)[text]
        if each:
            n = last - first + 1
            at = np.repeat(begin + first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x, y = (r[at] for r in run)
            return {"text": np.repeat(text, n), "x": x.view(np.int64), "y": y.view(np.int64)}
        x, y = paired([r[begin + first] for r in run], [r[begin + last] for r in run])
        size = (last - first).astype(np.uint64)
        return {"text": text, "first": first.astype(np.int32), "last": last.astype(np.int32), "h": found[3], "x": mixed(x ^ size).view(np.int64), "y": mixed(y + size).view(np.int64)}

    return work


def _several(rows: DataFrame, *columns: str) -> DataFrame:
    """The buckets that hold two documents at least."""
    return rows.groupBy(*columns).agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a < b").select(*columns)


def sharing(texts: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """``row`` of each text that shares a passage; ``texts`` (row, text) are bucketed by row."""
    spark, where = texts.sparkSession, work_dir(texts.sparkSession)
    marks = written(mapped(texts, _marks(length, q), "first int, last int, h long", ["first", "last", "h"]), where, "marks")
    near = lists(marks.join(written(_several(marks, "h"), where, "grams"), "h"), "first", "last", "h")
    unions = mapped(texts.join(near, "row"), _runs(length, False), "first int, last int, h long, x long, y long", ["first", "last", "h", "x", "y"])
    unions = written(unions, where, "unions")
    removed(spark, f"{where}/marks")
    settled = written(_several(unions, "x", "y").withColumn("sure", F.lit(True)), where, "settled")
    known = written(unions.join(settled, ["x", "y"], "left"), where, "known")
    removed(spark, f"{where}/unions")
    left = known.filter("sure is null")
    open_grams = written(left.select("h").distinct(), where, "open")
    place = F.struct("row", "first", "last")
    ends = known.filter("sure").join(open_grams, "h").groupBy("x", "y").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    some = left.select("row", "first", "last").unionByName(ends.select(F.inline(F.array("a", "b"))))
    runs = written(mapped(texts.join(lists(some, "first", "last"), "row"), _runs(length, True), "x long, y long", ["x", "y"]), where, "runs")
    shared = written(_several(runs, "x", "y"), where, "shared")
    rows = written(known.filter("sure").select("row").unionByName(runs.join(shared, ["x", "y"]).select("row")).distinct(), where, "rows")
    removed(spark, f"{where}/known", f"{where}/runs")
    return rows
