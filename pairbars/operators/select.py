"""Greedy choice of rows that must not overlap, in chunks of positions.

The choice is sequential: a row is kept when it starts after the end of the last
kept one. What a chunk needs to know of all rows before it is that one end, which reaches
at most ``reach`` positions into it. So each chunk first says, for every such end, which end it
leaves behind; the ends are carried from chunk to chunk, a row for each; then every chunk
chooses by itself. No group holds more than the candidates of ``rows`` positions, however dense.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pairbars.functions.work import written

ROWS = 10_000


def after_earlier_phases(df: DataFrame, keys: Sequence[str], phases: Sequence[str], start: str) -> DataFrame:
    """Of rows that are gone through phase by phase, those that can be kept at all.

    When a phase is over, the running end is at or after its last candidate: either that was kept, or it was within the
    end. So in later phases only rows that start after all candidates of the phases before can be kept.
    """
    keys = list(keys)
    last = df.groupBy(*keys, *phases).agg(F.max(start).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(*phases).rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_before", F.max("_last").over(before)).drop("_last")
    return df.join(last, [*keys, *phases]).filter(F.col("_before").isNull() | (F.col(start) > F.col("_before"))).drop("_before")


def greedy_select(df: DataFrame, keys: Sequence[str], reach: int, start: str = "start", end: str = "end", phases: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """Takes rows in order of ``start`` and keeps one when it starts after the end of the last kept.

    An end is at its start or up to ``reach`` positions later; a null end is never reached. With
    ``phases`` rows are taken phase by phase, and the running end goes on.
    """
    keys = list(keys)
    # the candidates, few beside the rows they come from, are read three times
    placed = written(df)
    placed = after_earlier_phases(placed, keys, phases, start) if phases else placed
    placed = placed.withColumn("_chunk", F.floor(F.col(start) / rows))
    columns = df.columns
    found = StructType([*[df.schema[k] for k in keys], StructField("_chunk", LongType()), StructField("_left", ArrayType(DoubleType()))])
    entry = StructType([*found.fields[:-1], StructField("_entering", DoubleType())])

    def in_order(part: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        part = part.take(np.argsort(part[start].to_numpy(), kind="stable"))
        starts, ends = (part[c].cast(pa.float64()).to_numpy() for c in (start, end))
        ends = np.where(np.isnan(ends), np.inf, ends)
        return part, starts, ends, np.searchsorted(starts, ends, side="right")

    def leave(part: pa.Table) -> pa.Table:
        """The end left behind for each end ``_chunk * rows - 1 + i`` of the rows before."""
        part, starts, ends, follows = in_order(part)
        n = len(starts)
        left = ends.copy()
        for i in range(n - 1, -1, -1):
            if follows[i] < n:
                left[i] = left[follows[i]]
        entering = part["_chunk"][0].as_py() * rows - 1 + np.arange(reach + 1, dtype=float)
        first = np.searchsorted(starts, entering, side="right")
        out = np.where(first < n, left[np.minimum(first, n - 1)], entering)
        return part.select([*keys, "_chunk"]).slice(0, 1).append_column("_left", pa.array([out.tolist()], pa.list_(pa.float64())))

    def carry(part: pa.Table) -> pa.Table:
        part = part.sort_by("_chunk")
        last, entered = -np.inf, []
        for chunk, left in zip(part["_chunk"].to_pylist(), part["_left"].to_pylist(), strict=True):
            entered.append(last)
            if last < np.inf:
                last = left[int(max(last - (chunk * rows - 1), 0))]
        return part.select([*keys, "_chunk"]).append_column("_entering", pa.array(entered, pa.float64()))

    def choose(part: pa.Table) -> pa.Table:
        part, starts, _, follows = in_order(part)
        kept, i = [], int(np.searchsorted(starts, part["_entering"][0].as_py(), side="right"))
        while i < len(starts):
            kept.append(i)
            i = int(follows[i])
        return part.select(columns).take(pa.array(kept, pa.int64()))

    ends = placed.select(*keys, "_chunk", start, end).groupBy(*keys, "_chunk").applyInArrow(leave, found)
    entering = ends.groupBy(*keys).applyInArrow(carry, entry)
    return placed.join(entering, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInArrow(choose, df.schema)
