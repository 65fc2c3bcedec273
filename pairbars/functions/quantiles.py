"""Exact quantiles of groups of any size.

Equal values are counted first, partly before the shuffle. Then the range of a group's values is cut
into equal slots, whose counts say which slot holds a rank, and only the values of that slot are put in
order. A group has ``SLOTS`` slots at most, and what is sorted lies within that part of its
range, so no buffer holds a group's values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 65_536


def quantiles(df: DataFrame, keys: Sequence[str], x: str, shares: Mapping[str, float], slots: int = SLOTS) -> DataFrame:
    """The quantiles of the non-null values of each key, by name, interpolated between the two values next to the rank.

    A key without values has no row; keys must not be null.
    """
    keys, at = list(keys), [*keys, "_slot"]
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    whole = counts.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_n").alias("_size"))
    width = F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    slot = F.coalesce(F.least(F.floor(width * slots), F.lit(slots - 1)), F.lit(0))
    rows = counts.join(whole, keys).select(*keys, "_x", "_n", "_size", slot.alias("_slot"))
    place = lambda p: F.lit(float(p)) * (F.col("_size") - 1)
    ranks = F.array(*[end(place(p)) for p in shares.values() for end in (F.floor, F.ceil)])
    held = lambda n: (lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col(n)))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.groupBy(*at).agg(F.sum("_n").alias("_m"), F.first("_size").alias("_size")).withColumn("_first", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    cut = cut.select(*at, F.col("_first").alias("_begin"), F.filter(ranks, held("_m")).alias("_ranks")).filter(F.size("_ranks") > 0)
    inside = Window.partitionBy(*at).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.join(cut, at).withColumn("_first", F.col("_begin") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    last = last.withColumn("_ranks", F.filter("_ranks", held("_n"))).filter(F.size("_ranks") > 0)

    def value(p: float) -> Column:
        low, high = (F.max(F.when(F.array_contains("_ranks", end(place(p))), F.col("_x"))) for end in (F.floor, F.ceil))
        at = F.lit(float(p)) * (F.max("_size") - 1)
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return last.groupBy(*keys).agg(*[value(p).alias(name) for name, p in shares.items()])


def with_quantiles(table: DataFrame, df: DataFrame, keys: Sequence[str], x: str, shares: Mapping[str, float], accuracy: int | None = None) -> DataFrame:
    """Adds the quantiles of ``x`` in ``df`` to a table of the same keys, null where a key has no values.

    With an ``accuracy`` they come from a mergeable sketch, whose error in rank is at most 1 / accuracy of the values,
    in one aggregate.
    """
    if accuracy is None:
        return table.join(quantiles(df, keys, x, shares), list(keys), "left")
    several = F.percentile_approx(F.col(x).cast("double"), [float(p) for p in shares.values()], accuracy)
    rough = df.groupBy(*keys).agg(several.alias("_q")).select(*keys, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(shares)])
    return table.join(rough, list(keys), "left")
