"""Windows and guarded expressions shared by the operators.

A rolling value is null until its window holds the full number of non-null
values. Division by zero and the correlation of a flat series are null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by(keys: Sequence[str], order: str = "bar_ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def last_n(keys: Sequence[str], n: int, order: str = "bar_ts") -> WindowSpec:
    return by(keys, order).rowsBetween(-(n - 1), 0)


def full(agg: Callable[[Column], Column], value: Column, n: int, w: WindowSpec) -> Column:
    """``agg`` of the window, once it holds n non-null values."""
    return F.when(F.count(value).over(w) == n, agg(value).over(w))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def paired(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def safe_corr(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Pearson correlation of the rows where both are non-null; null for a flat side."""
    x, y = paired(x, y)
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    return F.try_divide(over(F.covar_pop(x, y)), over(F.stddev_pop(x)) * over(F.stddev_pop(y)))


def with_pos(df: DataFrame, keys: Sequence[str], order: str = "bar_ts", out: str = "pos", unit: str = "day") -> DataFrame:
    """Adds ``pos``, the row's number within its key, from 0, without sorting a series in one task.

    Rows are counted by key and day; the running sum of the counts, a row for each
    day, is where a day's numbers begin, and only the rows of one day are sorted together. A
    day has 86,400 bars at most, since times of bars are whole seconds, and a century has 36,525
    days. A row without a key or a time is numbered within the rows that lack it too.
    """
    keys = list(keys)
    rows = df.withColumn("_slot", F.date_trunc(unit, F.col(order)))
    counts = rows.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.coalesce("_before", F.lit(0)) + F.row_number().over(by([*keys, "_slot"], order)) - 1
    return rows.join(counts, [*keys, "_slot"], "left").select(*[F.col(c) for c in df.columns if c != out], place.cast("int").alias(out))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, so that sums of another order compare equal."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
