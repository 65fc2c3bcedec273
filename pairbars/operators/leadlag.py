"""Correlation of one side's return with the other's some bars later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbars.functions.rolling import by, safe_corr
from pairbars.operators.chunks import in_chunks

PAIR = ("pair_id",)
DIRECTIONS = {"a_leads_b": ("a_log_return", "b_log_return"), "b_leads_a": ("b_log_return", "a_log_return")}


def lead_lag(df: DataFrame, max_lag: int = 12, keys: Sequence[str] = PAIR, directions: dict[str, tuple[str, str]] | None = None, pos: str | None = None) -> DataFrame:
    """``direction``, ``lag``, ``correlation`` and ``n_rows``; all lags in one aggregate per key.

    Opposite directions share the correlation at lag 0 to the last bit, so neither is the larger.
    """
    directions = directions or DIRECTIONS
    lags = range(max_lag + 1)
    sides = sorted({c for d in directions.values() for c in d})
    narrow = df.select(*keys, "bar_ts", *sides, *([pos] if pos else []))
    rows = in_chunks(narrow, keys, lambda d, own: d.select("*", *[F.lead(c, k).over(by(own)).alias(f"{c}_{k}") for c in sides for k in lags]), ahead=max_lag, pos=pos)
    # a covariance taken the other way round differs by rounding, so at lag 0 the sides come in order of name
    ends = {(d, k): sorted(xy) if k == 0 else xy for d, xy in directions.items() for k in lags}
    wide = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[safe_corr(F.col(x), F.col(f"{y}_{k}")).alias(f"{d}_{k}") for (d, k), (x, y) in ends.items()])
    cells = [F.struct(F.lit(d).alias("direction"), F.lit(k).alias("lag"), F.col(f"{d}_{k}").alias("correlation")) for d in directions for k in lags]
    return wide.select(*keys, "n_rows", F.inline(F.array(*cells)))


def best_lag(grid: DataFrame, keys: Sequence[str] = PAIR, bar_minutes: int = 10) -> DataFrame:
    """The lag of the largest absolute correlation, the smallest on ties; zeros without any."""
    best = Window.partitionBy(*keys, "direction").orderBy(F.desc_nulls_last(F.abs("correlation")), "lag")
    rows = grid.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    some = F.col("correlation").isNotNull()
    zero = lambda c: F.when(some, c).otherwise(F.lit(0))
    return rows.select(*keys, "direction", zero(F.col("lag")).alias("lag"), F.coalesce("correlation", F.lit(0.0)).alias("correlation"), zero(F.col("lag") * bar_minutes).alias("minutes"), zero(F.col("n_rows") - F.col("lag")).cast("long").alias("sample_size"))


def lead_lag_by(df: DataFrame, group: str, max_lag: int = 12, keys: Sequence[str] = PAIR) -> DataFrame:
    """The best lag within each group: neighbours are the next rows of the group. Groups need over max_lag + 10 rows."""
    inside = [*keys, group]
    return best_lag(lead_lag(df, max_lag, inside).filter(F.col("n_rows") > max_lag + 10), inside)


def conditional_lead_lag(df: DataFrame, col: str, value: str, max_lag: int = 12, leader: str = "a", follower: str = "b", keys: Sequence[str] = PAIR) -> DataFrame:
    """The grid within the rows of one value; nothing with fewer than max_lag + 10 rows."""
    one = {f"{leader}_leads_{follower}": (f"{leader}_log_return", f"{follower}_log_return")}
    return lead_lag(df.filter(F.col(col) == value), max_lag, keys, one).filter(F.col("n_rows") >= max_lag + 10)
