"""Spreads and the cost of trading them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbars.functions.quantiles import with_quantiles
from pairbars.functions.rolling import safe_div

PAIR = ("pair_id",)


QUANTILES = {"median": 0.5, "q95": 0.95, "q99": 0.99}


def spread_stats(df: DataFrame, by_cols: Sequence[str] = (), sides: str = "ab", keys: Sequence[str] = PAIR, accuracy: int | None = None) -> DataFrame:
    """Mean, median, range and high quantiles of each side's spread, by any further columns; zeros when all are null.

    Quantiles are exact, or with an ``accuracy`` from a sketch with a rank error of at most 1 / accuracy.
    """
    cells = F.array(*[F.struct(F.lit(s).alias("instrument"), F.col(f"{s}_spread").alias("x")) for s in sides])
    by = [*keys, *by_cols, "instrument"]
    rows = df.select(*keys, *by_cols, F.inline(cells))
    x = F.col("x").cast("double")
    out = with_quantiles(rows.groupBy(*by).agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max")), rows, by, "x", QUANTILES, accuracy)
    return out.select(*by, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "median", "min", "max", "q95", "q99")])


def spread_by_hour(df: DataFrame, keys: Sequence[str] = PAIR, accuracy: int | None = None) -> DataFrame:
    """Of side a, for the UTC hours present."""
    return spread_stats(df.withColumn("hour", F.hour("bar_ts")), ["hour"], "a", keys, accuracy).drop("instrument")


def spread_cost(df: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Mean and median spread, and the mean spread in percent of the close, per side."""
    aggs = []
    for s in "ab":
        x = F.col(f"{s}_spread")
        aggs += [F.avg(x).alias(f"{s}_mean"), F.avg(safe_div(x.cast("double"), F.col(f"{s}_close")) * 100).alias(f"{s}_cost_pct")]
    out = df.groupBy(*keys).agg(*aggs)
    for s in "ab":
        out = with_quantiles(out, df, keys, f"{s}_spread", {f"{s}_median": 0.5})
    return out.select(*keys, *[f"{s}_{c}" for s in "ab" for c in ("mean", "median", "cost_pct")])


def transaction_cost(spread_entry: Column, spread_exit: Column, commission: float = 0.0, slippage: float = 0.0, point_size: float = 1.0) -> Column:
    return (spread_entry + spread_exit) / 2 * point_size + commission + slippage
