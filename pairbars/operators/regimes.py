"""Trading sessions, volatility regimes and tables by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbars.functions.rolling import safe_corr


def session(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h < 7, "ASIA").when(h < 12, "LONDON").when(h < 16, "LONDON_NEW_YORK_OVERLAP").when(h < 21, "NEW_YORK").otherwise("OTHER")


def session_label(df: DataFrame) -> DataFrame:
    return df.withColumn("session", session(F.col("bar_ts")))


def session_flags(df: DataFrame) -> DataFrame:
    names = ["ASIA", "LONDON", "LONDON_NEW_YORK_OVERLAP", "NEW_YORK"]
    return df.select("*", *[(session(F.col("bar_ts")) == s).cast("int").alias(f"is_{s.lower()}") for s in names])


def regime_table(df: DataFrame, keys: Sequence[str] = ("pair_id",), least: int = 10) -> DataFrame:
    """Per session and per regime, in one pass: rows, correlation, means and deviations of returns, mean spreads."""
    keys = list(keys)
    a, b = F.col("a_log_return"), F.col("b_log_return")
    grouped = df.groupingSets([[F.col(c) for c in (*keys, "session")], [F.col(c) for c in (*keys, "volatility_regime")]], *keys, "session", "volatility_regime")
    out = grouped.agg(
        F.grouping("session").alias("_by_regime"),
        F.count("*").alias("n_rows"),
        safe_corr(a, b).alias("correlation"),
        *[f.alias(n) for s, c in (("a", a), ("b", b)) for f, n in ((F.avg(c), f"{s}_mean"), (F.stddev_samp(c), f"{s}_std"), (F.avg(f"{s}_spread"), f"{s}_spread_mean"))],
    ).filter(F.col("n_rows") >= least)
    kind = F.when(F.col("_by_regime") == 1, "volatility_regime").otherwise("session")
    return out.select(*keys, kind.alias("grouping"), F.coalesce("session", "volatility_regime").alias("label"), *[c for c in out.columns if c not in (*keys, "session", "volatility_regime", "_by_regime")])


def session_spread_means(df: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Mean spreads by a coarser rule of sessions: all hours from 16 count as New York."""
    h = F.hour("bar_ts")
    label = F.when(h < 7, "ASIA").when(h < 12, "LONDON").when(h < 16, "LONDON_NEW_YORK_OVERLAP").otherwise("NEW_YORK")
    return df.groupBy(*keys, label.alias("session")).agg(F.avg("a_spread").alias("a_spread_mean"), F.avg("b_spread").alias("b_spread_mean"))
