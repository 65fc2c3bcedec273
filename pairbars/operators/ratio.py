"""Price ratio, rolling hedge ratio and residual of a pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbars.functions.quantiles import with_quantiles
from pairbars.functions.rolling import by, full, last_n, paired, safe_div
from pairbars.operators.chunks import chunked, rolling_apply

PAIR = ("pair_id",)
WINDOWS = (20, 50, 100, 200)
A, B = "a_log_return", "b_log_return"


def ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("ratio", safe_div(F.col("a_close"), F.col("b_close")))


@chunked(lambda a: max(*a["windows"], a["zscore"]) - 1)
def ratio_features(df: DataFrame, windows: Sequence[int] = WINDOWS, zscore: int = 100, keys: Sequence[str] = PAIR) -> DataFrame:
    """Rolling mean, deviation and z-score of the ratio."""
    x = F.col("ratio")
    out = df.select("*", *[full(f, x, w, last_n(keys, w)).alias(f"ratio_{n}_{w}") for w in windows for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    mean, std = (full(f, x, zscore, last_n(keys, zscore)) for f in (F.avg, F.stddev_samp))
    return out.withColumn(f"ratio_zscore_{zscore}", safe_div(x - mean, std))


def ratio_percentile(df: DataFrame, w: int = 100, keys: Sequence[str] = PAIR, pos: str | None = None) -> DataFrame:
    """Share of the window that is at most the current value, in percent."""
    return rolling_apply(df, keys, w, {f"ratio_percentile_{w}": ("share_at_most", "ratio")}, pos=pos)


@chunked(lambda a: a["w"] - 1 + a["shift"])
def rolling_beta(df: DataFrame, w: int = 100, keys: Sequence[str] = PAIR, shift: int = 0) -> DataFrame:
    """``cov``, ``var_a``, ``beta`` over the last w bars; ``shift`` leaves out the newest bars."""
    a, b = paired(F.col(A), F.col(B))
    over = by(keys).rowsBetween(-(w - 1) - shift, -shift)
    rows = df.withColumn("cov", F.when(F.count(a).over(over) == w, F.covar_samp(a, b).over(over))).withColumn("var_a", F.when(F.count(A).over(over) == w, F.var_samp(A).over(over)))
    return rows.withColumn("beta", safe_div(F.col("cov"), F.col("var_a")))


def residual(df: DataFrame) -> DataFrame:
    return df.withColumn("expected_b_return", F.col("beta") * F.col(A)).withColumn("residual", F.col(B) - F.col("expected_b_return"))


@chunked(lambda a: a["w"] - 1)
def residual_zscore(df: DataFrame, w: int = 100, keys: Sequence[str] = PAIR) -> DataFrame:
    """Residual over its rolling deviation; the mean is not taken off."""
    return df.withColumn("residual_zscore", safe_div(F.col("residual"), full(F.stddev_samp, F.col("residual"), w, last_n(keys, w))))


@chunked(lambda a: a["beta"] + a["zscore"])
def scored(df: DataFrame, beta: int = 100, zscore: int = 100, keys: Sequence[str] = PAIR) -> DataFrame:
    return residual_zscore(residual(rolling_beta(df, beta, keys)), zscore, keys)


def ratio_summary(df: DataFrame, zscore: int = 100, keys: Sequence[str] = PAIR) -> DataFrame:
    """Last value and z-score, mean, deviation, and the share of all rows at most the last."""
    last = df.groupBy(*keys).agg(F.max_by("ratio", "bar_ts").alias("last"), F.max_by(f"ratio_zscore_{zscore}", "bar_ts").alias("last_zscore"), F.avg("ratio").alias("mean"), F.stddev_samp("ratio").alias("std"))
    share = df.join(last, list(keys)).groupBy(*keys).agg((F.avg((F.col("ratio") <= F.col("last")).cast("double")) * 100).alias("percentile"))
    return last.join(share, list(keys))


def _summary(df: DataFrame, col: str, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    aggs = {"mean": F.avg(col), "std": F.stddev_samp(col), "min": F.min(col), "max": F.max(col)}
    out = df.groupBy(*keys).agg(*[f.alias(n) for n, f in aggs.items()])
    return (with_quantiles(out, df, keys, col, {"median": 0.5}) if "median" in names else out).select(*keys, *names)


def beta_summary(df: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return _summary(df, "beta", ["mean", "median", "min", "max", "std"], keys)


def residual_zscore_summary(df: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return _summary(df, "residual_zscore", ["mean", "std", "min", "max"], keys)
