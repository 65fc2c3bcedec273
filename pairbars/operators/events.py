"""Event studies of residual and ratio scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbars.functions.quantiles import with_quantiles
from pairbars.functions.rolling import by, safe_div
from pairbars.functions.work import written
from pairbars.operators.chunks import chunked, in_chunks
from pairbars.operators.select import greedy_select

PAIR = ("pair_id",)
THRESHOLDS = (1.5, 2.0, 2.5, 3.0)
PERIODS = (1, 2, 3, 6, 12)


def _thresholds(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Each row with each threshold, and the threshold's rank."""
    return df.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(thresholds)]))).select("*", "_t.*").drop("_t")


def candidates(df: DataFrame, z: str = "residual_zscore", thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Rows at or beyond a threshold, once for each, with ``direction`` and ``side`` (0 upper, 1 lower)."""
    rows = df.filter(F.abs(z) >= min(thresholds))
    rows = _thresholds(rows, thresholds).filter(F.abs(z) >= F.col("threshold"))
    return rows.withColumn("side", F.when(F.col(z) > 0, 0).otherwise(1)).withColumn("direction", F.when(F.col(z) > 0, "B_STRONG").otherwise("A_STRONG"))


def detect_divergences(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS, cooldown: int = 0, z: str = "residual_zscore", mode: str = "sequential", keys: Sequence[str] = PAIR) -> DataFrame:
    """Events with a cooldown in bars.

    ``sequential``: one pass over all thresholds, upper rows before lower ones,
    the last event's position runs on. ``per_threshold`` and ``per_side`` start
    anew for each threshold, or threshold and side. A cooldown of 0 skips nothing.
    Positions begin again with each threshold and side, but the running end doesn't, so a later
    pass keeps only what lies after all candidates of the passes before.
    """
    rows = candidates(df, z, thresholds)
    if cooldown <= 0:
        return rows
    groups, phases = {"sequential": ([], ["rank", "side"]), "per_threshold": (["rank"], ["side"]), "per_side": (["rank", "side"], [])}[mode]
    rows = rows.withColumn("_end", F.col("pos") + cooldown)
    return greedy_select(rows, [*keys, *groups], cooldown, "pos", "_end", phases).drop("_end")


@chunked(ahead=lambda a: max(a["periods"]))
def with_forward(df: DataFrame, periods: Sequence[int] = PERIODS, keys: Sequence[str] = PAIR) -> DataFrame:
    """Returns p bars later, taken before any filter, and whether that bar exists."""
    w = by(keys)
    return df.select("*", *[F.lead(f"{s}_log_return", p).over(w).alias(f"_{s}_{p}") for s in "ab" for p in periods], *[F.lead(F.lit(1), p).over(w).alias(f"_has_{p}") for p in periods])


def _forward_stats(rows: DataFrame, by_cols: Sequence[str]) -> DataFrame:
    rows, x = written(rows), F.col("x")  # events, few beside the bars
    stats = {"mean": F.avg(x), "std": F.stddev_pop(x), "pct_positive": F.avg((x > 0).cast("double")) * 100, "max": F.max(x), "min": F.min(x), "count": F.count("*")}
    out = with_quantiles(rows.groupBy(*by_cols).agg(*[f.alias(n) for n, f in stats.items()]), rows, by_cols, "x", {"median": 0.5})
    return out.select(*by_cols, "mean", "median", *list(stats)[1:])


def forward_returns(events: DataFrame, by_cols: Sequence[str] = (), periods: Sequence[int] = PERIODS, keys: Sequence[str] = PAIR) -> DataFrame:
    """One-bar returns p bars after the events, per side; ``events`` come from rows of ``with_forward``."""
    cells = F.array(*[F.struct(F.lit(p).alias("period"), F.lit(s).alias("instrument"), F.col(f"_{s}_{p}").alias("x"), F.col(f"_has_{p}").alias("has")) for p in periods for s in "ab"])
    rows = events.select(*keys, *by_cols, F.inline(cells)).filter("has is not null")
    return _forward_stats(rows, [*keys, *by_cols, "period", "instrument"])


def divergence_by_threshold(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS, cooldown: int = 12, periods: Sequence[int] = PERIODS, pos: str | None = None) -> DataFrame:
    return forward_returns(detect_divergences(with_forward(df, periods, pos=pos), thresholds, cooldown, mode="per_threshold"), ["threshold"], periods)


def divergence_by_direction(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS, cooldown: int = 12, periods: Sequence[int] = PERIODS, pos: str | None = None) -> DataFrame:
    return forward_returns(detect_divergences(with_forward(df, periods, pos=pos), thresholds, cooldown), ["direction"], periods)


def conditional_divergence(df: DataFrame, group: str = "session", thresholds: Sequence[float] = THRESHOLDS, periods: Sequence[int] = PERIODS, least: int = 10, keys: Sequence[str] = PAIR) -> DataFrame:
    """Events within each group of enough rows; bars later are counted inside the group."""
    inside = [*keys, group]
    sizes = df.groupBy(*inside).count().filter(F.col("count") >= least).drop("count")
    rows = with_forward(df, periods, inside).join(sizes, inside, "left_semi")
    return forward_returns(candidates(rows, "residual_zscore", thresholds), [group], periods, keys)


def ratio_extremes(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS, periods: Sequence[int] = PERIODS, z: str = "ratio_zscore_100", keys: Sequence[str] = PAIR, pos: str | None = None) -> DataFrame:
    """Relative change of the ratio from each extreme row to p bars later."""
    rows = in_chunks(df, keys, lambda d, own: d.select("*", *[safe_div(F.lead("ratio", p).over(by(own)) - F.col("ratio"), F.col("ratio")).alias(f"_x_{p}") for p in periods]), ahead=max(periods), pos=pos)
    cells = F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"_x_{p}").alias("x")) for p in periods])
    rows = candidates(rows, z, thresholds).select(*keys, "threshold", F.when(F.col("side") == 0, "upper").otherwise("lower").alias("extreme"), F.inline(cells)).filter("x is not null")
    return _forward_stats(rows, [*keys, "threshold", "extreme", "period"])


def ratio_reversion(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS, levels: Sequence[float] = (0.0, 0.5, 1.0), ahead: int = 199, z: str = "ratio_zscore_100", keys: Sequence[str] = PAIR, pos: str | None = None) -> DataFrame:
    """How many extreme rows come back within a level of zero, and after how many bars."""
    back = lambda own, level: F.min(F.when(F.abs(z) <= level, F.col("pos"))).over(by(own).rowsBetween(1, ahead))
    rows = in_chunks(df, keys, lambda d, own: d.select("*", *[back(own, level).alias(f"_to_{i}") for i, level in enumerate(levels)]), ahead=ahead, pos=pos)
    cells = F.array(*[F.struct(F.lit(float(level)).alias("level"), (F.col(f"_to_{i}") - F.col("pos")).alias("bars")) for i, level in enumerate(levels)])
    rows = candidates(rows, z, thresholds).select(*keys, "threshold", F.inline(cells))
    out = rows.groupBy(*keys, "threshold", "level").agg(F.count("*").alias("n_events"), (F.avg(F.col("bars").isNotNull().cast("double")) * 100).alias("pct_reverted"), F.avg("bars").alias("mean_bars"), F.max("bars").alias("max_bars"))
    return out.na.fill(0, ["mean_bars", "max_bars"])
