"""Rolling, grouped and hopping correlations of the two returns of a pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbars.functions.quantiles import with_quantiles
from pairbars.functions.rolling import by, last_n, paired, safe_corr, with_pos
from pairbars.operators.chunks import chunked, in_chunks, rolling_apply

PAIR = ("pair_id",)
WINDOWS = (20, 50, 100, 200)
A, B = "a_log_return", "b_log_return"


@chunked(lambda a: max(a["windows"]) - 1)
def rolling_correlation(df: DataFrame, windows: Sequence[int] = WINDOWS, keys: Sequence[str] = PAIR, x: str = A, y: str = B) -> DataFrame:
    """``corr_w`` once a window holds w pairs."""
    px, _ = paired(F.col(x), F.col(y))
    return df.select("*", *[F.when(F.count(px).over(last_n(keys, w)) == w, safe_corr(F.col(x), F.col(y), last_n(keys, w))).alias(f"corr_{w}") for w in windows])


def rolling_spearman(df: DataFrame, w: int = 50, keys: Sequence[str] = PAIR, x: str = A, y: str = B, pos: str | None = None) -> DataFrame:
    return rolling_apply(df, keys, w, {f"spearman_{w}": ("spearman", x, y)}, pos=pos)


def _long(df: DataFrame, keys: Sequence[str], windows: Sequence[int]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"corr_{w}").alias("corr")) for w in windows])))


def correlation_statistics(df: DataFrame, windows: Sequence[int] = WINDOWS, keys: Sequence[str] = PAIR) -> DataFrame:
    """Of the non-null values of each window: mean, median, deviation, range, shares over levels; zeros when there are none."""
    c = F.col("corr")
    share = lambda t: F.avg(F.when(c.isNotNull(), (c > t).cast("double"))) * 100
    aggs = {"mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c), "pct_positive": share(0), "pct_over_05": share(0.5), "pct_over_07": share(0.7)}
    rows = _long(df, keys, windows)
    out = rows.groupBy(*keys, "window").agg(F.count(c).alias("n"), *[f.alias(n) for n, f in aggs.items()])
    out = with_quantiles(out, rows, [*keys, "window"], "corr", {"median": 0.5})
    return out.select(*keys, "window", "n", *[F.when(F.col("n") == 0, 0.0).otherwise(F.col(n)).alias(n) for n in ("mean", "median", *list(aggs)[1:])])


def correlation_by(df: DataFrame, group: str, windows: Sequence[int] = WINDOWS, keys: Sequence[str] = PAIR) -> DataFrame:
    """The correlation of a whole group, and per window null where the group has fewer rows."""
    out = df.groupBy(*keys, group).agg(F.count("*").alias("n_rows"), safe_corr(F.col(A), F.col(B)).alias("correlation"))
    return out.select(*keys, group, "n_rows", "correlation", *[F.when(F.col("n_rows") >= w, F.col("correlation")).alias(f"corr_{w}") for w in windows])


def correlation_stability(df: DataFrame, w: int = 100, step: int | None = None, keys: Sequence[str] = PAIR, x: str = A, y: str = B) -> DataFrame:
    """Correlation in hopping windows that end before the last row; a null one makes the summary null."""
    keys, step = list(keys), step or w // 2
    rows = with_pos(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, out="_p")
    size = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    last = F.least(F.floor(F.col("_p") / step), F.floor((F.col("_n") - w - 1) / step))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_p") - w + 1) / step))
    rows = rows.join(size, keys).filter(F.col("_n") > w).filter(last >= first).withColumn("_w", F.explode(F.sequence(first, last)))
    each = rows.groupBy(*keys, "_w").agg(safe_corr(F.col(x), F.col(y)).alias("c"))
    whole = lambda f: F.when(F.count("c") == F.count("*"), f)
    return each.groupBy(*keys).agg(whole(F.avg("c")).alias("mean"), whole(F.stddev_pop("c")).alias("std"), whole(F.min("c")).alias("min"), whole(F.max("c")).alias("max"), F.count("*").alias("n_windows"))


def autocorrelation(df: DataFrame, x: str = A, max_lag: int = 20, keys: Sequence[str] = PAIR, pos: str | None = None) -> DataFrame:
    """Correlation of a series with itself k rows earlier, one pass for all k."""
    narrow = df.select(*keys, "bar_ts", F.col(x).alias("x"), *([pos] if pos else []))
    rows = in_chunks(narrow, keys, lambda d, own: d.select("*", *[F.lag("x", k).over(by(own)).alias(f"l{k}") for k in range(max_lag + 1)]), max_lag, pos=pos)
    wide = rows.groupBy(*keys).agg(*[safe_corr(F.col("x"), F.col(f"l{k}")).alias(f"l{k}") for k in range(max_lag + 1)])
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"l{k}").alias("autocorrelation")) for k in range(max_lag + 1)])))
