"""Result tables in one long form, conclusions, and data for charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbars.functions.rolling import safe_div

PAIR = ("pair_id",)


def research_summary(sections: Mapping[str, DataFrame], keys: Sequence[str] = PAIR) -> DataFrame:
    """All result tables as rows: keys, ``section``, ``item`` (its other labels), ``metric``, ``value``."""
    out = None
    for name, df in sections.items():
        kinds = dict(df.dtypes)
        numbers = [c for c in df.columns if c not in keys and kinds[c] in ("double", "float", "int", "bigint")]
        labels = [c for c in df.columns if c not in keys and c not in numbers]
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])
        rows = df.select(*keys, F.lit(name).alias("section"), F.concat_ws("/", *labels).alias("item") if labels else F.lit("").alias("item"), F.inline(cells))
        out = rows if out is None else out.unionByName(rows)
    return out


def conclusions(facts: DataFrame, strategies: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Rules that hold for each key, from one row of facts a key and one of metrics a strategy.

    ``facts``: mean_corr, pct_over_05, corr_ab, corr_ba, z_std, n_events,
    cointegrated, half_life. ``strategies``: strategy, net_return, profit_factor.
    Where no strategy is profitable two rows say so.
    """
    ab, ba = F.col("corr_ab"), F.col("corr_ba")
    rules = {
        "correlated": F.col("mean_corr") > 0.5, "correlation_stable": F.col("pct_over_05") > 50, "a_leads_b": ab > 0.1, "b_leads_a": ba > 0.1,
        "stronger_a_to_b": ab > ba, "stronger_b_to_a": ~(ab > ba), "residual_spread": F.col("z_std") > 0.5, "enough_events": F.col("n_events") > 20,
        "cointegrated": F.col("cointegrated"), "mean_reverting": F.col("half_life") < 100,
    }
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("holds")) for n, c in rules.items()])
    found = facts.select(*keys, F.inline(cells)).filter("holds").drop("holds")
    good = (F.col("net_return") > 0) & (F.col("profit_factor") > 1.2)
    profitable = strategies.filter(good).select(*keys, F.concat(F.lit("profitable_"), "strategy").alias("rule"))
    none = facts.join(profitable.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.explode(F.array(F.lit("no_profitable_strategy"), F.lit("costs_outweigh_edge"))).alias("rule"))
    return found.unionByName(profitable).unionByName(none)


def normalized_prices(df: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Closes of both sides as percent of the first."""
    first = df.groupBy(*keys).agg(*[F.min_by(f"{s}_close", "bar_ts").alias(f"_{s}") for s in "ab"])
    return df.join(first, list(keys)).select(*keys, "bar_ts", *[(safe_div(F.col(f"{s}_close"), F.col(f"_{s}")) * 100).alias(f"{s}_index") for s in "ab"])


def return_histogram(df: DataFrame, x: str, bins: int = 100, keys: Sequence[str] = PAIR) -> DataFrame:
    """Counts in bins of equal width from the least to the largest finite value, the last bin closed."""
    rows = df.select(*keys, F.col(x).alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    ends = rows.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.least(F.floor(safe_div((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    return rows.join(ends, list(keys)).groupBy(*keys, F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))


def return_pairs(df: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Finite return pairs and their difference."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.filter(finite("a_log_return") & finite("b_log_return")).select(*keys, "bar_ts", "a_log_return", "b_log_return", (F.col("b_log_return") - F.col("a_log_return")).alias("difference"))
