"""Indicators of one price series per key."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbars.functions.rolling import by, full, last_n, safe_div, with_pos
from pairbars.operators.chunks import chunked, in_chunks, rolling_apply

SYMBOL = ("symbol",)
#: Rows of a chunk of the recursion at most; fewer where weights would vanish within it.
EMA_CHUNK = 2048


@chunked(lambda a: 1)
def log_return(df: DataFrame, keys: Sequence[str] = SYMBOL, close: str = "close", out: str = "log_return") -> DataFrame:
    return df.withColumn(out, F.ln(safe_div(F.col(close), F.lag(close).over(by(keys)))))


@chunked(lambda a: 1)
def pct_return(df: DataFrame, keys: Sequence[str] = SYMBOL, close: str = "close", out: str = "pct_return") -> DataFrame:
    return df.withColumn(out, safe_div(F.col(close), F.lag(close).over(by(keys))) - 1)


def emas(df: DataFrame, spans: Sequence[int], keys: Sequence[str] = SYMBOL, close: str = "close", chunk: int = EMA_CHUNK, pos: str | None = None) -> DataFrame:
    """Exponential means ``ema_<span>``, seeded with the first value; exact over chunks of the series.

    Within a chunk of rows the recursion is a prefix sum of weighted values. Only
    the last values of each chunk go through the carry from chunk to chunk. All spans
    share one numbering, one aggregate, one carry and one join; a span of 1 is the value itself.
    """
    keys, found = list(keys), list(dict.fromkeys(spans))
    spans = [span for span in found if span > 1]
    if spans:
        # the weight of a chunk's first row stays a normal number at its last
        chunk = max(1, min(chunk, int(-600 / math.log(1 - 2 / (min(spans) + 1)))))
    rows = df.withColumn("_pos", F.col(pos)) if pos else with_pos(df, keys, out="_pos")
    rows = rows.withColumn("_chunk", F.floor(F.col("_pos") / chunk)).withColumn("_k", (F.col("_pos") % chunk).cast("double"))
    w = by([*keys, "_chunk"], "_k").rowsBetween(-chunk, 0)

    def local(span: int) -> Column:
        alpha = 2 / (span + 1)
        power = F.pow(F.lit(1 - alpha), F.col("_k"))
        return power * F.sum(F.when(F.col("_pos") == 0, 1.0).otherwise(alpha) * F.col(close) / power).over(w)

    rows = rows.select("*", *[local(span).alias(f"_local_{span}") for span in spans])
    last = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"), *[F.max_by(f"_local_{span}", "_k").alias(f"_last_{span}") for span in spans])
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", _chunk long" + "".join(f", _carry_{span} double" for span in spans)

    def carried(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_chunk")
        out = rows[[*keys, "_chunk"]].copy()
        for span in spans:
            carry, found, decay = 0.0, [], 1 - 2 / (span + 1)
            for value, n in zip(rows[f"_last_{span}"], rows["_n"], strict=True):
                found.append(carry)
                carry = value + decay**n * carry
            out[f"_carry_{span}"] = np.array(found, float)
        return out

    rows = rows.join(last.groupBy(*keys).applyInPandas(carried, schema), [*keys, "_chunk"])
    mean = lambda span: F.col(f"_local_{span}") + F.pow(F.lit(1 - 2 / (span + 1)), F.col("_k") + 1) * F.col(f"_carry_{span}") if span > 1 else F.col(close).cast("double")
    return rows.select(*df.columns, *[mean(span).alias(f"ema_{span}") for span in found])


def ema(df: DataFrame, span: int, keys: Sequence[str] = SYMBOL, close: str = "close", out: str | None = None, chunk: int = EMA_CHUNK, pos: str | None = None) -> DataFrame:
    """One exponential mean, see ``emas``."""
    return emas(df, [span], keys, close, chunk, pos).withColumnRenamed(f"ema_{span}", out or f"ema_{span}")


@chunked(lambda a: a["n"])
def rsi(df: DataFrame, n: int = 14, keys: Sequence[str] = SYMBOL, close: str = "close") -> DataFrame:
    """Relative strength of simple means; 100 without losses, null without any change."""
    change = F.coalesce(F.col(close) - F.lag(close).over(by(keys)), F.lit(0.0))
    rows = df.withColumn("_up", F.greatest(change, F.lit(0.0))).withColumn("_down", F.greatest(-change, F.lit(0.0)))
    w = last_n(keys, n)
    up, down = (full(F.avg, F.col(c), n, w) for c in ("_up", "_down"))
    rows = rows.withColumn("_u", up).withColumn("_d", down)
    value = F.when((F.col("_d") == 0) & (F.col("_u") > 0), 100.0).otherwise(100 - 100 / (1 + safe_div(F.col("_u"), F.col("_d"))))
    return rows.withColumn(f"rsi_{n}", value).drop("_up", "_down", "_u", "_d")


def _true_range(keys: Sequence[str]) -> Column:
    before = F.lag("close").over(by(keys))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


@chunked(lambda a: a["n"])
def atr(df: DataFrame, n: int = 14, keys: Sequence[str] = SYMBOL) -> DataFrame:
    rows = df.withColumn("_tr", _true_range(keys))
    return rows.withColumn(f"atr_{n}", full(F.avg, F.col("_tr"), n, last_n(keys, n))).drop("_tr")


@chunked(lambda a: 2 * a["n"])
def adx(df: DataFrame, n: int = 14, keys: Sequence[str] = SYMBOL) -> DataFrame:
    """Directional index; the minus side takes the absolute change of the low, whatever the plus side does."""
    w = last_n(keys, n)
    rows = df.withColumn("_tr", _true_range(keys)).withColumn("_plus", F.greatest(F.col("high") - F.lag("high").over(by(keys)), F.lit(0.0)))
    rows = rows.withColumn("_plus", F.when(F.lag("high").over(by(keys)).isNotNull(), F.col("_plus"))).withColumn("_minus", F.abs(F.col("low") - F.lag("low").over(by(keys))))
    tr = full(F.avg, F.col("_tr"), n, w)
    rows = rows.withColumn("plus_di", 100 * safe_div(full(F.avg, F.col("_plus"), n, w), tr)).withColumn("minus_di", 100 * safe_div(full(F.avg, F.col("_minus"), n, w), tr))
    rows = rows.withColumn("_dx", 100 * safe_div(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return rows.withColumn(f"adx_{n}", full(F.avg, F.col("_dx"), n, w)).drop("_tr", "_plus", "_minus", "_dx")


@chunked(lambda a: max(a["periods"]))
def momentum(df: DataFrame, periods: Sequence[int] = (1, 2, 3, 6, 12), keys: Sequence[str] = SYMBOL, close: str = "close") -> DataFrame:
    return df.select("*", *[(safe_div(F.col(close), F.lag(close, p).over(by(keys))) - 1).alias(f"momentum_{p}") for p in periods])


def add_features(df: DataFrame, keys: Sequence[str] = SYMBOL, spans: Sequence[int] = (9, 21, 50, 200), pos: str | None = None) -> DataFrame:
    """All indicators of a series; unchanged without a close column. One numbering, and one shuffle for all windows."""
    if "close" not in df.columns:
        return df
    rows = df.withColumn("_at", F.col(pos)) if pos else with_pos(df, keys, out="_at")
    rows = in_chunks(rows, keys, lambda d, k: momentum(adx(atr(rsi(pct_return(log_return(d, k), k), keys=k), keys=k), keys=k), keys=k), 28, pos="_at")
    return emas(rows, spans, keys, pos="_at").drop("_at")


@chunked(lambda a: a["n"] - 1)
def rolling_volatility(df: DataFrame, n: int = 100, keys: Sequence[str] = SYMBOL, ret: str = "log_return") -> DataFrame:
    return df.withColumn("volatility", full(F.stddev_samp, F.col(ret), n, last_n(keys, n)))


@chunked(lambda a: 6 * a["n"])
def volatility_regime(df: DataFrame, n: int = 100, keys: Sequence[str] = SYMBOL, ret: str = "log_return") -> DataFrame:
    """LOW, NORMAL or HIGH by the rank of the volatility in its last 5n values; NORMAL before there are so many."""
    rows = rolling_apply(rolling_volatility(df, n, keys, ret), keys, 5 * n, {"_rank": ("percent_rank", "volatility")})
    return rows.withColumn("volatility_regime", F.when(F.col("_rank") <= 0.2, "LOW").when(F.col("_rank") >= 0.8, "HIGH").otherwise("NORMAL")).drop("_rank")


def atr_pct(df: DataFrame, n: int = 14) -> DataFrame:
    return df.withColumn("atr_pct", safe_div(F.col(f"atr_{n}"), F.col("close")) * 100)
