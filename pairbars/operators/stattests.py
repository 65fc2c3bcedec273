"""Stationarity, cointegration and mean-reversion tests, one row for each key.

A regression needs only the sums of products of its columns. Those with the target or the
level are aggregates over lagged columns; the others follow from them and from the differences at
both ends of the series. So a series is never in one place; what is solved for a key is a matrix as
wide as the lags.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbars.functions.rolling import by, with_pos
from pairbars.functions.work import written
from pairbars.operators.chunks import in_chunks

PAIR = ("pair_id",)
# Published response surfaces by (variables, with constant in the first stage).
SMALL_P = {1: (2.1659, 1.4412, 0.038269), 2: (2.92, 1.5012, 0.039796)}
LARGE_P = {1: (1.7339, 0.93202, -0.12745, -0.010368), 2: (2.1945, 0.64695, -0.29198, -0.042377)}
SWITCH = {1: (-18.83, -1.61, 2.74), 2: (-18.86, -2.62, 0.92)}
CRITICAL = {
    1: {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.04), "10%": (-2.56677, -1.5384, -2.809, 0.0)},
    2: {"1%": (-3.89644, -10.9519, -22.527, 0.0), "5%": (-3.33613, -6.1101, -6.823, 0.0), "10%": (-3.04445, -4.2412, -2.72, 0.0)},
}


def p_value(statistic: float, variables: int = 1) -> float:
    low, switch, high = SWITCH[variables]
    if statistic > high:
        return 1.0
    if statistic < low:
        return 0.0
    c = SMALL_P[variables] if statistic <= switch else LARGE_P[variables]
    return 0.5 * (1 + math.erf(sum(x * statistic**k for k, x in enumerate(c)) / math.sqrt(2)))


def critical(rows: int, variables: int = 1) -> dict[str, float]:
    return {k: sum(b / rows**i for i, b in enumerate(c)) for k, c in CRITICAL[variables].items()}


def max_lag(n: int, constant: bool) -> int:
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - int(constant) - 1))


def _fit(gram: np.ndarray, columns: list[int]) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, squared residuals and inverse of the regressors; column 0 is the target."""
    a = gram[np.ix_(columns, columns)]
    inverse = np.linalg.pinv(a)
    b = inverse @ gram[columns, 0]
    return b, float(gram[0, 0] - gram[columns, 0] @ b), inverse


def _test(gram: np.ndarray, x: np.ndarray, limit: int, n: int, constant: bool, search: bool) -> tuple[float, int, int]:
    """Statistic, chosen lag and rows used. Columns: target, level, 1, then lagged differences; ``x`` are the first values of the series."""
    fixed = [1, 2] if constant else [1]
    rows = n - 1 - limit
    best, lag = math.inf, 0 if search else limit
    for k in range(limit + 1 if search else 0):
        _, ssr, _ = _fit(gram, [*fixed, *range(3, 3 + k)])
        aic = rows * math.log(max(ssr, 1e-300) / rows) + 2 * (len(fixed) + k)
        if aic < best - 1e-12:
            best, lag = aic, k
    # a shorter lag also uses the rows that the longest lag has no values for
    d = np.diff(x)
    more = np.array([[d[t - 1], x[t - 1], 1.0, *d[t - 1 - lag : t - 1][::-1]] for t in range(lag + 1, limit + 1)]).reshape(-1, 3 + lag)
    columns = [*fixed, *range(3, 3 + lag)]
    whole = gram[: 3 + lag, : 3 + lag] + more.T @ more
    rows = n - 1 - lag
    b, ssr, inverse = _fit(whole, columns)
    return float(b[0] / math.sqrt(max(ssr, 0) / (rows - len(columns)) * inverse[0, 0])), lag, rows


def _gram(own: np.ndarray, level: np.ndarray, ones: np.ndarray, squares: tuple[float, float, float], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of products of all columns, from the sums that hold the target or the level and the differences at both ends.

    Products of two lagged differences are those of one lag less, shifted by a row: one product comes in at the front and
    one goes out at the back.
    """
    limit = len(own) - 1
    lags = np.zeros((limit + 1, limit + 1))
    lags[0] = own
    for i in range(limit):
        lags[i + 1, i + 1 :] = lags[i, i:limit] + first[limit - 1 - i] * first[: limit - i][::-1] - last[-1 - i] * last[: len(last) - i][::-1][: limit - i]
    lags = np.triu(lags) + np.triu(lags, 1).T
    order = [0, *range(3, 3 + limit)]
    gram = np.zeros((3 + limit, 3 + limit))
    gram[np.ix_(order, order)] = lags
    gram[1, order] = gram[order, 1] = level
    gram[2, order] = gram[order, 2] = ones
    gram[1, 1], gram[1, 2], gram[2, 1], gram[2, 2] = squares[0], squares[1], squares[1], squares[2]
    return gram


def dickey_fuller(df: DataFrame, x: str, keys: Sequence[str] = PAIR, constant: bool = True, variables: int = 1, least: int = 20, significance: float = 0.05, lag: int | None = None) -> DataFrame:
    """Augmented test with the lag of the smallest AIC, or with a given ``lag``.

    Returns ``statistic``, ``p_value``, ``lag``, ``n_obs``, critical values and
    ``stationary``; keys with fewer than ``least`` values give 0, 1 and false.
    """
    keys, search = list(keys), lag is None
    every = written(df.select(*keys, "bar_ts", F.col(x).cast("double").alias("x")))
    rows = every.filter("x is not null")
    n = F.col("n")
    limit = F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - int(constant) - 1) if search else F.least(F.lit(lag), n - 4)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("center")).filter(n >= least).withColumn("limit", F.greatest(limit, F.lit(0)).cast("int"))
    sizes = written(sizes)
    width = sizes.agg(F.max("limit")).first()[0] or 0
    rows = with_pos(rows.join(sizes, keys), keys, out="row").withColumn("x", F.col("x") - (F.col("center") if constant else F.lit(0.0)))

    def lagged(d: DataFrame, own: list[str]) -> DataFrame:
        w = by(own)
        d = d.withColumn("d0", F.col("x") - F.lag("x").over(w)).withColumn("level", F.lag("x").over(w))
        return d.select("*", *[F.lag("d0", k).over(w).alias(f"d{k}") for k in range(1, width + 1)])

    rows = in_chunks(rows, keys, lagged, width + 1, pos="row")
    used = lambda c: F.sum(F.when(F.col("row") > F.col("limit"), c))
    lags = [F.col(f"d{k}") for k in range(width + 1)]
    sums = rows.groupBy(*keys, "n", "limit").agg(
        F.array(*[used(F.col("d0") * d) for d in lags]).alias("own"), F.array(*[used(F.col("level") * d) for d in lags]).alias("level"), F.array(*[used(d) for d in lags]).alias("ones"),
        F.array(used(F.col("level") * F.col("level")), used(F.col("level")), used(F.lit(1.0))).alias("squares"),
        # as many values at either end as there are lags
        F.array_sort(F.collect_list(F.when(F.col("row") <= F.col("limit") + 1, F.struct("row", "x")))).alias("first"), F.array_sort(F.collect_list(F.when(F.col("row") >= F.col("n") - F.col("limit") - 1, F.struct("row", "x")))).alias("last"),
    )
    sums = sums.select(*keys, "n", "limit", "own", "level", "ones", "squares", F.transform("first", lambda v: v["x"]).alias("first"), F.transform("last", lambda v: v["x"]).alias("last"))

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        n, most = int(row["n"]), int(row["limit"])
        first, last = (np.array(row[c], float) for c in ("first", "last"))
        own, level, ones = (np.array(row[c], float)[: most + 1] for c in ("own", "level", "ones"))
        gram = _gram(own, level, ones, tuple(row["squares"]), np.diff(first), np.diff(last))
        statistic, chosen, used = _test(gram, first, most, n, constant, search)
        p, levels = p_value(statistic, variables), critical(used if variables == 1 else n - 1, variables)
        return rows[keys].assign(statistic=statistic, p_value=p, lag=chosen, n_obs=used, critical_1=levels["1%"], critical_5=levels["5%"], critical_10=levels["10%"], stationary=p < significance)

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    found = sums.groupBy(*keys).applyInPandas(solved, f"{kinds}, statistic double, p_value double, lag long, n_obs long, critical_1 double, critical_5 double, critical_10 double, stationary boolean")
    out = every.select(*keys).distinct().join(found, keys, "left")
    return out.na.fill({"statistic": 0.0, "p_value": 1.0, "lag": 0, "n_obs": 0, "stationary": False})


def adf_tests(df: DataFrame, series: Sequence[str], keys: Sequence[str] = PAIR, significance: float = 0.05, lag: int | None = None) -> DataFrame:
    """The test of several columns in one plan, a row for each key and ``series``."""
    cells = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("x")) for c in series])
    return dickey_fuller(df.select(*keys, "bar_ts", F.inline(cells)), "x", [*keys, "series"], significance=significance, lag=lag)


def adf_test(df: DataFrame, x: str, keys: Sequence[str] = PAIR, significance: float = 0.05, lag: int | None = None) -> DataFrame:
    return dickey_fuller(df, x, keys, significance=significance, lag=lag)


def engle_granger(df: DataFrame, x: str = "a_close", y: str = "b_close", keys: Sequence[str] = PAIR, significance: float = 0.05, lag: int | None = None) -> DataFrame:
    """Regresses x on y with a constant, then tests the residual without one; collinear sides give minus infinity. ``hedge_ratio`` is 0 always."""
    keys = list(keys)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    line = rows.groupBy(*keys).agg(F.regr_slope(x, y).alias("_slope"), F.regr_intercept(x, y).alias("_at"), F.regr_r2(x, y).alias("_r2"))
    left = rows.join(line, keys).withColumn("_e", F.col(x) - F.col("_slope") * F.col(y) - F.col("_at"))
    exact = F.col("_r2") >= 1 - 1e-10
    found = dickey_fuller(left.withColumn("_e", F.when(~exact, F.col("_e"))), "_e", keys, False, 2, significance=significance, lag=lag).join(line.select(*keys, "_r2"), keys)
    collinear = F.coalesce(exact, F.lit(False))
    return found.select(*keys, F.when(collinear, float("-inf")).otherwise(F.col("statistic")).alias("statistic"), F.when(collinear, 0.0).otherwise(F.col("p_value")).alias("p_value"), "critical_1", "critical_5", "critical_10", F.lit(0.0).alias("hedge_ratio"), (collinear | F.col("stationary")).alias("cointegrated"))


def half_life(df: DataFrame, x: str, keys: Sequence[str] = PAIR, least: int = 20) -> DataFrame:
    """Bars to halve a deviation, from the slope of changes on levels; infinite without reversion, 0 with fewer than ``least`` values."""
    rows = df.filter(F.col(x).isNotNull()).select(*keys, "bar_ts", F.col(x).alias("_x"))
    rows = in_chunks(rows, keys, lambda d, own: d.withColumn("_before", F.lag("_x").over(by(own))), 1)
    fit = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(F.col("_x") - F.col("_before"), F.col("_before")).alias("s"))
    enough, reverts = F.col("n") >= least, F.col("s") < 0
    return fit.select(*keys, F.when(enough & reverts, -math.log(2) / F.col("s")).when(enough, float("inf")).otherwise(0.0).alias("half_life"), F.when(enough & reverts, -F.col("s")).otherwise(0.0).alias("speed"))
