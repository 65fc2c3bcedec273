"""Indicators, lags, tests and strategies against plain restatements."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairbars.operators import backtest, correlation, events, features, leadlag, stattests, summary, walkforward
from pairbars.operators.chunks import rolling_apply

T0 = datetime(2024, 1, 1)


def series(spark, key="symbol", **columns):
    n = len(next(iter(columns.values())))
    frame = pd.DataFrame({key: "A", "bar_ts": [T0 + timedelta(minutes=10 * i) for i in range(n)], **columns})
    return spark.createDataFrame(frame).withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz")).replace(float("nan"), None)


def values(df, column):
    return [r[column] for r in df.orderBy("bar_ts").collect()]


@pytest.fixture(scope="module")
def walk():
    return 100 + np.random.default_rng(42).normal(size=300).cumsum()


def test_returns_and_momentum(spark, walk):
    df = series(spark, close=walk)
    assert values(features.log_return(df), "log_return")[1:] == pytest.approx(np.diff(np.log(walk)))
    assert values(features.pct_return(df), "pct_return")[1:] == pytest.approx(walk[1:] / walk[:-1] - 1)
    assert values(features.momentum(df, [3]), "momentum_3")[3:] == pytest.approx(walk[3:] / walk[:-3] - 1)


@pytest.mark.parametrize("chunk", [7, 64, 512])
def test_ema_is_the_recursion_for_any_chunk(spark, walk, chunk):
    want = [walk[0]]
    for x in walk[1:]:
        want.append(want[-1] + 2 / 22 * (x - want[-1]))
    assert values(features.ema(series(spark, close=walk), 21, chunk=chunk), "ema_21") == pytest.approx(want)


def test_rsi_bounds_and_ends(spark, walk):
    got = values(features.rsi(series(spark, close=walk)), "rsi_14")
    assert got[:13] == [None] * 13 and all(0 <= v <= 100 for v in got[13:])
    assert values(features.rsi(series(spark, close=np.arange(1.0, 21))), "rsi_14")[-1] == 100
    assert values(features.rsi(series(spark, close=np.ones(20))), "rsi_14")[-1] is None


def test_atr_adx_first_rows(spark, walk):
    df = series(spark, close=walk, open=walk, high=walk + 1, low=walk - 1)
    assert [v is None for v in values(features.atr(df), "atr_14")[:15]] == [True] * 13 + [False] * 2
    assert [v is None for v in values(features.adx(df), "adx_14")[25:29]] == [True, True, False, False]
    assert {"ema_200", "adx_14", "momentum_12"} <= set(features.add_features(df).columns)
    assert features.add_features(df.drop("close")).columns == df.drop("close").columns


@pytest.mark.parametrize("rows", [10_000, 37])
def test_rolling_rank_is_pandas_rank_for_any_chunk(spark, rows):
    x = np.random.default_rng(1).integers(0, 9, 150).astype(float)
    want = pd.Series(x).rolling(20).apply(lambda w: pd.Series(w).rank(pct=True).iloc[-1], raw=False)
    got = values(rolling_apply(series(spark, x=x), ["symbol"], 20, {"r": ("percent_rank", "x")}, rows), "r")
    assert got[:19] == [None] * 19 and got[19:] == pytest.approx(want[19:].tolist())


@pytest.mark.parametrize("lag", [2, 3])
def test_planted_lag_is_found(spark, lag):
    rng = np.random.default_rng(42)
    a = rng.normal(size=200) * 0.001
    b = np.roll(a, lag) * 0.8 + rng.normal(size=200) * 0.0002
    best = {r.direction: r for r in leadlag.best_lag(leadlag.lead_lag(series(spark, "pair_id", a_log_return=a, b_log_return=b))).collect()}
    assert best["a_leads_b"].lag == lag and best["a_leads_b"].minutes == 10 * lag and best["a_leads_b"].sample_size == 200 - lag


def test_noise_and_nulls_have_no_lag(spark):
    rng = np.random.default_rng(42)
    noise = leadlag.best_lag(leadlag.lead_lag(series(spark, "pair_id", a_log_return=rng.normal(size=300), b_log_return=rng.normal(size=300)))).collect()
    assert all(abs(r.correlation) < 0.3 for r in noise)
    empty = series(spark, "pair_id", a_log_return=np.zeros(30), b_log_return=np.zeros(30))
    assert {(r.lag, r.correlation, r.minutes) for r in leadlag.best_lag(leadlag.lead_lag(empty)).collect()} == {(0, 0.0, 0)}
    flat = correlation.rolling_correlation(empty, [5])
    assert set(values(flat, "corr_5")) == {None}


def test_one_correlation_at_lag_0_makes_neither_direction_stronger(spark):
    """Both have it, so a is not larger than b in any pair, whichever way the sums are rounded."""
    rng, pairs, n = np.random.default_rng(4), 40, 120
    a = rng.normal(size=pairs * n)
    frame = pd.DataFrame({"pair_id": np.repeat([f"P{i:02}" for i in range(pairs)], n), "bar_ts": [T0 + timedelta(minutes=10 * i) for i in range(n)] * pairs, "a_log_return": a, "b_log_return": 0.8 * a + rng.normal(size=pairs * n)})
    best = leadlag.best_lag(leadlag.lead_lag(spark.createDataFrame(frame)))
    sides = [F.first(F.when(F.col("direction") == d, F.col("correlation")), ignorenulls=True).alias(c) for d, c in (("a_leads_b", "corr_ab"), ("b_leads_a", "corr_ba"))]
    facts = best.groupBy("pair_id").agg(F.max("lag").alias("lag"), *sides)
    assert [(r.lag, r.corr_ab - r.corr_ba) for r in facts.collect()] == [(0, 0.0)] * pairs
    facts = facts.select("pair_id", "corr_ab", "corr_ba", *[F.lit(0.0).alias(c) for c in ("mean_corr", "pct_over_05", "z_std", "n_events", "half_life")], F.lit(False).alias("cointegrated"))
    rules = summary.conclusions(facts, spark.createDataFrame([], "pair_id string, strategy string, net_return double, profit_factor double"))
    assert [r.rule for r in rules.filter("rule like 'stronger%'").collect()] == ["stronger_b_to_a"] * pairs


def _adf(x, constant=True):
    """The test restated with plain least squares on one array."""
    x, n = np.asarray(x, float), len(x)
    dx, limit = np.diff(x), stattests.max_lag(n, constant)

    def design(k, first):
        cols = [x[first:-1]] + ([np.ones(n - 1 - first)] if constant else []) + [dx[first - j : n - 1 - j] for j in range(1, k + 1)]
        return np.column_stack(cols), dx[first:]

    def aic(k):
        z, y = design(k, limit)
        e = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
        return len(y) * math.log(e @ e / len(y)) + 2 * z.shape[1]

    k = min(range(limit + 1), key=aic)
    z, y = design(k, k)
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    e = y - z @ b
    return b[0] / math.sqrt(e @ e / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0]), k


def test_dickey_fuller_against_plain_least_squares(spark, walk):
    rng = np.random.default_rng(7)
    ar = [0.0]
    for e in rng.normal(size=249):
        ar.append(0.7 * ar[-1] + e)
    for x, stationary in ((walk, False), (np.array(ar), True)):
        r = stattests.adf_test(series(spark, "pair_id", x=x), "x").first()
        want, lag = _adf(x)
        assert r.statistic == pytest.approx(want, rel=1e-5) and r.lag == lag and r.stationary == stationary
    short = stattests.adf_test(series(spark, "pair_id", x=walk[:19]), "x").first()
    assert (short.statistic, short.p_value, short.stationary) == (0.0, 1.0, False)


def test_p_values_at_critical_levels():
    for variables in (1, 2):
        for share, c in zip((0.01, 0.05, 0.1), stattests.CRITICAL[variables].values(), strict=True):
            assert stattests.p_value(c[0], variables) == pytest.approx(share, abs=2e-3)


def test_cointegration(spark, walk):
    rng = np.random.default_rng(3)
    pair = series(spark, "pair_id", a_close=walk + rng.normal(size=300), b_close=0.5 * walk + rng.normal(size=300) * 0.2)
    assert stattests.engle_granger(pair).first().cointegrated
    exact = stattests.engle_granger(series(spark, "pair_id", a_close=walk, b_close=2 * walk)).first()
    assert exact.statistic == -math.inf and exact.cointegrated


def test_half_life_of_ar1(spark):
    rng, x = np.random.default_rng(42), [0.0]
    for e in rng.normal(size=499):
        x.append(0.95 * x[-1] + e)
    assert 5 < stattests.half_life(series(spark, "pair_id", x=np.array(x)), "x").first().half_life < 50


def test_autocorrelation_and_stability(spark, walk):
    rng = np.random.default_rng(1)
    a = rng.normal(size=500)
    df = series(spark, "pair_id", a_log_return=a, b_log_return=0.8 * a + rng.normal(size=500) * 0.3)
    rows = {r.lag: r.autocorrelation for r in correlation.autocorrelation(df, max_lag=5).collect()}
    assert rows[0] == pytest.approx(1) and abs(rows[3]) < 0.2
    s = correlation.correlation_stability(df, 100).first()
    assert s["mean"] > 0.8 and s["n_windows"] == len(range(0, 400, 50))


def _greedy_events(z, thresholds, cooldown):
    out, last = [], -cooldown - 1
    for t in thresholds:
        for hit in ([i for i, v in enumerate(z) if v >= t], [i for i, v in enumerate(z) if v <= -t]):
            for i in hit:
                if i - last > cooldown:
                    out.append((t, i))
                    last = i
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_events_with_cooldown(spark, seed):
    z = np.random.default_rng(seed).normal(size=300) * 1.5
    df = series(spark, "pair_id", residual_zscore=z, pos=np.arange(300))
    got = sorted((r.threshold, r.pos) for r in events.detect_divergences(df, (1.5, 2.0), 12).collect())
    assert got == _greedy_events(z, (1.5, 2.0), 12)


def _reversion(z, entry, leave, hold):
    out, side, at = [], 0, 0
    for i, v in enumerate(z):
        if side == 0:
            side, at = (-1, i) if v >= entry else (1, i) if v <= -entry else (0, 0)
        elif (side == 1 and v >= -leave) or (side == -1 and v <= leave) or i - at >= hold:
            out.append((at, i - at, "LONG" if side == 1 else "SHORT"))
            side = 0
    return out


@pytest.mark.parametrize("seed", range(3))
def test_one_position_at_a_time(spark, seed):
    rng = np.random.default_rng(seed)
    z = np.convolve(rng.normal(size=320), np.ones(8) / 2, "valid")[:300]
    df = series(spark, "pair_id", residual_zscore=z, pos=np.arange(300), b_close=100 + rng.normal(size=300), b_spread=np.ones(300))
    got = sorted((r.pos, r.holding_bars, r.side) for r in backtest.mean_reversion_trades(df, 2.0, 0.5, 10).collect())
    assert got == _reversion(z, 2.0, 0.5, 10)
    metrics = backtest.backtest_metrics(backtest.mean_reversion_trades(df, 99.0), df).first()
    assert metrics.total_trades == 0 and metrics.sharpe == 0


@pytest.mark.parametrize("n", [1498, 1499, 2000, 5000])
def test_walkforward_sizes(spark, n):
    train, val, step = int(n * 0.6), int(n * 0.2), int(n * 0.1)
    if train < 1000:
        train, val, step = 1000, int(1000 * 0.2 / 0.6), int(1000 * 0.1 / 0.6)
    want, start = [], 0
    while start + train + val + step <= n:
        want.append((start, start + train - 1, start + train + val - 1, start + train + val + step - 1))
        start += step
    got = walkforward.walkforward_windows(series(spark, "pair_id", pos=np.arange(n))).orderBy("window").collect()
    assert [(r.train_from, r.train_to, r.val_to, r.test_to) for r in got] == want


def test_walkforward_grid_is_each_combination_by_itself(spark, walk):
    rng = np.random.default_rng(11)
    n, z = len(walk), rng.normal(size=len(walk)) * 1.5
    df = series(spark, "pair_id", a_close=walk, b_close=walk[::-1].copy(), a_spread=np.ones(n), b_spread=np.ones(n), residual_zscore=z)
    df = df.withColumn("pos", F.row_number().over(Window.partitionBy("pair_id").orderBy("bar_ts")) - 1)
    slices = walkforward.walkforward_slices(df, walkforward.walkforward_windows(df, min_train=150), least={"train": 50, "val": 20, "test": 10})
    grid = {"entry": (1.0, 2.0), "max_hold": (5, 9)}
    combos = walkforward._combos(grid)
    inside = ["pair_id", "window", "split"]
    alone = [{(r.window, r.split): r for r in backtest.backtest_metrics(backtest.mean_reversion_trades(slices, keys=inside, **c), slices, inside).collect()} for c in combos]
    score = lambda r: r.net_return / max(abs(r.max_drawdown), 1e-6)
    best = {r.window: (r.combo, r.score) for r in walkforward.parameter_search(slices, backtest.mean_reversion_trades, grid).collect()}
    for window, (combo, value) in best.items():
        scores = [score(m[window, "val"]) for m in alone]
        assert combo == int(np.argmax(scores)) and value == pytest.approx(max(scores))
    got = walkforward.run_walkforward(slices, backtest.mean_reversion_trades, grid).collect()
    assert len(got) == 3 * len(best) > 0
    for r in got:
        assert r.combo == best[r.window][0] and r.net_return == pytest.approx(alone[r.combo][r.window, r.split].net_return)


def test_fixed_lag_against_plain_least_squares(spark, walk):
    d = np.diff(walk)
    y, z = d[2:], np.column_stack([walk[2:-1], np.ones(len(d) - 2), d[1:-1], d[:-2]])
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    e = y - z @ b
    want = b[0] / math.sqrt(e @ e / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
    r = stattests.adf_test(series(spark, "pair_id", x=walk), "x", lag=2).first()
    assert (r.statistic, r.lag, r.n_obs) == (pytest.approx(want, rel=1e-6), 2, len(y))


def test_cointegration_statistic_against_plain_least_squares(spark, walk):
    rng = np.random.default_rng(5)
    x, y = walk + rng.normal(size=len(walk)), 0.5 * walk + rng.normal(size=len(walk)) * 0.2
    slope, at = np.polyfit(y, x, 1)
    want, lag = _adf(x - slope * y - at, constant=False)
    r = stattests.engle_granger(series(spark, "pair_id", a_close=x, b_close=y)).first()
    assert r.statistic == pytest.approx(want, rel=1e-5)
    assert r.p_value == pytest.approx(stattests.p_value(want, 2), rel=1e-4)
