"""Series, groups and pair lists of any size: what is new against plain restatements, and how much one task holds."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairbars.functions.quantiles import quantiles
from pairbars.functions.rolling import with_pos
from pairbars.operators import backtest, cleaning, correlation, events, features, leadlag, ratio, spread, stattests, sync, walkforward
from pairbars.operators.chunks import chunk_with_halo, in_chunks
from pairbars.operators.select import greedy_select
from pairbars.sources import bars as src

T0 = datetime(2024, 1, 1)


def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz")).replace(float("nan"), None)


def long_series(spark, n=60_000, key="pair_id", seconds=600):
    """One series made by Spark, in no order."""
    rows = spark.range(n).select(F.lit("P").alias(key), (F.lit(1704067200) + F.col("id") * seconds).alias("t"), "id")
    return rows.select(key, F.timestamp_seconds("t").cast("timestamp_ntz").alias("bar_ts"), "id", (F.rand(1) - 0.5).alias("a_log_return"), (F.rand(2) - 0.5).alias("b_log_return")).orderBy(F.xxhash64("id"))


def largest_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_numbers_of_a_long_series_need_no_task_that_holds_it(spark):
    n = 60_000
    rows = with_pos(long_series(spark, n), ["pair_id"])
    assert rows.filter("pos != id").count() == 0 and rows.count() == n
    plan = rows._jdf.queryExecution().toString()
    assert "row_number() windowspecdefinition(pair_id" in plan and "_slot" in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert largest_task(rows) < 0.6 * n
        chunks = chunk_with_halo(rows, ["pair_id"], 99, 5_000, pos="pos").repartition("pair_id", "_chunk")
        assert largest_task(chunks) < 0.75 * n
        assert chunks.groupBy("_chunk").count().agg(F.max("count")).first()[0] == 5_099
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_numbers_begin_anew_for_each_key_and_ties_and_nulls_are_kept(spark):
    rng = random.Random(1)
    times = [T0 + timedelta(hours=rng.randrange(400)) for _ in range(300)]
    pdf = pd.DataFrame({"symbol": [rng.choice("ABC") for _ in times], "bar_ts": times})
    got = with_pos(frame(spark, pdf), ["symbol"]).toPandas()
    for _, part in got.groupby("symbol"):
        part = part.sort_values("pos")
        assert part["pos"].tolist() == list(range(len(part))) and part["bar_ts"].is_monotonic_increasing
    odd = spark.createDataFrame([(None, T0), ("A", None), ("A", T0)], "symbol string, bar_ts timestamp_ntz")
    assert with_pos(odd, ["symbol"]).count() == 3
    assert with_pos(odd.limit(0), ["symbol"]).count() == 0


@pytest.mark.parametrize("pos", [None, "id"])
def test_windows_in_small_chunks_are_windows_of_the_series(spark, pos):
    rows = long_series(spark, 700).withColumn("residual_zscore", F.col("a_log_return") * 6).withColumn("close", F.exp(F.col("b_log_return"))).cache()
    rows = rows.withColumn("high", F.col("close") + 1).withColumn("low", F.col("close") - 1).withColumn("ratio", F.col("close"))
    key, small = ["pair_id"], {"rows": 64, "pos": pos}
    whole = {"rows": 10**6, "pos": pos}
    runs = {
        "corr_50": lambda w: correlation.rolling_correlation(rows, (50,), **w),
        "beta": lambda w: ratio.rolling_beta(rows, 40, shift=2, **w),
        "ratio_zscore_100": lambda w: ratio.ratio_features(rows, (20,), **w),
        "volatility_regime": lambda w: features.volatility_regime(rows, 10, key, "a_log_return", **w),
        "adx_14": lambda w: features.adx(rows, keys=key, **w),
        "rsi_14": lambda w: features.rsi(rows, keys=key, **w),
        "residual_zscore": lambda w: ratio.scored(rows, 30, 20, **w),
        "_a_12": lambda w: events.with_forward(rows, **w),
    }
    for column, run in runs.items():
        a, b = ({r.id: r[column] for r in run(w).select("id", column).collect()} for w in (small, whole))
        assert len(a) == 700 and a.keys() == b.keys()
        assert all(a[i] == b[i] or (a[i] is not None and b[i] is not None and a[i] == pytest.approx(b[i], rel=1e-9)) for i in b), column
    x = np.array([r.a_log_return for r in rows.orderBy("id").collect()])
    y = np.array([r.b_log_return for r in rows.orderBy("id").collect()])
    grid = {(r.direction, r.lag): r.correlation for r in leadlag.lead_lag(rows, 3, pos=pos).collect()}
    assert grid["a_leads_b", 3] == pytest.approx(np.corrcoef(x[:-3], y[3:])[0, 1])
    shared = in_chunks(rows, key, lambda d, k: ratio.scored(features.log_return(d, k, "close", "r"), 30, 20, keys=k), 60, rows=64, pos=pos)
    alone = {r.id: r.residual_zscore for r in ratio.scored(rows, 30, 20).collect()}
    assert all(r.residual_zscore == pytest.approx(alone[r.id]) for r in shared.collect() if alone[r.id] is not None)


def test_ema_of_any_span_and_length(spark):
    rows = long_series(spark, 9_000, "symbol").withColumn("close", F.col("a_log_return") + 100)
    got = {r.id: r for r in features.emas(rows, (1, 2, 9, 200, 200)).collect()}
    x = [r.close for r in rows.orderBy("id").collect()]
    for span in (1, 2, 9, 200):
        want = pd.Series(x).ewm(span=span, adjust=False).mean()
        assert [got[i][f"ema_{span}"] for i in range(len(x))] == pytest.approx(want.tolist(), rel=1e-9)


@pytest.mark.parametrize("slots", [65_536, 16, 1])
def test_quantiles_are_exact_for_any_slots(spark, slots):
    rng = np.random.default_rng(4)
    groups = {"ties": rng.integers(0, 3, 400).astype(float), "wide": np.concatenate([rng.normal(size=300), [1e12, -1e9]]), "one": np.array([2.5]), "two": np.array([1.0, 4.0]), "same": np.full(50, 7.0), "near": 1 + rng.normal(size=500) * 1e-9, "huge": np.array([-1.7e308, 0.0, 1.7e308])}
    pdf = pd.DataFrame([(k, v) for k, values in groups.items() for v in values] + [("none", None), ("ties", None)], columns=["k", "x"])
    shares = {"low": 0.0, "q": 0.37, "median": 0.5, "q95": 0.95, "q99": 0.99, "high": 1.0}
    got = {r.k: r for r in quantiles(spark.createDataFrame(pdf).replace(float("nan"), None), ["k"], "x", shares, slots).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, p in shares.items():
            s, at = np.sort(values), p * (len(values) - 1)
            low, high = math.floor(at), math.ceil(at)
            assert got[k][name] == pytest.approx(s[low] if low == high else (high - at) * s[low] + (at - low) * s[high], rel=1e-12)


def test_the_sketch_of_spreads_keeps_its_rank_error(spark):
    n, accuracy = 20_000, 200
    df = spark.range(n).select(F.lit("P").alias("pair_id"), F.xxhash64("id").cast("double").alias("a_spread"), F.lit(None).cast("double").alias("b_spread")).cache()
    values = np.sort([r.a_spread for r in df.collect()])
    rows = {r.instrument: r for r in spread.spread_stats(df, accuracy=accuracy).collect()}
    exact = {r.instrument: r for r in spread.spread_stats(df).collect()}
    for name, p in (("median", 0.5), ("q95", 0.95), ("q99", 0.99)):
        assert abs(np.searchsorted(values, rows["a"][name], side="right") / n - p) <= 1 / accuracy + 1e-12  # a float of exactly that many ranks
        assert exact["a"][name] == pytest.approx(np.quantile(values, p), rel=1e-12)
        assert rows["b"][name] == exact["b"][name] == 0.0


def _greedy(rows, phases):
    kept, last = [], -math.inf
    for start, end, *_ in sorted(rows, key=lambda r: (r[2] if phases else 0, r[0])):
        if start > last:
            kept.append((start, end))
            last = math.inf if end is None else end
    return sorted(kept, key=str)


@pytest.mark.parametrize(("seed", "phases", "rows"), [(s, p, r) for s in range(4) for p in (False, True) for r in (5, 40, 10_000)])
def test_greedy_choice_in_chunks_is_the_plain_loop(spark, seed, phases, rows):
    rng = random.Random(seed)
    reach = rng.choice([1, 7, 30])
    data = [(k, i, None if rng.random() < 0.002 else i + rng.randrange(reach + 1), ph) for k in "AB" for ph in range(3) for i in range(400) if rng.random() < (0.9 if k == "A" else 0.1) * (1 if ph else rng.random())]
    df = spark.createDataFrame(data, "pair_id string, start int, end int, phase int")
    if not phases:
        df = df.filter("phase = 1")
        data = [d for d in data if d[3] == 1]
    got = greedy_select(df, ["pair_id"], reach, phases=["phase"] if phases else [], rows=rows).collect()
    for k in "AB":
        assert sorted([(r.start, r.end) for r in got if r.pair_id == k], key=str) == _greedy([d[1:] for d in data if d[0] == k], phases)


@pytest.mark.parametrize("mode", ["sequential", "per_threshold", "per_side"])
def test_events_of_dense_scores_in_all_modes(spark, mode):
    z = np.random.default_rng(8).normal(size=2500) * 3
    df = frame(spark, pd.DataFrame({"pair_id": "P", "bar_ts": [T0 + timedelta(minutes=i) for i in range(len(z))], "residual_zscore": z, "pos": np.arange(len(z))}))
    want, last = [], -99
    for t in (1.5, 2.0):
        last = -99 if mode != "sequential" else last
        for side in (1, -1):
            last = -99 if mode == "per_side" else last
            for i in np.flatnonzero(side * z >= t):
                if i - last > 3:
                    want.append((t, int(i)))
                    last = i
    got = events.detect_divergences(df, (1.5, 2.0), 3, mode=mode).collect()
    assert sorted((r.threshold, r.pos) for r in got) == sorted(want)


def test_pairs_by_time_are_pairs_by_join(spark):
    rng = random.Random(2)
    bars = spark.createDataFrame([(s, T0 + timedelta(hours=h), rng.random()) for s in "ABCDE" for h in range(60) if rng.random() < 0.7] + [(None, T0, 1.0), ("A", None, 1.0)], "symbol string, bar_ts timestamp_ntz, close double").cache()
    pairs = sync.all_pairs(bars.dropna())
    by_pair = {}
    for r in bars.dropna().collect():
        by_pair.setdefault(r.symbol, {})[r.bar_ts] = r.close
    want = {(f"{a}/{b}", t, by_pair[a][t], by_pair[b][t]) for a in by_pair for b in by_pair if a < b for t in by_pair[a].keys() & by_pair[b].keys()}
    for listed in (None, pairs):
        got = sync.synchronize(bars, listed)
        assert {(r.pair_id, r.bar_ts, r.a_close, r.b_close) for r in got.collect()} == want
        alone = {(f"{a}/{b}", s, t) for a in by_pair for b in by_pair if a < b for s, t in [*[("a", t) for t in by_pair[a].keys() - by_pair[b].keys()], *[("b", t) for t in by_pair[b].keys() - by_pair[a].keys()]]}
        assert {(r.pair_id, r.side, r.bar_ts) for r in sync.unmatched(bars, listed).collect()} == alone
        report = {r.pair_id: r for r in sync.sync_report(bars.dropna(), listed, 3600).collect()}
        assert report["A/B"].matched == sum(w[0] == "A/B" for w in want) and report["A/B"].a_unmatched == sum(x[:2] == ("A/B", "a") for x in alone)
    some = pairs.filter("pair_id in ('A/B', 'C/E')")
    assert {r.pair_id for r in sync.synchronize(bars, some).select("pair_id").distinct().collect()} == {"A/B", "C/E"}
    sent, sync.PAIRS_SENT = sync.PAIRS_SENT, 3
    try:
        assert {(r.pair_id, r.bar_ts, r.a_close, r.b_close) for r in sync.synchronize(bars, pairs).collect()} == want
    finally:
        sync.PAIRS_SENT = sent


def test_newest_bars_are_cut_on_the_edge_day_only(spark):
    rows = long_series(spark, 5_000, "symbol", 1_700).unionByName(long_series(spark, 30, "symbol").withColumn("symbol", F.lit("Q")))
    for n in (1, 50, 51, 4_999, 9_999):
        got = src.latest_n_bars(rows, n).groupBy("symbol").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()
        assert {(r.symbol, r.n, r.first) for r in got} == {("P", min(n, 5_000), max(0, 5_000 - n)), ("Q", min(n, 30), max(0, 30 - n))}


@pytest.mark.parametrize(("rule", "months", "anchor"), [("MS", 1, "start"), ("ME", 1, "end"), ("BMS", 1, "business_start"), ("BME", 1, "business_end"), ("QS", 3, "start"), ("QE", 3, "end"), ("BQE", 3, "business_end"), ("YS", 12, "start"), ("2MS", 2, "start")])
def test_calendars_of_months(spark, rule, months, anchor):
    times = pd.date_range("2015-01-01 09:30", periods=40, freq=rule)
    gone = [20, 21, 33]
    df = frame(spark, pd.DataFrame({"symbol": "A", "bar_ts": times.delete(gone)}))
    r = cleaning.infer_frequency(df, first=15).first()
    assert (r.step_seconds, r.weekdays_only, r.months, r.anchor) == (None, False, months, anchor)
    assert sorted(x.bar_ts for x in cleaning.missing_bars(df, first=15).collect()) == list(times[gone])
    # with a gap among the first bars there is no rule
    assert cleaning.infer_frequency(df).first().months is None and cleaning.missing_bars(df).count() == 0


def test_weekly_bars_are_a_step_of_seconds(spark):
    times = pd.date_range("2015-01-05", periods=130, freq="7D")
    df = frame(spark, pd.DataFrame({"symbol": "A", "bar_ts": times.delete([110])}))
    assert cleaning.infer_frequency(df).first().step_seconds == 7 * 86_400
    assert [x.bar_ts for x in cleaning.missing_bars(df).collect()] == [times[110]]


def test_slices_by_division_are_slices_by_comparison(spark):
    n = 4_000
    df = frame(spark, pd.DataFrame({"pair_id": "P", "bar_ts": [T0 + timedelta(minutes=i) for i in range(n)], "pos": np.arange(n)}))
    windows = walkforward.walkforward_windows(df, 0.1, 0.05, 0.02, min_train=100)
    plan = windows.collect()
    assert len(plan) > 40
    want = {(w.window, s, p - w[f"{s}_from"], p) for w in plan for s in ("train", "val", "test") for p in range(w[f"{s}_from"], w[f"{s}_to"] + 1)}
    got = walkforward.walkforward_slices(df.withColumn("old", F.col("pos")), windows).collect()
    assert len(got) == len(want) and {(r.window, r.split, r.pos, r.old) for r in got} == want


def test_exits_need_no_list_of_bars(spark):
    n = 200
    rng = np.random.default_rng(3)
    df = frame(spark, pd.DataFrame({"pair_id": "P", "bar_ts": [T0 + timedelta(minutes=i) for i in range(n)], "pos": np.arange(n), "residual_zscore": rng.normal(size=n) * 2, "b_close": rng.random(n), "b_spread": 1.0}))
    plan = backtest.mean_reversion_trades(df)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_several_series_are_tested_in_one_plan(spark):
    n = 400
    rng = np.random.default_rng(3)
    walk, noise = rng.normal(size=n).cumsum(), rng.normal(size=n)
    df = frame(spark, pd.DataFrame({"pair_id": "P", "bar_ts": [T0 + timedelta(minutes=i) for i in range(n)], "walk": walk, "noise": noise, "none": np.nan}))
    got = {r.series: r for r in stattests.adf_tests(df, ["walk", "noise", "none"]).collect()}
    for x in ("walk", "noise"):
        one = stattests.adf_test(df, x).first()
        assert got[x].lag == one.lag and (got[x].statistic, got[x].p_value) == pytest.approx((one.statistic, one.p_value), rel=1e-9)  # sums in any order
    assert (got["none"].statistic, got["none"].p_value, got["none"].stationary) == (0.0, 1.0, False)
    assert got["noise"].stationary and not got["walk"].stationary


@pytest.mark.parametrize("chunk", [3, 50, 10_000])
def test_running_results_in_chunks(spark, chunk):
    rng = np.random.default_rng(6)
    pos = np.sort(rng.choice(2_000, 300, replace=False))
    net = rng.normal(size=300).round(3)
    trades = spark.createDataFrame(pd.DataFrame({"pair_id": "P", "pos": pos, "net_pnl": net})).repartition(4)
    got = backtest.equity_curve(trades, chunk=chunk).orderBy("pos").toPandas()
    equity = net.cumsum()
    assert got["equity"].tolist() == pytest.approx(equity.tolist()) and got["peak"].tolist() == pytest.approx(np.maximum.accumulate(equity).tolist())
    assert backtest.max_drawdown(trades, chunk=chunk).first().max_drawdown == pytest.approx((np.maximum.accumulate(equity) - equity).max())
    longest = run = 0
    for x in net:
        run = 0 if x > 0 else run + 1
        longest = max(longest, run)
    assert backtest.max_losing_run(trades, chunk=chunk).first().max_losing_run == longest
