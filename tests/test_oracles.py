"""Queries against their SQL on the smallest tables; a sample of each group, since the driver compares all."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = ["s1_read_bars", "s1_read_bars_files", "s4_resolve_symbols", "s5_resample_w1", "s6_write_dataset", "c5_infer_frequency", "c7_quality_report", "c8_clean_bars", "j3_sync_report", "f3_ema", "f6_adx", "f10_volatility_regime", "r3_regime_table", "k2_rolling_spearman", "k6_correlation_stability", "l2_best_lag", "t3_ratio_percentile", "t7_residual_zscore", "e1_detect_divergences", "e7_ratio_reversion", "x1_adf_one_lag", "x2_engle_granger_one_lag", "wf4_parameter_search", "f8_add_features", "p3_spread_by_hour", "x3_half_life", "b2_mean_reversion_trades", "b4_backtest_metrics", "y4_return_histogram"]


def same(frame, cols):
    text = lambda v: "null" if v is None or v is pd.NA or v != v else f"{float(v):.6f}" if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in row) for row in frame[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert same(got, cols) == same(want, cols)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
