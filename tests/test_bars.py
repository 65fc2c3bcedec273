"""Cleaning and joining on small bar tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pairbars.operators import cleaning, sync
from pairbars.sources import bars as src

T0 = datetime(2024, 1, 1)
SCHEMA = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, tick_volume long, spread int, real_volume long, seq long"


def make(spark, rows, symbol="A", start=T0):
    """rows: (minutes, open, high, low, close)."""
    return spark.createDataFrame([(symbol, start + timedelta(minutes=m), o, h, lo, c, 10, 2, 10, i) for i, (m, o, h, lo, c) in enumerate(rows)], SCHEMA)


GOOD = [(m, 10.0, 11.0, 9.0, 10.5) for m in (0, 10, 20, 30)]


def changed(i, **new):
    rows = [list(r) for r in GOOD]
    for k, v in new.items():
        rows[i][["m", "open", "high", "low", "close"].index(k)] = v
    return [tuple(r) for r in rows]


@pytest.mark.parametrize(
    ("rows", "column", "left"),
    [(changed(1, open=None), "null_values", 3), (changed(1, open=0.0), "zero_prices", 3), (changed(1, high=9.5), "invalid_ohlc", 3), (changed(1, m=0), "duplicates", 3)],
)
def test_each_fault_is_counted_and_removed(spark, rows, column, left):
    bars = make(spark, rows)
    assert cleaning.clean_bars(bars).count() == left
    report = cleaning.quality_report(bars, step_seconds=600).first()
    assert (report[column], report["total_bars"]) == (1, 4)


def test_negative_goes_only_beside_a_zero(spark):
    rows = changed(2, open=-1.0, low=-1.0)
    assert cleaning.drop_zero_price(make(spark, rows)).count() == 4
    assert cleaning.drop_zero_price(make(spark, rows), strict=True).count() == 3
    rows[0] = (0, 0.0, 11.0, 0.0, 10.5)
    assert cleaning.drop_zero_price(make(spark, rows)).count() == 2


def test_first_arrival_stays(spark):
    bars = make(spark, [(0, 1.0, 2.0, 1.0, 1.5), (0, 1.0, 2.0, 1.0, 1.9)])
    assert cleaning.clean_bars(bars).first()["close"] == 1.5


def test_gaps_are_the_calendar_without_the_bars(spark):
    bars = make(spark, [(m, 10.0, 11.0, 9.0, 10.5) for m in (0, 10, 40, 50)])
    assert sorted(r.bar_ts for r in cleaning.missing_bars(bars, 600).collect()) == [T0 + timedelta(minutes=m) for m in (20, 30)]
    assert cleaning.infer_frequency(bars).first()["step_seconds"] is None
    assert cleaning.infer_frequency(make(spark, GOOD)).first()["step_seconds"] == 600
    assert cleaning.infer_frequency(make(spark, GOOD[:2])).first()["step_seconds"] is None


def test_bars_on_business_days_have_no_gap_at_weekends(spark):
    days = [d for d in range(0, 60) if (T0 + timedelta(days=d)).weekday() < 5]
    bars = lambda left: make(spark, [(1440 * d, 10.0, 11.0, 9.0, 10.5) for d in left])
    r = cleaning.infer_frequency(bars(days)).first()
    assert (r.step_seconds, r.weekdays_only) == (86_400, True)
    assert cleaning.missing_bars(bars(days)).count() == 0
    r = cleaning.infer_frequency(bars(range(20))).first()
    assert (r.step_seconds, r.weekdays_only) == (86_400, False)
    assert cleaning.infer_frequency(bars([d for d in days if d != days[7]])).first().step_seconds is None
    holes = [days[-2], days[-6]]
    late = cleaning.missing_bars(bars([d for d in days if d not in holes]).filter("true"), keys=["symbol"])
    assert late.count() == 0  # a hole among the first bars: no step, so no gaps
    long = [d for d in range(0, 400) if (T0 + timedelta(days=d)).weekday() < 5]
    hole = long[150]
    found = cleaning.missing_bars(bars([d for d in long if d != hole])).collect()
    assert [r.bar_ts for r in found] == [T0 + timedelta(days=hole)]


def test_gap_lists(spark):
    bars = make(spark, [(m, 10.0, 11.0, 9.0, 10.5) for m in (0, 10, 200)])
    r = cleaning.quality_report(bars, step_seconds=600).first()
    assert (r.missing_total, r.missing_listed) == (18, 10)
    assert r.gaps == [T0 + timedelta(minutes=m) for m in range(20, 120, 10)]
    whole = cleaning.quality_report(make(spark, GOOD), step_seconds=600).first()
    assert whole.gaps == [] and whole.missing_total == 0
    two = bars.unionByName(bars.withColumn("symbol", F.lit("B"))).drop("seq")
    assert sync.sync_report(two, sync.all_pairs(two), 600).first().missing_periods == r.gaps


@pytest.mark.parametrize(("shift", "matched"), [(0, 5), (20, 3)])
def test_join_on_time(spark, shift, matched):
    rows = [(m, 10.0, 11.0, 9.0, 10.5) for m in range(0, 50, 10)]
    bars = make(spark, rows).unionByName(make(spark, rows, "B", T0 + timedelta(minutes=shift))).drop("seq")
    pairs = sync.all_pairs(bars)
    joined = sync.synchronize(bars, pairs).orderBy("pos").collect()
    assert len(joined) == matched and [r.pos for r in joined] == list(range(matched))
    report = sync.sync_report(bars, pairs, 600).first()
    assert (report["matched"], report["a_unmatched"], report["b_unmatched"]) == (matched, 5 - matched, 5 - matched)
    assert sync.unmatched(bars, pairs).count() == 2 * (5 - matched)


def test_empty_tables(spark):
    none = make(spark, [])
    assert cleaning.clean_bars(none).count() == 0 and cleaning.quality_report(none).count() == 0
    assert sync.synchronize(none, sync.all_pairs(none)).count() == 0


def test_unknown_timeframe(spark):
    with pytest.raises(ValueError, match="M7"):
        src.resample(make(spark, GOOD), "M7", ["bar_ts"])


def test_read_and_write(spark, tmp_path):
    raw = spark.createDataFrame([("A", 1_700_000_000 + k // 2 * 60, 1.0 + k, 2.0, 0.5, 1.5, 1, 1, 1) for k in range(6)], src.BAR_SCHEMA)
    raw.write.parquet(f"{tmp_path}/raw")
    bars = src.read_bars(spark, f"{tmp_path}/raw")
    assert [r.open for r in bars.orderBy("bar_ts").collect()] == [1.0, 3.0, 5.0]
    src.write_dataset(bars, f"{tmp_path}/out", partition_by=["symbol"])
    assert spark.read.parquet(f"{tmp_path}/out/parquet").count() == spark.read.option("header", True).csv(f"{tmp_path}/out/csv").count() == 3
    assert src.latest_n_bars(bars, 2).count() == 2
    assert src.require_min_bars(bars, 4, ["symbol"]).count() == 0
