"""Cleaning of bars and the report on it. Each step sees what the one before left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbars.functions.rolling import by
from pairbars.operators.chunks import in_chunks
from pairbars.sources.bars import PRICES, first_per

SYMBOL = ("symbol",)
DAY = 86_400


def _values(df: DataFrame, keys: Sequence[str], arrival: str) -> list[str]:
    return [c for c in df.columns if c not in (*keys, arrival)]


def _null_cells(df: DataFrame, keys: Sequence[str], arrival: str) -> Column:
    return sum((F.isnull(c).cast("int") for c in _values(df, keys, arrival)), F.lit(0))


def _valid() -> Column:
    inside = lambda c: (F.col(c) >= F.col("low")) & (F.col(c) <= F.col("high"))
    return inside("open") & inside("close") & (F.col("low") <= F.col("high"))


def drop_null_bars(bars: DataFrame) -> DataFrame:
    return bars.dropna("any")


def drop_zero_price(bars: DataFrame, keys: Sequence[str] = SYMBOL, strict: bool = False) -> DataFrame:
    """Keeps only positive prices, but only for keys with a zero price; with ``strict`` always."""
    positive = F.least(*PRICES) > 0
    if strict:
        return bars.filter(positive)
    zero = sum(((F.col(c) == 0).cast("int") for c in PRICES), F.lit(0))
    # one row for each key with a zero; a positive bar stays in either case
    keys = list(keys)
    with_zero = bars.filter(zero > 0).select(*keys).distinct().withColumn("_zero", F.lit(True))
    return bars.join(with_zero, keys, "left").filter(F.col("_zero").isNull() | positive).select(bars.columns)


def drop_invalid_ohlc(bars: DataFrame) -> DataFrame:
    return bars.filter(_valid())


def drop_duplicate_bars(bars: DataFrame, keys: Sequence[str] = SYMBOL, arrival: str = "seq") -> DataFrame:
    """The first row of each time in order of arrival."""
    return first_per(bars, [*keys, "bar_ts"], [arrival])


def clean_bars(bars: DataFrame, keys: Sequence[str] = SYMBOL, arrival: str = "seq", strict: bool = False) -> DataFrame:
    return drop_duplicate_bars(drop_invalid_ohlc(drop_zero_price(drop_null_bars(bars), keys, strict)), keys, arrival).drop(arrival)


def _seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def _month_day(month: Column, anchor: str) -> Column:
    """The day of a month, numbered from year 0, on which a bar of the calendar lies: first, last, or the first or last business day."""
    first = F.make_date(F.call_function("div", month, F.lit(12)).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))
    last = F.last_day(first)
    ahead, back = F.greatest(7 - F.weekday(first), F.lit(0)), F.greatest(F.weekday(last) - 4, F.lit(0))
    return {"end": last, "business_end": F.date_sub(last, back), "start": first, "business_start": F.date_add(first, F.when(ahead < 3, ahead).otherwise(F.lit(0)))}[anchor]


#: Where in a month a bar may lie, in the order in which it is asked.
ANCHORS = ("end", "business_end", "start", "business_start")


def _month(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def infer_frequency(bars: DataFrame, keys: Sequence[str] = SYMBOL, first: int = 100) -> DataFrame:
    """How the first bars of each key follow each other.

    ``step_seconds``, if they are equally far apart, else null; ``weekdays_only`` for a bar on each
    business day, a step of one day that leaves out Saturdays and Sundays, with one weekend at least among the first bars;
    ``months`` and ``anchor`` for bars that many months apart (12 for years, 3 for quarters), at one time of day on the first,
    last, or first or last business day of the month. Fewer than three bars: none. Only the first bars of a key are sorted.
    """
    w, ts = by(keys), F.col("bar_ts")
    head = bars.select(*keys, "bar_ts").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= first)
    day = _seconds(F.date_trunc("day", ts))
    rows = head.withColumn("_dt", _seconds(ts) - _seconds(F.lag("bar_ts").over(w))).withColumn("_dm", _month(ts) - _month(F.lag("bar_ts").over(w))).withColumn("_at", _seconds(ts) - day)
    weekday = F.weekday("bar_ts")
    weekly = (weekday < 5) & F.coalesce(F.col("_dt") == F.when(weekday == 0, 3 * DAY).otherwise(DAY), F.lit(True))
    on = {a: F.bool_and(F.to_date(ts) == _month_day(_month(ts), a)).alias(a) for a in ANCHORS}
    head = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_dt").alias("a"), F.max("_dt").alias("b"), F.bool_and(weekly).alias("weekly"), F.min("_dm").alias("least"), F.max("_dm").alias("most"), (F.min("_at") == F.max("_at")).alias("one_time"), *on.values())
    enough, same = F.col("n") >= 3, F.col("a") == F.col("b")
    anchor = F.coalesce(*[F.when(F.col(a), a) for a in ANCHORS])
    monthly = enough & F.col("one_time") & (F.col("least") == F.col("most")) & (F.col("least") > 0) & anchor.isNotNull()
    step = F.when(enough & same, F.col("a")).when(enough & F.col("weekly"), F.lit(DAY).cast("long"))
    return head.select(
        *keys, F.when(~monthly, step).alias("step_seconds"), (enough & ~same & F.col("weekly") & ~monthly).alias("weekdays_only"),
        F.when(monthly, F.col("least")).cast("int").alias("months"), F.when(monthly, anchor).alias("anchor"),
    )


def missing_bars(bars: DataFrame, step_seconds: int | None = None, keys: Sequence[str] = SYMBOL, first: int = 100) -> DataFrame:
    """Times between first and last bar that have no bar, by the given step or by what ``infer_frequency`` finds. Only gaps are spread out."""
    keys, ts = list(keys), F.col("bar_ts")
    found = bars.select(*keys).distinct().select(*keys, F.lit(step_seconds).cast("long").alias("step_seconds"), F.lit(False).alias("weekdays_only"), F.lit(None).cast("int").alias("months"), F.lit(None).cast("string").alias("anchor")) if step_seconds else infer_frequency(bars, keys, first)
    rows = in_chunks(bars.select(*keys, "bar_ts"), keys, lambda d, own: d.withColumn("_next", F.lead("bar_ts").over(by(own))), ahead=1)
    rows = rows.filter(F.col("_next").isNotNull()).join(found.filter("step_seconds is not null or months is not null"), keys)
    a, b, step = _seconds(ts), _seconds(F.col("_next")), F.col("step_seconds")
    gaps = rows.filter(b - a > step).select(*keys, "weekdays_only", F.explode(F.sequence(a + step, b - 1, step)).alias("_t"))
    gaps = gaps.select(*keys, "weekdays_only", F.timestamp_seconds("_t").cast("timestamp_ntz").alias("bar_ts"))
    gaps = gaps.filter(~F.col("weekdays_only") | (F.weekday("bar_ts") < 5)).drop("weekdays_only")
    if step_seconds:
        return gaps
    here, later = _month(ts), _month(F.col("_next"))
    wide = rows.filter(later - here > F.col("months")).select(*keys, "anchor", (a - _seconds(F.date_trunc("day", ts))).alias("_at"), F.explode(F.sequence(here + F.col("months"), later - 1, F.col("months"))).alias("_m"))
    day = F.coalesce(*[F.when(F.col("anchor") == x, _month_day(F.col("_m"), x)) for x in ANCHORS])
    return gaps.unionByName(wide.select(*keys, F.timestamp_seconds(_seconds(day) + F.col("_at")).cast("timestamp_ntz").alias("bar_ts")))


def gap_list(gaps: DataFrame, keys: Sequence[str], listed: int, total: str, times: str) -> DataFrame:
    """How many times are missing for each key, the first, and the first few as a list; each task keeps only its first few."""
    keys = list(keys)
    counts = gaps.groupBy(*keys).agg(F.count("*").alias(total), F.min("bar_ts").alias("first_missing"))
    few = gaps.withColumn("_n", F.row_number().over(by(keys))).filter(F.col("_n") <= listed).groupBy(*keys).agg(F.sort_array(F.collect_list("bar_ts")).alias(times))
    return counts.join(few, keys)


def quality_report(bars: DataFrame, keys: Sequence[str] = SYMBOL, arrival: str = "seq", step_seconds: int | None = None, listed: int = 10) -> DataFrame:
    """Counts of what each step of ``clean_bars`` finds, and the gaps of the cleaned bars, the first ten in ``gaps``.

    One aggregate by time counts what is wrong, both with and without the prices that
    only go beside a zero; whether the key has a zero then decides which counts.
    """
    keys = list(keys)
    whole = sum((F.isnull(c).cast("int") for c in bars.columns), F.lit(0)) == 0
    zero = whole & (sum(((F.col(c) == 0).cast("int") for c in PRICES), F.lit(0)) > 0)
    positive = whole & (F.least(*PRICES) > 0)
    count = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    times = bars.groupBy(*keys, "bar_ts").agg(
        F.count("*").alias("rows"), F.sum(_null_cells(bars, keys, arrival)).alias("nulls"), count(zero, "zeros"),
        count(whole & ~_valid(), "bad"), count(positive & ~_valid(), "bad_positive"), count(whole & _valid(), "kept"), count(positive & _valid(), "kept_positive"),
    )
    with_zero = times.filter("zeros > 0").select(*keys).distinct().withColumn("_zero", F.lit(True))
    times = times.join(with_zero, keys, "left").withColumn("_bad", F.when(F.col("_zero"), F.col("bad_positive")).otherwise(F.col("bad"))).withColumn("_kept", F.when(F.col("_zero"), F.col("kept_positive")).otherwise(F.col("kept")))
    counts = times.groupBy(*keys).agg(F.sum("rows").alias("total_bars"), F.sum("nulls").alias("null_values"), F.sum("zeros").alias("zero_prices"), F.sum("_bad").alias("invalid_ohlc"), F.sum(F.greatest(F.col("_kept") - 1, F.lit(0))).alias("duplicates"))
    gaps = gap_list(missing_bars(times.filter("_kept > 0").select(*keys, "bar_ts"), step_seconds, keys), keys, listed, "missing_total", "gaps")
    out = counts.join(gaps, keys, "left").na.fill(0, ["missing_total"])
    none = F.array().cast("array<timestamp_ntz>")
    return out.select(*keys, "total_bars", "null_values", "zero_prices", "invalid_ohlc", "duplicates", "missing_total", "first_missing", F.least(F.col("missing_total"), F.lit(listed)).alias("missing_listed"), F.coalesce("gaps", none).alias("gaps"))
