"""Reading bars and ticks, resampling, choosing symbols, and writing results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_SCHEMA = "symbol string, time long, open double, high double, low double, close double, tick_volume long, spread int, real_volume long"
PRICES = ["open", "high", "low", "close"]
MINUTES = {"M1": 1, "M2": 2, "M3": 3, "M4": 4, "M5": 5, "M6": 6, "M10": 10, "M12": 12, "M15": 15, "M20": 20, "M30": 30, "H1": 60, "H2": 120, "H3": 180, "H4": 240, "H6": 360, "H8": 480, "H12": 720}
CALENDAR = {"D1": "day", "W1": "week", "MN1": "month"}


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def from_epoch(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """``time`` in epoch seconds becomes ``bar_ts``; one row per symbol and time, the first in arrival order."""
    rows = df.withColumn("bar_ts", F.timestamp_seconds("time").cast("timestamp_ntz")).drop("time")
    return first_per(rows, ["symbol", "bar_ts"], list(order) or [F.col(c) for c in rows.columns if c not in ("symbol", "bar_ts")])


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars from Parquet or CSV files with the declared schema."""
    reader = spark.read.schema(BAR_SCHEMA)
    return from_epoch(reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path))


def latest_n_bars(bars: DataFrame, n: int = 50_000, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The newest n bars of each key.

    Counts by day say on which day the n-th bar lies: later days are kept whole, and only the bars of that day are sorted.
    """
    keys = list(keys)
    rows = bars.withColumn("_day", F.date_trunc("day", "bar_ts"))
    newer = Window.partitionBy(*keys).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*keys, "_day").agg(F.count("*").alias("_n")).withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    # the day of the n-th bar, one row for each key
    edge = days.filter(F.col("_newer") < n).groupBy(*keys).agg(F.min("_day").alias("_edge"), F.max("_newer").alias("_newer"))
    rows = rows.join(edge, keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("bar_ts")))
    last = rows.filter("_day = _edge").withColumn("_place", place).filter(F.col("_newer") + F.col("_place") <= n)
    return rows.filter("_day > _edge").select(bars.columns).unionByName(last.select(bars.columns))


def dedupe_ticks(ticks: DataFrame, order: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One tick per second: times are cut to the second and the first tick kept."""
    rows = ticks.withColumn("second", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return first_per(rows, [*keys, "second"], list(order)).drop("ts").withColumnRenamed("second", "ts")


def bar_start(ts: Column, timeframe: str) -> Column:
    """The start of the bar that holds a time; weeks start on Monday."""
    if timeframe in MINUTES:
        return F.window(ts, f"{MINUTES[timeframe]} minutes")["start"].cast("timestamp_ntz")
    if timeframe in CALENDAR:
        return F.date_trunc(CALENDAR[timeframe], ts).cast("timestamp_ntz")
    raise ValueError(f"unknown timeframe {timeframe!r}")


def resample(ticks: DataFrame, timeframe: str, order: Sequence[str], price: str = "price", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars from ticks: first, highest, lowest and last price of each bar, partly aggregated before the shuffle."""
    at = F.struct(*order)
    p = F.col(price)
    rows = ticks.withColumn("bar_ts", bar_start(F.col("ts"), timeframe))
    out = rows.groupBy(*keys, "bar_ts").agg(F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), F.count("*").alias("tick_volume"))
    return out.withColumn("spread", (1 + F.col("tick_volume") % 4).cast("int")).withColumn("real_volume", F.col("tick_volume"))


def coarser(bars: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars of a longer timeframe from bars: first open, last close, extremes, summed volumes, largest spread."""
    rows = bars.withColumn("_start", bar_start(F.col("bar_ts"), timeframe))
    return (
        rows.groupBy(*keys, F.col("_start"))
        .agg(F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_ts").alias("close"), F.sum("tick_volume").alias("tick_volume"), F.max("spread").alias("spread"), F.sum("real_volume").alias("real_volume"))
        .withColumnRenamed("_start", "bar_ts")
    )


def resolve_symbols(instruments: DataFrame, candidates: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Maps each asset to one listed symbol.

    ``instruments``: ``symbol``, ``listing``; ``candidates``: ``asset``,
    ``candidate``, ``priority``. By candidate in order of priority, an exact match
    goes before one that ignores case; only if no candidate has either, a name that
    contains the other counts, in listing order. Of listings that differ in case
    only the last wins.
    """
    if overrides:
        first = instruments.sparkSession.createDataFrame([(a, c, -1) for a, c in overrides.items()], "asset string, candidate string, priority int")
        candidates = candidates.select("asset", "candidate", F.col("priority").cast("int")).unionByName(first)
    s, c = F.lower("symbol"), F.lower("candidate")
    kind = F.when(F.col("symbol") == F.col("candidate"), 0).when(s == c, 1).when(s.contains(c) | c.contains(s), 2)
    # both tables are short lists of names
    matches = instruments.join(F.broadcast(candidates), kind.isNotNull()).withColumn("kind", kind)
    listing = F.when(F.col("kind") == 1, -F.col("listing")).otherwise(F.col("listing"))
    best = Window.partitionBy("asset").orderBy(F.when(F.col("kind") < 2, 0).otherwise(1), "priority", "kind", listing)
    return matches.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("asset", "symbol")


def write_dataset(df: DataFrame, directory: str, csv: bool = True, parquet: bool = True, partition_by: Sequence[str] = ("pair_id",)) -> None:
    """The wide table as Parquet and CSV, one folder for each pair."""
    for fmt, wanted in (("parquet", parquet), ("csv", csv)):
        if wanted:
            writer = df.write.mode("overwrite").partitionBy(*partition_by)
            (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{directory}/{fmt}")


def run_metadata(df: DataFrame, params: Mapping[str, str], run_at: str, requested: int, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """One row for each key: run time, bars asked for and present, and the parameters as JSON."""
    entries = F.struct(*[F.lit(v).alias(k) for k, v in sorted(params.items())]) if params else F.struct(F.lit(None).alias("none"))
    return df.groupBy(*keys).agg(F.count("*").alias("bars_actual")).select(*keys, F.lit(run_at).alias("run_at"), F.lit(requested).cast("long").alias("bars_requested"), "bars_actual", F.to_json(entries).alias("parameters"))


def require_min_bars(df: DataFrame, n: int = 100, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Only the keys with at least n rows."""
    return df.join(df.groupBy(*keys).count().filter(F.col("count") >= n).drop("count"), list(keys), "left_semi")
