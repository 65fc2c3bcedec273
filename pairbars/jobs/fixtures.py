"""Bars, pairs and scored pair series made from the given tables, which the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbars.functions.rolling import with_pos
from pairbars.functions.work import written
from pairbars.operators import features, ratio, regimes, sync
from pairbars.operators.chunks import in_chunks
from pairbars.sources.bars import resample

TICK_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.col("l_extendedprice").alias("price"), *TICK_ORDER[1:5])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(daily_ticks(spark, sf_dir), "D1", TICK_ORDER)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars as a table, for what reads them more than once."""
    return written(daily(spark, sf_dir))


def intraday_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), "event_id")


def intraday(spark: SparkSession, sf_dir: str, timeframe: str = "M30") -> DataFrame:
    return resample(intraday_ticks(spark, sf_dir), timeframe, ["ts", "event_id"])


def returns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Log returns of both sides."""
    for s in "ab":
        df = features.log_return(df, keys, f"{s}_close", f"{s}_log_return")
    return df


def matched(bars: DataFrame) -> DataFrame:
    """Matched bars of all pairs; ticks become bars once, which are then stored."""
    return sync.synchronize(written(bars))


def pair_bars(bars: DataFrame) -> DataFrame:
    """Matched bars of all pairs, with positions and log returns of both sides."""
    return in_chunks(matched(bars), ["pair_id"], returns, 1, pos="pos")


def daily_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_bars(daily(spark, sf_dir))


def daily_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With hedge ratio, residual and its score, the price ratio and its scores."""
    return scored(stored(spark, sf_dir))


def scored(bars: DataFrame) -> DataFrame:
    """The same of any stored bars: all windows of a pair in one pass over its chunks."""
    return in_chunks(sync.synchronize(bars), ["pair_id"], lambda d, k: ratio.ratio_features(ratio.ratio(ratio.scored(returns(d, k), keys=k)), keys=k), 1 + 200, pos="pos")


def intraday_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With sessions."""
    return regimes.session_label(pair_bars(intraday(spark, sf_dir)))


def intraday_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With sessions and the volatility regime of side a."""
    rows = in_chunks(matched(intraday(spark, sf_dir)), ["pair_id"], lambda d, k: features.volatility_regime(returns(d, k), 20, k, "a_log_return"), 1 + 120, pos="pos")
    return regimes.session_label(rows)


def calendars(spark: SparkSession, sf_dir: str, without: tuple[int, ...] = ()) -> DataFrame:
    """Times of bars on the first, last, and first and last business days of the months and quarters with trades; some taken out by their number."""
    days = daily(spark, sf_dir).select("symbol", F.trunc("bar_ts", "month").alias("first"))
    last = F.last_day("first")
    on = {"MN1": F.col("first"), "ME": last, "BMS": F.date_add("first", F.when(F.weekday("first") > 4, 7 - F.weekday("first")).otherwise(F.lit(0))), "BME": F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0)))}
    on |= {"QS": F.when(F.month("first") % 3 == 1, F.col("first")), "QE": F.when(F.month("first") % 3 == 1, last)}
    cells = F.array(*[F.struct(F.lit(name).alias("name"), day.cast("timestamp_ntz").alias("bar_ts")) for name, day in on.items()])
    rows = days.distinct().select("symbol", F.inline(cells)).filter("bar_ts is not null").select(F.concat_ws("-", "symbol", "name").alias("symbol"), "bar_ts")
    return with_pos(rows, ["symbol"]).filter(~(F.col("pos") + 1).isin(*without)).drop("pos") if without else rows


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with planted faults, and an order of arrival ``seq``."""
    rows = written(with_pos(stored(spark, sf_dir), ["symbol"])).withColumn("n", F.col("pos") + 1)
    rows = rows.select("symbol", "bar_ts", F.when(F.col("n") % 41 == 0, 0.0).otherwise(F.col("open")).alias("open"), F.when(F.col("n") % 37 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low", F.when(F.col("n") % 43 != 0, F.col("close")).alias("close"), "tick_volume", "spread", "real_volume", F.col("n").cast("long").alias("seq"))
    again = rows.filter(F.col("seq") % 47 == 0).withColumn("close", F.col("close") * 1.5).withColumn("seq", F.col("seq") + 1_000_000)
    odd = rows.filter((F.col("symbol") == "AF") & (F.col("seq") % 41 != 0)).withColumn("symbol", F.lit("XX")).withColumn("open", F.when(F.col("seq") == 5, -1.0).otherwise(F.col("open"))).withColumn("low", F.when(F.col("seq") == 5, -1.0).otherwise(F.col("low")))
    return rows.unionByName(again).unionByName(odd)
