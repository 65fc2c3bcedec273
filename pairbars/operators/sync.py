"""Joining two bar series of each pair on time.

Bars meet by time: one shuffle brings the bars of a time together as a list in order
of symbol, at most one for each instrument, and the pairs are made from that list. So what is
shuffled before pairing is each bar once, whatever the number of pairs. Bars without a symbol or a
time meet no other and count nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbars.functions.rolling import with_pos
from pairbars.operators.cleaning import gap_list, missing_bars

#: A list of pairs of up to so many rows is sent to every executor: two names and an id each, some ten megabytes.
PAIRS_SENT = 100_000


def all_pairs(bars: DataFrame) -> DataFrame:
    """Every two symbols once, in order of name; as many rows as there are pairs to study."""
    a, b = (bars.select(F.col("symbol").alias(f"{s}_symbol")).distinct() for s in "ab")
    return a.join(b, F.col("a_symbol") < F.col("b_symbol")).select(_pair_id(F.col("a_symbol"), F.col("b_symbol")), "a_symbol", "b_symbol")


def _pair_id(a: Column, b: Column) -> Column:
    return F.concat_ws("/", a, b).alias("pair_id")


def _by_time(bars: DataFrame) -> DataFrame:
    """``bar_ts`` and ``_bars``, its bars in order of symbol."""
    bar = F.struct("symbol", *[c for c in bars.columns if c not in ("symbol", "bar_ts")])
    return bars.filter("symbol is not null and bar_ts is not null").groupBy("bar_ts").agg(F.array_sort(F.collect_list(bar)).alias("_bars"))


def _pairing(bars: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """``pair_id``, ``bar_ts`` and the bars ``_a`` and ``_b`` of equal times."""
    each = _by_time(bars).select("bar_ts", "_bars", F.posexplode("_bars").alias("_i", "_a"))
    if pairs is None:
        later = F.filter(F.slice("_bars", F.col("_i") + 2, F.size("_bars")), lambda b: b["symbol"] > F.col("_a.symbol"))
        rows = each.select("bar_ts", "_a", F.explode(later).alias("_b"))
        return rows.select(_pair_id(F.col("_a.symbol"), F.col("_b.symbol")), "bar_ts", "_a", "_b")
    if pairs.limit(PAIRS_SENT + 1).count() <= PAIRS_SENT:
        partners = pairs.groupBy(F.col("a_symbol").alias("_symbol")).agg(F.collect_list(F.struct("pair_id", "b_symbol")).alias("_partners"))
        rows = each.withColumn("_symbol", F.col("_a.symbol")).join(F.broadcast(partners), "_symbol").select("bar_ts", "_bars", "_a", F.explode("_partners").alias("_p"))
        return rows.select("_p.pair_id", "bar_ts", "_a", F.explode(F.filter("_bars", lambda b: b["symbol"] == F.col("_p.b_symbol"))).alias("_b"))
    # a longer list of pairs than can be sent: the bars of either side are copied for each pair and joined
    bar = F.struct("symbol", *[c for c in bars.columns if c not in ("symbol", "bar_ts")])
    a, b = (bars.select("symbol", "bar_ts", bar.alias(f"_{s}")).join(pairs.select("pair_id", F.col(f"{s}_symbol").alias("symbol")), "symbol").drop("symbol") for s in "ab")
    return a.join(b, ["pair_id", "bar_ts"])


def synchronize(bars: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Bars of both sides at equal times, with their position in the pair; of all pairs, or of those given."""
    cells = [F.col(f"_{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in bars.columns if c not in ("symbol", "bar_ts")]
    return with_pos(_pairing(bars, pairs).select("pair_id", "bar_ts", *cells), ["pair_id"])


def unmatched(bars: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Times of one side only: ``pair_id``, ``side``, ``bar_ts``."""
    times = bars.filter("symbol is not null and bar_ts is not null").select("symbol", "bar_ts")
    if pairs is None:
        # the names of all instruments, one list
        names = times.agg(F.collect_set("symbol").alias("names")).scalar()
        rows = times.groupBy("bar_ts").agg(F.collect_set("symbol").alias("_here")).withColumn("_gone", F.array_except(names, F.col("_here")))
        rows = rows.withColumn("_x", F.explode("_here")).withColumn("_y", F.explode("_gone"))
        return rows.select(_pair_id(F.least("_x", "_y"), F.greatest("_x", "_y")), "bar_ts", F.when(F.col("_x") < F.col("_y"), "a").otherwise("b").alias("side"))
    a, b = (times.join(pairs.select("pair_id", F.col(f"{s}_symbol").alias("symbol")), "symbol").select("pair_id", "bar_ts") for s in "ab")
    on = ["pair_id", "bar_ts"]
    return a.join(b, on, "left_anti").withColumn("side", F.lit("a")).unionByName(b.join(a, on, "left_anti").withColumn("side", F.lit("b")))


def sync_report(bars: DataFrame, pairs: DataFrame | None = None, step_seconds: int | None = None, listed: int = 10) -> DataFrame:
    """Bars of each side, matched, unmatched, and gaps of the joined series, the first ten in ``missing_periods``."""
    times = bars.filter("symbol is not null and bar_ts is not null").select("symbol", "bar_ts")
    matched = _pairing(times, pairs).select("pair_id", "bar_ts")
    sizes = times.groupBy("symbol").agg(F.count("*").alias("n"))
    out = all_pairs(sizes) if pairs is None else pairs
    for s in "ab":
        out = out.join(sizes.select(F.col("symbol").alias(f"{s}_symbol"), F.col("n").alias(f"{s}_bars")), f"{s}_symbol")
    out = out.join(matched.groupBy("pair_id").agg(F.count("*").alias("matched")), "pair_id", "left").na.fill(0, ["matched"])
    out = out.select("pair_id", "a_bars", "b_bars", "matched", (F.col("a_bars") - F.col("matched")).alias("a_unmatched"), (F.col("b_bars") - F.col("matched")).alias("b_unmatched"))
    gaps = gap_list(missing_bars(matched, step_seconds, ["pair_id"]), ["pair_id"], listed, "missing", "missing_periods")
    out = out.join(gaps, "pair_id", "left").na.fill(0, ["missing"])
    return out.withColumn("missing_periods", F.coalesce("missing_periods", F.array().cast("array<timestamp_ntz>")))
