"""Strategy simulations as tables of trades, and their metrics."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbars.functions.quantiles import with_quantiles
from pairbars.functions.rolling import by, safe_div
from pairbars.functions.work import written
from pairbars.operators.chunks import CHUNK, in_chunks
from pairbars.operators.select import greedy_select
from pairbars.operators.spread import transaction_cost

PAIR = ("pair_id",)
YEAR = math.sqrt(252 * 24 * 6)


def lead_lag_trades(df: DataFrame, leader: str = "a", follower: str = "b", lag: int | str = 1, threshold: float | Column = 0.0005, hold: int = 6, commission: float = 0.0, slippage: float = 0.0, use_spread: bool = True, max_lag: int = 12, keys: Sequence[str] = PAIR, pos: str | None = None) -> DataFrame:
    """Follows large moves of the leader after ``lag`` bars (a number, or a column of at most ``max_lag``); trades may overlap."""
    ret = F.col(f"{leader}_log_return")
    close, spread = f"{follower}_close", f"{follower}_spread"

    def moves(d: DataFrame, own: list[str]) -> DataFrame:
        w = by(own)
        if isinstance(lag, str):
            move = F.coalesce(*[F.when(F.col(lag) == k, F.lag(ret, k).over(w)) for k in range(max_lag + 1)])
        else:
            move = F.lag(ret, lag).over(w)
        return d.select("*", F.lit(threshold).alias("_level"), F.lead("bar_ts", hold).over(w).alias("exit_ts"), move.alias("_move"), F.lead(close, hold).over(w).alias("exit_price"), F.lead(spread, hold).over(w).alias("_t"))

    rows = in_chunks(df, keys, moves, max_lag if isinstance(lag, str) else lag, hold, pos=pos)
    rows = rows.select(*keys, "pos", "_level", F.col("bar_ts").alias("entry_ts"), "exit_ts", "_move", F.col(close).alias("entry_price"), "exit_price", F.col(spread).alias("_s"), "_t")
    rows = rows.filter((F.abs("_move") > F.col("_level")) & F.col("exit_ts").isNotNull())
    return _priced(rows.withColumn("side", F.when(F.col("_move") > 0, "LONG").otherwise("SHORT")).withColumn("holding_bars", F.lit(hold)), keys, commission, slippage, use_spread)


def _priced(rows: DataFrame, keys: Sequence[str], commission: float, slippage: float, use_spread: bool) -> DataFrame:
    change = F.col("exit_price") - F.col("entry_price")
    gross = F.when(F.col("side") == "LONG", change).otherwise(-change)
    cost = transaction_cost(F.col("_s"), F.col("_t"), commission, slippage) if use_spread else F.lit(0.0)
    return rows.select(*keys, "pos", "side", "entry_ts", "exit_ts", "entry_price", "exit_price", gross.alias("gross_pnl"), (gross - cost).alias("net_pnl"), F.col("holding_bars").cast("long").alias("holding_bars"))


def mean_reversion_trades(df: DataFrame, entry: float | Column = 2.0, exit: float | Column = 0.5, max_hold: int = 24, z: str = "residual_zscore", commission: float = 0.0, slippage: float = 0.0, use_spread: bool = True, keys: Sequence[str] = PAIR, pos: str | None = None) -> DataFrame:
    """Trades side b against a large score, one position at a time; one still open at the end is dropped.

    The first bar within ``max_hold`` that passes the level, by side, is a running minimum over bars that
    begin with their position; a bar without one leaves at its limit. Then the candidates that don't overlap
    are chosen in order.
    """
    score, bar = F.col(z), F.struct("pos", "bar_ts", "b_close", "b_spread")

    def exits(d: DataFrame, own: list[str]) -> DataFrame:
        ahead = by(own).rowsBetween(1, max_hold)
        leave = lambda done: F.coalesce(F.min(F.when(done, bar)).over(ahead), F.lead(bar, max_hold).over(by(own)))
        return d.withColumn("_short", leave(score <= exit)).withColumn("_long", leave(score >= -exit))

    rows = in_chunks(df, keys, exits, ahead=max_hold, pos=pos).filter(F.abs(z) >= entry)
    rows = rows.withColumn("side", F.when(score > 0, "SHORT").otherwise("LONG")).withColumn("_at", F.when(score > 0, F.col("_short")).otherwise(F.col("_long")))
    rows = rows.select(*keys, "pos", "side", F.col("bar_ts").alias("entry_ts"), F.col("_at.bar_ts").alias("exit_ts"), F.col("b_close").alias("entry_price"), F.col("_at.b_close").alias("exit_price"), F.col("b_spread").alias("_s"), F.col("_at.b_spread").alias("_t"), F.col("_at.pos").alias("_exit"))
    chosen = greedy_select(rows, keys, max_hold, "pos", "_exit").filter("_exit is not null")
    return _priced(chosen.withColumn("holding_bars", F.col("_exit") - F.col("pos")), keys, commission, slippage, use_spread)


def trade_gate(df: DataFrame, best: DataFrame, direction: str, least: float = 0.1, keys: Sequence[str] = PAIR) -> DataFrame:
    """Only the keys whose best correlation in a direction is over a level."""
    return df.join(best.filter((F.col("direction") == direction) & (F.col("correlation") > least)).select(*keys), list(keys), "left_semi")


def _running(rows: DataFrame, keys: Sequence[str], value: Column, out: str, total: Callable[[Column | str], Column], both: Callable[[Column, Column], Column], chunk: int) -> DataFrame:
    """A running ``total`` in order of ``pos``: within chunks of positions, and with ``both`` joined to that of all chunks before."""
    rows = rows.withColumn("_part", F.floor(F.col("pos") / chunk)).withColumn("_value", value)
    before = by(keys, "_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, "_part").agg(total("_value").alias("_whole"))
    parts = parts.select(*keys, "_part", total("_whole").over(before).alias("_before"))
    here = total("_value").over(by([*keys, "_part"], "pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(parts, [*keys, "_part"]).withColumn(out, here)
    return rows.withColumn(out, F.when(F.col("_before").isNull(), F.col(out)).otherwise(both(F.col(out), F.col("_before")))).drop("_part", "_value", "_before")


def equity_curve(trades: DataFrame, keys: Sequence[str] = PAIR, chunk: int = CHUNK) -> DataFrame:
    """Running net result by trade order, its running maximum, and the drawdown from it."""
    rows = _running(trades, keys, F.col("net_pnl"), "equity", F.sum, lambda a, b: a + b, chunk)
    rows = _running(rows, keys, F.col("equity"), "peak", F.max, F.greatest, chunk)
    return rows.select(*trades.columns, "equity", "peak", (F.col("equity") - F.col("peak")).alias("drawdown"))


def max_drawdown(trades: DataFrame, keys: Sequence[str] = PAIR, chunk: int = CHUNK) -> DataFrame:
    return equity_curve(trades, keys, chunk).groupBy(*keys).agg(F.abs(F.min("drawdown")).alias("max_drawdown"))


def max_losing_run(trades: DataFrame, keys: Sequence[str] = PAIR, chunk: int = CHUNK) -> DataFrame:
    """The longest run of trades that don't win; runs are numbered by the wins before them."""
    rows = _running(trades, keys, (F.col("net_pnl") > 0).cast("long"), "_run", F.sum, lambda a, b: a + b, chunk)
    runs = rows.groupBy(*keys, "_run").agg(F.sum((F.col("net_pnl") <= 0).cast("long")).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("max_losing_run"))


def risk_ratios(trades: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Sharpe and Sortino; 0 without deviation or without losses, infinite (null for a zero mean) with equal losses."""
    x, down = F.col("net_pnl"), F.when(F.col("net_pnl") < 0, F.col("net_pnl"))
    s = trades.groupBy(*keys).agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.count(down).alias("n"), F.stddev_pop(down).alias("d"))
    infinite = F.when(F.col("m") > 0, float("inf")).when(F.col("m") < 0, float("-inf"))
    sortino = F.when(F.col("n") == 0, 0.0).when(F.col("d") == 0, infinite).otherwise(safe_div(F.col("m"), F.col("d")) * YEAR)
    return s.select(*keys, F.when(F.col("s") > 0, safe_div(F.col("m"), F.col("s")) * YEAR).otherwise(0.0).alias("sharpe"), sortino.alias("sortino"))


def backtest_metrics(trades: DataFrame, bars: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """One row of metrics for each key of ``bars``; zeros where it has no trades."""
    keys, trades = list(keys), written(trades)  # trades, few beside the bars, are summed in several ways
    span = bars.groupBy(*keys).agg(((F.unix_timestamp(F.max("bar_ts").cast("timestamp")) - F.unix_timestamp(F.min("bar_ts").cast("timestamp"))) / 86400).alias("_days"))
    x, cost = F.col("net_pnl"), F.col("gross_pnl") - F.col("net_pnl")
    win, lose = F.when(x > 0, x), F.when(x <= 0, x)
    aggs = {
        "total_trades": F.count("*"), "win_rate": F.avg((x > 0).cast("double")) * 100, "avg_return": F.avg(x), "avg_winner": F.avg(win), "avg_loser": F.avg(lose),
        "_won": F.coalesce(F.sum(win), F.lit(0.0)), "_lost": F.coalesce(F.sum(lose), F.lit(0.0)), "expectancy": F.avg(x), "avg_holding_bars": F.avg("holding_bars"), "best_trade": F.max(x), "worst_trade": F.min(x),
        "gross_return": F.sum("gross_pnl"), "total_costs": F.sum(cost), "net_return": F.sum(x),
    }
    out = with_quantiles(trades.groupBy(*keys).agg(*[f.alias(n) for n, f in aggs.items()]), trades, keys, "net_pnl", {"median_return": 0.5})
    out = out.withColumn("profit_factor", F.when(F.col("_lost") == 0, float("inf")).otherwise(F.abs(safe_div(F.col("_won"), F.col("_lost"))))).drop("_won", "_lost")
    for part in (max_drawdown(trades, keys), max_losing_run(trades, keys), risk_ratios(trades, keys)):
        out = out.join(part, keys)
    out = span.join(out, keys, "left").withColumn("trades_per_day", F.when(F.col("_days") > 0, F.col("total_trades") / F.col("_days"))).withColumn("cost_to_edge", safe_div(F.col("total_costs"), F.col("gross_return"))).drop("_days")
    none = F.col("total_trades").isNull()
    rest = [c for c in out.columns if c not in keys]
    filled = {c: F.when(none, F.lit(0)) if c in ("total_trades", "max_losing_run") else F.when(none, F.lit(0.0)) for c in rest}
    may_be_null = {"sortino"}
    return out.select(*keys, *[filled[c].otherwise(F.col(c) if c in may_be_null else F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType))).alias(c) for c in rest])
