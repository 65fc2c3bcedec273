"""Walk-forward validation: windows by position, strategies on slices, parameter choice."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbars.operators.backtest import backtest_metrics

PAIR = ("pair_id",)
SPLITS = ("train", "val", "test")
Strategy = Callable[..., DataFrame]
#: Parameters that strategies compare with values of a row, so that they may be columns.
BY_ROW = ("entry", "exit", "threshold")


def walkforward_windows(df: DataFrame, train: float = 0.6, val: float = 0.2, step: float = 0.1, min_train: int = 1000, keys: Sequence[str] = PAIR) -> DataFrame:
    """``window`` and the first and last position of each of its slices; sizes are cut to whole bars."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    size = lambda p: F.floor(F.col("n") * p)
    short = size(train) < min_train
    n = n.select(*keys, "n", F.when(short, F.lit(min_train)).otherwise(size(train)).alias("t"), F.when(short, F.lit(int(min_train * val / train))).otherwise(size(val)).alias("v"), F.when(short, F.lit(int(min_train * step / train))).otherwise(size(step)).alias("s"))
    room = F.col("n") - F.col("t") - F.col("v") - F.col("s")
    rows = n.filter((room >= 0) & (F.col("s") > 0)).withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(room / F.col("s")))))
    start = F.col("window") * F.col("s")
    edges = {"train": (start, start + F.col("t")), "val": (start + F.col("t"), start + F.col("t") + F.col("v")), "test": (start + F.col("t") + F.col("v"), start + F.col("t") + F.col("v") + F.col("s"))}
    return rows.select(*keys, "window", *[x.cast("long").alias(c) for name, (a, b) in edges.items() for x, c in ((a, f"{name}_from"), (b - 1, f"{name}_to"))])


def window_times(df: DataFrame, windows: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """The times of the windows' first and last bars."""
    long = windows.select(*keys, "window", F.inline(F.array(*[F.struct(F.lit(f"{s}_{e}").alias("edge"), F.col(f"{s}_{e}").alias("pos")) for s in SPLITS for e in ("from", "to")])))
    return long.join(df.select(*keys, F.col("pos").cast("long").alias("pos"), "bar_ts"), [*keys, "pos"]).groupBy(*keys, "window").pivot("edge", [f"{s}_{e}" for s in SPLITS for e in ("from", "to")]).agg(F.first("bar_ts"))


def walkforward_slices(df: DataFrame, windows: DataFrame, keys: Sequence[str] = PAIR, least: Mapping[str, int] | None = None) -> DataFrame:
    """The bars of each (window, split), positions anew; windows with a slice too short are left out.

    The windows of a key have equal sizes and steps, so a bar's windows follow from its position by division, and
    no bar meets a window that doesn't hold it.
    """
    least = least or {"train": 100, "val": 50, "test": 50}
    ok = windows
    for s, n in least.items():
        ok = ok.filter(F.col(f"{s}_to") - F.col(f"{s}_from") + 1 >= n)
    first, last = F.min("window"), F.max("window")
    step = F.coalesce(F.try_divide(F.max("train_from") - F.min("train_from"), last - first), F.lit(1)).cast("long")
    # one row for each key: the first window's slices, and how the others follow
    plan = ok.groupBy(*keys).agg(first.alias("_first"), last.alias("_last"), step.alias("_step"), *[F.min(f"{s}_{e}").alias(f"_{s}_{e}") for s in SPLITS for e in ("from", "to")])
    low = lambda s: F.col("_first") + F.greatest(F.ceil((F.col("pos") - F.col(f"_{s}_to")) / F.col("_step")), F.lit(0))
    high = lambda s: F.least(F.col("_first") + F.floor((F.col("pos") - F.col(f"_{s}_from")) / F.col("_step")), F.col("_last"))
    start = lambda s, k: F.col(f"_{s}_from") + (k - F.col("_first")) * F.col("_step")
    hits = lambda s: F.when(high(s) >= low(s), F.transform(F.sequence(low(s), high(s)), lambda k: F.struct(k.alias("window"), F.lit(s).alias("split"), (F.col("pos") - start(s, k)).cast("int").alias("_at")))).otherwise(F.array())
    rows = df.join(plan, list(keys)).withColumn("_hit", F.explode(F.concat(*[hits(s) for s in SPLITS])))
    return rows.select(*[c for c in df.columns if c != "pos"], "_hit.window", "_hit.split", F.col("_hit._at").alias("pos"))


def _combos(grid: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def _simulated(bars: DataFrame, strategy: Strategy, grid: Mapping[str, Sequence[float]], inside: Sequence[str], params: Mapping[str, object], by_row: Sequence[str], chosen: DataFrame | None = None) -> DataFrame:
    """Metrics of each combination on the bars, or only of the chosen one of each key.

    Parameters in ``by_row`` become columns of rows repeated for each of their values,
    under one plan; each value of the others, which set the frames of windows, is a plan.
    """
    numbered = list(enumerate(_combos(grid)))
    framed = {tuple((k, v) for k, v in combo.items() if k not in by_row) for _, combo in numbered}
    keys, out = [*inside, "combo"], None
    for fixed in sorted(framed):
        own = [(i, combo) for i, combo in numbered if all(combo[k] == v for k, v in fixed)]
        names = [k for k in grid if k in by_row]
        cells = F.array(*[F.struct(F.lit(i).alias("combo"), *[F.lit(float(combo[k])).alias(f"_{k}") for k in names]) for i, combo in own])
        rows = bars.select("*", F.inline(cells))
        if chosen is not None:
            rows = rows.join(chosen, chosen.columns, "left_semi")
        m = backtest_metrics(strategy(rows, keys=keys, **{**params, **dict(fixed), **{k: F.col(f"_{k}") for k in names}}), rows, keys)
        out = m if out is None else out.unionByName(m)
    return out


def parameter_search(slices: DataFrame, strategy: Strategy, grid: Mapping[str, Sequence[float]], keys: Sequence[str] = PAIR, by_row: Sequence[str] = BY_ROW, **params: object) -> DataFrame:
    """The combination with the best validation score, the first on ties: ``combo``, ``score``."""
    m = _simulated(slices.filter("split = 'val'"), strategy, grid, [*keys, "window", "split"], params, by_row)
    scored = m.select(*keys, "window", "combo", (F.col("net_return") / F.greatest(F.abs("max_drawdown"), F.lit(1e-6))).alias("score"))
    best = Window.partitionBy(*keys, "window").orderBy(F.desc("score"), "combo")
    return scored.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def run_walkforward(slices: DataFrame, strategy: Strategy, grid: Mapping[str, Sequence[float]] | None = None, keys: Sequence[str] = PAIR, by_row: Sequence[str] = BY_ROW, **params: object) -> DataFrame:
    """Metrics of each (window, split), with the parameters chosen on validation if there is a grid."""
    inside = [*keys, "window", "split"]
    if not grid:
        return backtest_metrics(strategy(slices, keys=inside, **params), slices, inside)
    best = parameter_search(slices, strategy, grid, keys, by_row, **params)
    return _simulated(slices, strategy, grid, inside, params, by_row, best.select(*keys, "window", "combo"))


def walkforward_summary(metrics: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Over the test slices: mean and deviation of the net result, mean ratios, and the share of windows that gain."""
    gain = (F.col("net_return") > 0).cast("int")
    return metrics.filter("split = 'test'").groupBy(*keys).agg(
        F.count("*").alias("n_windows"), F.avg("net_return").alias("mean_net"), F.stddev_pop("net_return").alias("std_net"), F.avg("sharpe").alias("mean_sharpe"), F.avg("profit_factor").alias("mean_profit_factor"),
        F.avg("win_rate").alias("mean_win_rate"), F.avg("max_drawdown").alias("mean_drawdown"), F.sum(gain).alias("n_profitable"), (F.avg(gain.cast("double")) * 100).alias("pct_profitable"),
    )
