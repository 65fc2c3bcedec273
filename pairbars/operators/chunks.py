"""Chunks of long series with a halo, so that no window needs a whole series in one task."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pairbars.functions.rolling import with_pos

CHUNK = 10_000
#: The key that a chunk's rows have besides those of their series.
PART = "_chunk"


def chunk_with_halo(df: DataFrame, keys: Sequence[str], halo: int, rows: int = CHUNK, ahead: int = 0, pos: str | None = None) -> DataFrame:
    """Copies rows into chunks of each key: ``_chunk``, ``_pos``, and ``_own``, false for rows of the halo.

    A chunk holds its own rows, the ``halo`` rows before and the ``ahead`` rows
    after, so windows that reach no further can run by (keys, _chunk), and one
    long series is spread over many tasks. ``pos`` names a column with the rows' numbers
    in their key, from 0 without a gap; without it they are counted.
    """
    placed = df.withColumn("_pos", F.col(pos)) if pos else with_pos(df, keys, out="_pos")
    first = F.floor(F.greatest(F.col("_pos") - ahead, F.lit(0)) / rows)
    last = F.floor((F.col("_pos") + halo) / rows)
    spread = placed.withColumn(PART, F.explode(F.sequence(first, last)))
    return spread.withColumn("_own", F.floor(F.col("_pos") / rows) == F.col(PART))


def in_chunks(df: DataFrame, keys: Sequence[str], run: Callable[[DataFrame, list[str]], DataFrame], halo: int = 0, ahead: int = 0, rows: int = CHUNK, pos: str | None = None) -> DataFrame:
    """``run(df, keys)`` on chunks in place of whole series, without the rows of the halo.

    ``run`` adds columns by windows of the keys it is given, which reach at most ``halo``
    rows back and ``ahead`` rows on, and keeps all rows. Several operators in one ``run`` share one
    shuffle; their reaches add up.
    """
    spread = chunk_with_halo(df, keys, halo, rows, ahead, pos)
    return run(spread, [*keys, PART]).filter("_own").drop(PART, "_own", "_pos")


def chunked(halo: Callable[[dict], int] = lambda a: 0, ahead: Callable[[dict], int] = lambda a: 0) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Makes an operator (df, ..., keys) run in chunks; the reach follows from its arguments.

    The operator then also takes ``pos`` and ``rows``, see ``chunk_with_halo``. Called on rows that are in chunks
    already, it runs as it is.
    """

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(f)

        @functools.wraps(f)
        def run(df: DataFrame, *args: object, pos: str | None = None, rows: int = CHUNK, **named: object) -> DataFrame:
            bound = signature.bind(df, *args, **named)
            bound.apply_defaults()
            given = dict(bound.arguments)
            keys = list(given["keys"])
            if PART in keys:
                return f(**given)
            return in_chunks(df, keys, lambda d, k: f(**{**given, "df": d, "keys": k}), halo(given), ahead(given), rows, pos)

        return run

    return wrap


def _windows(values: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(values, n)


def _percent_rank(x: np.ndarray, n: int) -> np.ndarray:
    w, now = _windows(x, n), x[n - 1 :, None]
    out = ((w < now).sum(1) + ((w == now).sum(1) + 1) / 2) / n
    return np.where(np.isnan(w).any(1), np.nan, out)


def _share_at_most(x: np.ndarray, n: int) -> np.ndarray:
    w = _windows(x, n)
    return np.where(np.isnan(w).any(1), np.nan, (w <= x[n - 1 :, None]).mean(1) * 100)


def _ranks(w: np.ndarray) -> np.ndarray:
    """Average ranks in each row."""
    order = np.argsort(w, axis=1, kind="stable")
    ordered = np.take_along_axis(w, order, 1)
    n = w.shape[1]
    new = np.concatenate([np.ones((len(w), 1), bool), ordered[:, 1:] != ordered[:, :-1]], 1)
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(new, place, 0), axis=1)
    end = np.concatenate([new[:, 1:], np.ones((len(w), 1), bool)], 1)
    last = np.minimum.accumulate(np.where(end, place, n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(w.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 1)
    return out


def _spearman(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    a, b = _windows(x, n), _windows(y, n)
    bad = np.isnan(a).any(1) | np.isnan(b).any(1)
    ra, rb = (_ranks(np.nan_to_num(v)) for v in (a, b))
    ra, rb = ra - ra.mean(1, keepdims=True), rb - rb.mean(1, keepdims=True)
    spread = np.sqrt((ra**2).sum(1) * (rb**2).sum(1))
    return np.where(bad | (spread == 0), np.nan, (ra * rb).sum(1) / np.where(spread == 0, 1, spread))


@chunked(lambda a: a["n"] - 1)
def rolling_apply(df: DataFrame, keys: Sequence[str], n: int, wanted: Mapping[str, tuple[str, ...]], block: int = 2000) -> DataFrame:
    """Adds rolling values that need all values of a window.

    ``wanted``: new column to (function, columns...); functions are
    ``percent_rank``, ``share_at_most`` and ``spearman``. A window with a null
    gives null. Chunks run in blocks; the other columns go along, so nothing is joined back.
    """
    functions = {"percent_rank": _percent_rank, "share_at_most": _share_at_most, "spearman": _spearman}
    kept = [c for c in df.columns if c not in wanted]
    df = df.select(kept)
    schema = StructType([*df.schema.fields, *[StructField(c, DoubleType()) for c in wanted]])

    def run(part: pa.Table) -> pa.Table:
        out = part.sort_by("_pos")
        size = out.num_rows
        found = {}
        for name, (function, *columns) in wanted.items():
            value = np.full(size, np.nan)
            series = [out[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
            for s in range(n - 1, size, block):
                e = min(s + block, size)
                value[s:e] = functions[function](*[x[s - n + 1 : e] for x in series], n)
            found[name] = pa.array(value, from_pandas=True)
        for name, value in found.items():
            out = out.append_column(name, value)
        return out

    return df.groupBy(*keys).applyInArrow(run, schema)
