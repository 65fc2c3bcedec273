"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into quantile bins. Cyclic boosting visits the
features in turn; each visit fits a shallow tree over the bins of one feature to
the gradients and adds it to that feature's lookup table. Then the pairs that
explain most of what is left get tables of two dimensions in the same way. A
score is a sum of table entries, looked up for a whole batch at once.

Edge cases: null and empty texts have all features zero and get a score like any
other; with no labelled rows, or one class only, every score is that of the
prior; labels of unknown ids do nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbars.llm.labelled import held_out, one_of_each, training_rows
from pairbars.llm.work import chunks, with_text

FOLDS, FOLD = 5, 0
#: Rows that the model learns from at most.
MAX_ROWS = 12_000
THRESHOLD = 0.3
FEATURES = [
    "words", "word_chars", "upper", "digits", "marks", "symbols", "exclaims", "bars", "spaces", "wide",
    "distinct", "twice", "lines", "line_copies", "longest_word", "short_words", "five_copies", "ends",
]
_CLASSES = ["upper", "digits", "marks", "symbols", "exclaims", "bars", "spaces", "wide"]


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.uint8)
    for chars, k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), (b"0123456789", 1), (b".,;:?'\"()-", 2), (b"#*$%&<>", 3), (b"!", 4), (b"|", 5), (b" \t\n\r\x0b\x0c", 6)):
        table[list(chars)] = k
    table[128:] = 7
    return table


_TABLE = _class_table()


def features(texts: list[str]) -> np.ndarray:
    """A row of numbers for each whole text."""
    out = np.zeros((len(texts), len(FEATURES)))
    first = FEATURES.index("upper")
    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "replace")
        counts = np.bincount(_TABLE[np.frombuffer(data, np.uint8)], minlength=len(_CLASSES) + 1)
        out[i, first : first + len(_CLASSES)] = counts[: len(_CLASSES)] / len(data)
        words = data.split()
        lines = [x for x in data.split(b"\n") if x and not x.isspace()]
        n, n_lines = max(1, len(words)), max(1, len(lines))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        fives = list(zip(words[::5], words[1::5], words[2::5], words[3::5], words[4::5], strict=False))
        out[i, 0] = np.log1p(len(words))
        out[i, 1] = lengths.mean()
        out[i, -8] = len(set(words)) / n
        out[i, -7] = sum(map(eq, words, words[1:])) / n
        out[i, -6] = np.log1p(len(lines))
        out[i, -5] = 1 - len(set(lines)) / n_lines if lines else 0
        out[i, -4] = np.log1p(lengths.max())
        out[i, -3] = (lengths <= 2).mean()
        out[i, -2] = 1 - len(set(fives)) / max(1, len(fives)) if fives else 0
        out[i, -1] = sum(x.rstrip()[-1:] in b".!?" for x in lines) / n_lines
    return out


@dataclass
class Gam:
    """Lookup tables: one for each feature, and one for each chosen pair."""

    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The step of each bin under the best tree with few leaves."""
    cuts = [0, len(g)]
    sg, sh = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    gain = lambda a, b: (sg[b] - sg[a]) ** 2 / (sh[b] - sh[a] + ridge)
    while len(cuts) <= leaves:
        best = max(((gain(a, m) + gain(m, b) - gain(a, b), m) for a, b in zip(cuts, cuts[1:], strict=False) for m in range(a + 1, b)), default=(0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (sg[b] - sg[a]) / (sh[b] - sh[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a table in four, its gain and its steps."""
    sg, sh = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, step = 0.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            quads = [(m[i, j], m[i, -1] - m[i, j], m[-1, j] - m[i, j], m[-1, -1] - m[i, -1] - m[-1, j] + m[i, j]) for m in (sg, sh)]
            value = sum(a * a / (b + ridge) for a, b in zip(*quads, strict=True))
            if value > best:
                best = value
                a, b, c, d = (x / (y + ridge) for x, y in zip(*quads, strict=True))
                step = np.full_like(g, d)
                step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1] = a, b, c
    return best, step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 60, rate: float = 0.2, leaves: int = 3, n_pairs: int = 6, pair_rounds: int = 15, pair_bins: int = 6, ridge: float = 5.0) -> Gam:
    """Cyclic boosting of log loss; rows come in a fixed order, so the model is the same on every run."""
    n = len(y)
    grid = np.linspace(0, 1, bins + 1)[1:-1]
    model = Gam([np.unique(np.quantile(x[:, j], grid)) if n else np.zeros(0) for j in range(x.shape[1])])
    prior = (y.sum() + 1) / (n + 2)
    model.base = float(np.log(prior / (1 - prior)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [np.arange(len(e) + 1) * pair_bins // (len(e) + 1) for e in model.edges]
    if n == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    margin = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _shallow(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)), leaves, ridge)
            table += step
            margin += step[b[:, j]]
    c = np.stack([model.coarse[j][b[:, j]] for j in range(x.shape[1])], axis=1)
    cells = lambda i, j, v: np.bincount(c[:, i] * pair_bins + c[:, j], v, pair_bins**2).reshape(pair_bins, pair_bins)
    g, h = slopes()
    gains = {(i, j): _quadrants(cells(i, j, g), cells(i, j, h), ridge)[0] for i, j in combinations(range(x.shape[1]), 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.pair_tables = [np.zeros((pair_bins, pair_bins)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = rate * _quadrants(cells(i, j, g), cells(i, j, h), ridge)[1]
            table += step
            margin += step[c[:, i], c[:, j]]
    return model


def feature_rows(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``y``, a digest of the text and its features, for rows with ``text`` and ``y``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                marks = [hashlib.md5(t.encode("utf-8", "replace")).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(marks), pa.array(features(texts).tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "mark", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "y").mapInArrow(run, f"doc_id {kind}, y int, mark string, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Gam:
    """Learns from at most ``max_rows`` labelled rows outside the held-out fold; only their features reach the driver."""
    rows = one_of_each(feature_rows(training_rows(docs, labels, label, FOLDS, FOLD, max_rows)), "mark", "y", "x")
    rows = sorted((r.doc_id, r.mark, r.y, r.x) for r in rows.collect())
    return fit(np.array([r[3] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r[2] for r in rows], float))


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every whole text. A narrow map: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(features(texts)))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = with_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Gam, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(features(texts.tolist())))

    return docs.filter(scored(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)
