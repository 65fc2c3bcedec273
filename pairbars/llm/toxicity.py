"""Toxicity: a factorization machine over hashed terms.

A text is the set of its hashed words and of their hashed beginnings, so that
inflected forms share a term; a beginning that several different words of the text
share also counts as a term for two, three and four of them or more. The machine
adds a weight for each term and the inner product of the factor vectors of each pair
of terms, in time linear in the terms: half the difference of the squared sum and
the sum of squares. So it learns that two harmless words together are not harmless,
which weights that only add up cannot.

Every term of the training texts keeps parameters in a table of ``BUCKETS`` hashes,
whichever class it speaks for. How fast a term learns follows the evidence for it:
the number of texts with it, and its association (chi-square) with either class, or
that of a pair which it is half of with what weights alone leave unexplained. So two
words are learnt that are each as common in either class and tell only together. Pairs
are tested among the ``PAIRED`` terms that vary most; other terms go by their own evidence.

Edge cases: null and empty texts have no terms and get the score of the bias;
with no labelled rows, or one class only, every score is that of the prior;
repeated words of a text count once, and so do terms that share a hash; a text of
any length is one set of terms.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbars.llm.labelled import held_out, one_of_each, training_rows
from pairbars.llm.work import chunks, with_text

FOLDS, FOLD = 4, 2
#: Rows that the machine learns from at most.
MAX_ROWS = 12_000
BEGINNING = 4
SHARED = 4
BUCKETS = 1 << 20
THRESHOLD = 0.3
REMEMBERED = 300_000
#: Terms whose pairs are tested, those that vary most: memory is some numbers for each two of them.
PAIRED = 2_000
#: Texts that are laid out over these terms at once.
ROWS = 512
_EDGES = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

_known: dict[bytes, tuple[int, int]] = {}


def _hashed(word: bytes) -> tuple[int, int]:
    start = word.decode("utf-8", "replace")[:BEGINNING].encode("utf-8", "replace") + b"*"
    return zlib.crc32(word) % BUCKETS, zlib.crc32(start) % BUCKETS


def terms(texts: list[str]) -> list[np.ndarray]:
    """The distinct hashed terms of each whole text, sorted."""
    if len(_known) > REMEMBERED:
        _known.clear()
    words = [set(_EDGES.sub(b" ", t.lower().encode("utf-8", "replace")).split()) for t in texts]
    for w in set().union(*words) - _known.keys():
        _known[w] = _hashed(w)
    get, out = _known.__getitem__, []
    for found in words:
        both = np.fromiter(chain.from_iterable(map(get, found)), np.int64, 2 * len(found)).reshape(-1, 2)
        starts, counts = np.unique(both[:, 1], return_counts=True)
        # a term for two words of a beginning, another for three, and so on
        shared = [(starts[counts >= n] * 2654435761 + n * 40503) % BUCKETS for n in range(2, SHARED + 1)]
        out.append(np.unique(np.concatenate([both[:, 0], starts, *shared])))
    return out


@dataclass
class Machine:
    """Parameters of the terms that have some; ``index`` gives their row, the last row is zero."""

    kept: np.ndarray  # sorted hashed terms
    base: float
    weights: np.ndarray  # terms + 1
    factors: np.ndarray  # terms + 1, k

    def margin(self, found: list[np.ndarray]) -> np.ndarray:
        counts = np.array([len(x) for x in found], np.int64)
        out = np.full(len(found), self.base)
        full = np.flatnonzero(counts)
        if len(full) and len(self.kept):
            flat = np.concatenate(found)
            at = np.minimum(np.searchsorted(self.kept, flat), len(self.kept) - 1)
            at = np.where(self.kept[at] == flat, at, len(self.kept))
            starts = np.cumsum(counts[full]) - counts[full]
            v = self.factors[at]
            sums = np.add.reduceat(v, starts)
            out[full] += np.add.reduceat(self.weights[at], starts) + 0.5 * (sums**2 - np.add.reduceat(v * v, starts)).sum(1)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(terms(texts)), -30, 30)))


def evidence(docs: np.ndarray, ones: np.ndarray, n: int, positive: float) -> np.ndarray:
    """From 0 to 1: how sure it is that a term in ``docs`` of ``n`` rows, ``ones`` of them positive, speaks for a class."""
    rate = positive / n
    return _sure(docs, (ones - docs * rate) ** 2 / (docs * rate * (1 - rate)), 30)


def _sure(docs: np.ndarray, chi: np.ndarray, half: float) -> np.ndarray:
    return (docs / (docs + 10) * chi / (chi + half)) ** 2


def pair_evidence(at: np.ndarray, row: np.ndarray, n: int, docs: np.ndarray, residual: np.ndarray, variance: np.ndarray, terms: int = PAIRED) -> np.ndarray:
    """From 0 to 1 for each term: how sure it is that its best pair explains what the weights leave.

    A score test of each pair: its summed residual squared, over its summed variance.
    ``at`` and ``row`` are term and row of each entry, rows in order. Chance makes the best of
    so many pairs large, hence only what lies over twice the logarithm of their number counts.
    """
    chosen = np.sort(np.argsort(-(docs * (1.0 - docs / n)), kind="stable")[:terms])
    where = np.full(len(docs), -1, np.int32)
    where[chosen] = np.arange(len(chosen))
    mine = np.flatnonzero(where[at] >= 0)
    column, row = where[at[mine]], row[mine]
    left, spread, both = (np.zeros((len(chosen), len(chosen)), np.float32) for _ in range(3))
    cuts = np.searchsorted(row, np.arange(0, n + ROWS, ROWS))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        x = np.zeros((min(ROWS, n - k * ROWS), len(chosen)), np.float32)
        x[row[a:b] - k * ROWS, column[a:b]] = 1
        part = slice(k * ROWS, k * ROWS + len(x))
        both += x.T @ x
        left += x.T @ (x * residual[part, None])
        spread += x.T @ (x * variance[part, None])
    chi = left * left / (spread + 1) - 2 * np.log(len(chosen) ** 2 / 2 + 1)
    np.fill_diagonal(chi, 0)
    out = np.zeros(len(docs))
    out[chosen] = _sure(both, np.maximum(chi, 0), 30).max(axis=1)
    return out


def fit(found: list[np.ndarray], y: np.ndarray, k: int = 4, rounds: int = 60, rate: float = 0.2, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Log loss by Adam over all rows at once; rows come in a fixed order, so the result is the same on every run.

    Weights alone are fitted first; the pairs that explain what these leave give their
    terms a pace too. Memory: some five numbers of four bytes for each term of each row.
    """
    n = len(y)
    prior = (y.sum() + 1) / (n + 2)
    bias = float(np.log(prior / (1 - prior)))
    counts = np.array([len(x) for x in found], np.int64)
    if not counts.sum() or y.min() == y.max():
        return Machine(np.zeros(0, np.int64), bias, np.zeros(1, np.float32), np.zeros((1, k), np.float32))
    flat = np.concatenate(found).astype(np.int32)
    docs = np.bincount(flat, minlength=BUCKETS)
    kept = np.flatnonzero(docs)
    at = (np.cumsum(docs > 0) - 1).astype(np.int32)[flat]
    del flat
    m, full = len(kept), np.flatnonzero(counts)  # rows with a term
    starts = np.cumsum(counts[full]) - counts[full]
    by_term = np.argsort(at, kind="stable")
    row = np.repeat(np.arange(len(full), dtype=np.int32), counts[full])
    place = row[by_term]
    del by_term
    docs, y_full = docs[kept], y[full]
    term_starts = np.cumsum(docs) - docs
    ones = np.add.reduceat(y_full.astype(np.float32)[place], term_starts)
    sure = evidence(docs, ones, n, float(y.sum()))

    def learnt(p: np.ndarray, bias: float, pace: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """The parameters (weights, then one row for each factor), the bias and the rows' scores."""
        a, b, grad = np.zeros_like(p), np.zeros_like(p), np.empty_like(p)
        for t in range(1, rounds + 1):
            margin = bias + np.add.reduceat(p[0][at], starts)
            sums = []
            for factor in p[1:]:
                v = factor[at]
                sums.append(np.add.reduceat(v, starts))
                v *= v
                margin += 0.5 * (sums[-1] ** 2 - np.add.reduceat(v, starts))
            scores = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            g = ((scores - y_full) / n).astype(np.float32)
            grad[0] = np.add.reduceat(g[place], term_starts)
            for j, total in enumerate(sums, 1):
                # d margin / d factor of a term in a row: the sum of the row's factors without its own
                grad[j] = np.add.reduceat((g * total)[place], term_starts) - grad[0] * p[j]
            bias -= 10 * rate * float(g.sum())
            grad += decay / 10 * p
            a += 0.1 * (grad - a)
            b += 0.01 * (grad * grad - b)
            p -= pace * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
        return p, bias, scores

    alone = learnt(np.zeros((1, m), np.float32), bias, (rate * sure).astype(np.float32))[2]
    joint = pair_evidence(at, row, len(full), docs, (y_full - alone).astype(np.float32), (alone * (1 - alone)).astype(np.float32))
    p = np.vstack([np.zeros((1, m)), np.random.default_rng(seed).normal(0, 0.01, (k, m))]).astype(np.float32)
    p, bias, _ = learnt(p, bias, (rate * np.maximum(sure, joint)).astype(np.float32))
    return Machine(kept, bias, np.append(p[0], np.float32(0)), np.vstack([p[1:].T, np.zeros((1, k), np.float32)]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Machine:
    """Learns from at most ``max_rows`` labelled rows outside the held-out fold; only their distinct hashed terms reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                packed = [x.astype("<i4").tobytes() for x in terms(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(packed, pa.binary())], ["doc_id", "y", "terms"])

    chosen = training_rows(docs, labels, label, FOLDS, FOLD, max_rows)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    rows = chosen.select("doc_id", "text", "y").mapInArrow(run, f"doc_id {kind}, y int, terms binary")
    rows = sorted((r.doc_id, bytes(r.terms), r.y) for r in one_of_each(rows, "terms", "y").collect())
    return fit([np.frombuffer(r[1], "<i4") for r in rows], np.array([r[2] for r in rows], float))


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every whole text. A narrow map: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(texts))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = with_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
