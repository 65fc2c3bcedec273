"""PII: base rules, and a character-level bidirectional LSTM with CRF transitions.

The base rules find e-mail addresses, IP addresses, card numbers and telephone
numbers. Their spans in a bounded sample of documents, half of them rewritten to forms
that the rules miss (``name at host dot com``, ``10[.]0[.]0[.]1``, card numbers with
dots, telephone numbers without a country), are the labelled spans from which the
network is trained in numpy. The network reads overlapping windows. What windows say
of a place is averaged, more for places in a window's middle, and one Viterbi path
over the whole stretch of windows decides, so a span may cross windows, and a stretch
may be as long as its text (about 100 bytes of memory a character). A base span
always stays; a span of the network is added where it meets no base span.

Every labelled form holds a digit, an at sign or a spelt-out dot or at. Windows that
are neither such a place's nor next to one's are not read.

Edge cases: null and empty texts have no spans; repeated rows give equal rows;
without any labelled span the network is left out; offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbars.llm.work import chunks, with_text, work_dir, written

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE = 64, 32
#: Documents that labelled spans are taken from, spans of a kind in one document, and windows to learn from, at most.
SAMPLE_DOCS, SAMPLE_SPANS, SAMPLE_WINDOWS = 8_000, 6, 3_600
CONFIDENCE = 0.5
#: Characters of the shortest labelled form.
SHORTEST = 7
CHARS = 129  # ASCII, and one for all others
TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind

_ANCHOR = re.compile(r"[0-9@]|\b[Dd][Oo][Tt]\b|[\[({] ?[Aa][Tt] ?[\])}]")
_DIGIT_OR_AT = re.compile(r"[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # number of the kind, start, end


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the base rules, by kind, then start. Linear in the text."""
    found: list[Span] = []
    if not _DIGIT_OR_AT.search(text):
        return found
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end and (domain := _DOMAIN.match(text, at + 1)):
            start = at
            while start > end and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                end = domain.end()
                found.append((0, start, end))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGITS.sub("", m[0])) <= 19 and _luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def char_ids(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), CHARS - 1).astype(np.int64)


def tags(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        if not out[a:b].any():
            out[a:b] = 2 + 2 * kind
            out[a] = 1 + 2 * kind
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class Network:
    """Parameters by name: for each direction the input table, recurrent weights; output weights; transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["in" + d] = rng.normal(0, 0.3, (CHARS, 4 * hidden))
            p["rec" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            p["in" + d][:, hidden : 2 * hidden] += 1  # remember at first
        p["out"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, TAGS))
        p["bias"] = np.zeros(TAGS)
        p["move"] = np.zeros((TAGS, TAGS))
        p["first"] = np.zeros(TAGS)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _lstm(self, ids: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of one direction; ids: windows by places, in reading order."""
        n, length = ids.shape
        rec = self.p["rec" + d]
        size = rec.shape[0]
        h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        out, steps = np.empty((n, length, size), np.float32), []
        for t in range(length):
            z = self.p["in" + d][ids[:, t]] + h @ rec
            s = _sigmoid(z[:, : 3 * size])
            i, f, o, g = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :], np.tanh(z[:, 3 * size :])
            before, h_before = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep:
                steps.append((i, f, o, g, before, tc, h_before))
        return out, steps

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        f, _ = self._lstm(ids, "f", False)
        b, _ = self._lstm(ids[:, ::-1], "b", False)
        return np.concatenate([f, b[:, ::-1]], axis=2) @ self.p["out"] + self.p["bias"]

    def _lstm_back(self, ids: np.ndarray, d: str, steps: list, dh_out: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        rec = self.p["rec" + d]
        size = rec.shape[0]
        dh, dc = np.zeros_like(dh_out[:, 0]), np.zeros_like(dh_out[:, 0])
        dz_all = np.empty((*ids.shape, 4 * size), np.float32)
        for t in range(ids.shape[1] - 1, -1, -1):
            i, f, o, g, before, tc, h_before = steps[t]
            dh = dh + dh_out[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grads["rec" + d] += h_before.T @ dz
            dz_all[:, t] = dz
            dh, dc = dz @ rec.T, dc * f
        np.add.at(grads["in" + d], ids.ravel(), dz_all.reshape(-1, 4 * size))

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of the tag paths under the CRF, and its gradients."""
        n, length = ids.shape
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        f, steps_f = self._lstm(ids, "f", True)
        b, steps_b = self._lstm(ids[:, ::-1], "b", True)
        states = np.concatenate([f, b[:, ::-1]], axis=2)
        e = states @ self.p["out"] + self.p["bias"]
        move, every = self.p["move"], np.arange(n)
        alpha = np.empty_like(e)
        alpha[:, 0] = self.p["first"] + e[:, 0]
        for t in range(1, length):
            alpha[:, t] = _logsumexp(alpha[:, t - 1, :, None] + move, 1) + e[:, t]
        total = _logsumexp(alpha[:, -1], 1)
        beta = np.zeros_like(e)
        for t in range(length - 2, -1, -1):
            beta[:, t] = _logsumexp(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        de = np.exp(alpha + beta - total[:, None, None])
        grads["first"] += de[:, 0].sum(0)
        np.add.at(grads["first"], gold[:, 0], -1)
        for t in range(1, length):
            grads["move"] += np.exp(alpha[:, t - 1, :, None] + move + (e[:, t] + beta[:, t])[:, None, :] - total[:, None, None]).sum(0)
        np.add.at(grads["move"], (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1)
        path = self.p["first"][gold[:, 0]] + np.take_along_axis(e, gold[:, :, None], 2)[:, :, 0].sum(1) + move[gold[:, :-1], gold[:, 1:]].sum(1)
        de[every[:, None], np.arange(length), gold] -= 1
        grads["out"] += np.tensordot(states, de, ((0, 1), (0, 1)))
        grads["bias"] += de.sum((0, 1))
        ds = de @ self.p["out"].T
        size = self.p["recf"].shape[0]
        self._lstm_back(ids, "f", steps_f, ds[:, :, :size], grads)
        self._lstm_back(ids[:, ::-1], "b", steps_b, ds[:, ::-1, size:], grads)
        return float((total - path).sum() / n), {k: g / n for k, g in grads.items()}

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tag path for stretches of one length: n by length by tags."""
        n, length, _ = e.shape
        best, back = self.p["first"] + e[:, 0], np.empty(e.shape, np.int8)
        for t in range(1, length):
            scores = best[:, :, None] + self.p["move"]
            back[:, t] = scores.argmax(1)
            best = scores.max(1) + e[:, t]
        path = np.empty((n, length), np.int64)
        path[:, -1] = best.argmax(1)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[np.arange(n), t, path[:, t]]
        return path


def other_form(kind: int, text: str, rng: np.random.Generator) -> str:
    """A labelled span in another usual form of its kind, which the base rules miss."""
    digits = _NOT_DIGITS.sub("", text)
    pick = lambda forms: forms[int(rng.integers(len(forms)))]
    if kind == 0:
        name, host = text.split("@", 1)
        at, dot = pick([(" at ", " dot "), (" AT ", " DOT "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" @ ", "."), (" @ ", " . "), ("[at]", "."), (" (at) ", ".")])
        return name + at + host.replace(".", dot)
    if kind == 1:
        return pick([" . ", "[.]", "(.)", " dot ", "[dot]"]).join(text.split("."))
    if kind == 2:
        return pick([".", "/", "_", "  ", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if len(digits) < 10:
        return pick(["00", "(00)", "tel "]) + digits
    a, b, c, country = digits[-10:-7], digits[-7:-4], digits[-4:], digits[:-10]
    return pick([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{country} {a} {b} {c}", f"{a} {b} {c}"])


def training_windows(text: str, rng: np.random.Generator, spans_of_a_kind: int = SAMPLE_SPANS) -> list[tuple[int, str, list[int]]]:
    """Windows at random places about base spans, as they are and rewritten, and about other places that are read; with the kind, or -1."""
    spans, out = base_spans(text), []
    marked = tags(len(text), spans)
    few = [s for kind in range(len(KINDS)) for s in _some([x for x in spans if x[0] == kind], spans_of_a_kind, rng)]
    for kind, a, b in few:
        if marked[a] != 1 + 2 * kind:
            continue
        left, right = text[max(0, a - WINDOW) : a], text[b : b + WINDOW]
        left_tags, right_tags = marked[max(0, a - WINDOW) : a], marked[b : b + WINDOW]
        for span in (text[a:b], other_form(kind, text[a:b], rng)):
            whole = left + span + right
            whole_tags = np.concatenate([left_tags, tags(len(span), [(kind, 0, len(span))]), right_tags])
            start = int(np.clip(len(left) + len(span) // 2 - rng.integers(0, WINDOW), 0, max(0, len(whole) - WINDOW)))
            out.append((kind, whole[start : start + WINDOW], whole_tags[start : start + WINDOW].tolist()))
    others = [m.start() for m in _ANCHOR.finditer(text) if not marked[m.start()]]
    for at in _some(others, 2, rng):
        start = int(np.clip(at - rng.integers(0, WINDOW), 0, max(0, len(text) - WINDOW)))
        out.append((-1, text[start : start + WINDOW], marked[start : start + WINDOW].tolist()))
    return [x for x in out if x[1]]


def _some(items: list, n: int, rng: np.random.Generator) -> list:
    return items if len(items) <= n else [items[i] for i in sorted(rng.choice(len(items), n, replace=False))]


def fit(windows: list[tuple[str, list[int]]], hidden: int = 24, epochs: int = 8, batch: int = 96, rate: float = 0.02, seed: int = 11) -> Network | None:
    """Adam over shuffled batches; windows come in a fixed order, so the result is the same on every run."""
    if not any(any(t) for _, t in windows):
        return None
    ids = np.full((len(windows), WINDOW), ord(" "), np.int64)
    gold = np.zeros((len(windows), WINDOW), np.int64)
    for k, (w, t) in enumerate(windows):
        ids[k, : len(w)], gold[k, : len(t)] = char_ids(w), t
    net, rng = Network.fresh(hidden, seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for s in range(0, len(order), batch):
            rows, step = order[s : s + batch], step + 1
            _, grads = net.gradients(ids[rows], gold[rows])
            scale = min(1.0, 5.0 / (1e-9 + np.sqrt(sum(float((g * g).sum()) for g in grads.values()))))
            now = rate * (1 - epoch / epochs)
            for k, g in grads.items():
                g = g * scale
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.005 * (g * g - v[k])
                net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-6)).astype(np.float32)
    return net


def _stretches(text: str) -> list[tuple[int, int]]:
    """Runs of windows to read, as first and last window number."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() // STRIDE - 2), min(last, (m.end() - 1) // STRIDE + 1)
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def network_spans(texts: list[str], net: Network, windows_at_once: int = 2048) -> list[list[Span]]:
    """The spans of the global tag path of each whole text."""
    found: list[list[Span]] = [[] for _ in texts]
    work = [(i, a, b) for i, t in enumerate(texts) for a, b in _stretches(t)]
    group: list[tuple[int, int, int]] = []
    size = 0
    for k, item in enumerate(work):
        group.append(item)
        size += item[2] - item[1] + 1
        if size >= windows_at_once or k + 1 == len(work):
            _read(texts, group, net, found)
            group, size = [], 0
    return found


def _emitted(text: str, a: int, b: int) -> np.ndarray:
    """The characters of a stretch of windows."""
    ids = char_ids(text[a * STRIDE : b * STRIDE + WINDOW])
    return np.append(ids, np.full((b - a) * STRIDE + WINDOW - len(ids), ord(" "), np.int64))


def _read(texts: list[str], group: list[tuple[int, int, int]], net: Network, found: list[list[Span]]) -> None:
    each = [_emitted(texts[i], a, b) for i, a, b in group]
    total = [np.zeros((len(x), TAGS), np.float32) for x in each]
    rows = [np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::STRIDE] for x in each]
    owner = np.repeat(np.arange(len(group)), [len(r) for r in rows])
    place = np.concatenate([np.arange(len(r)) * STRIDE for r in rows])
    starts = np.cumsum([0] + [len(r) for r in rows])
    for s in range(0, len(owner), 4096):
        k = owner[s : s + 4096]
        some = [rows[j][max(0, s - starts[j]) : s + 4096 - starts[j]] for j in range(k[0], k[-1] + 1)]
        for j, at, e in zip(k, place[s : s + 4096], net.emissions(np.concatenate(some)) * _WEIGHT[:, None], strict=True):
            total[j][at : at + WINDOW] += e
    by_length: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for (i, a, _), x in zip(group, total, strict=True):
        weight = np.zeros(len(x), np.float32)
        for half in range(0, WINDOW, STRIDE):  # what the windows that start at even and odd strides weigh
            first = np.arange(half, len(x) - WINDOW + 1, WINDOW)
            weight[(first[:, None] + np.arange(WINDOW)).ravel()] += np.tile(_WEIGHT, len(first))
        by_length.setdefault(len(x), []).append((i, a * STRIDE, x / weight[:, None]))
    for same in by_length.values():
        e = np.stack([x for _, _, x in same])
        sure = np.exp(e - e.max(2, keepdims=True))
        sure /= sure.sum(2, keepdims=True)
        for (i, offset, _), path, share in zip(same, net.viterbi(e), sure, strict=True):
            p = np.flatnonzero(path)
            if not len(p):
                continue
            kinds = (path[p] - 1) // 2
            cuts = np.flatnonzero(np.append(True, (np.diff(p) > 1) | (np.diff(kinds) != 0) | (path[p][1:] % 2 == 1)))
            for s, t in zip(cuts, np.append(cuts[1:], len(p)), strict=True):
                a, b = int(p[s]), int(p[t - 1]) + 1
                if share[np.arange(a, b), path[a:b]].mean() >= CONFIDENCE and offset + b <= len(texts[i]):
                    found[i].append((int(kinds[s]), offset + a, offset + b))


def refused(text: str, kind: int, start: int, end: int) -> bool:
    """True for a span that a base rule has looked at and left out: part of a match that failed its check, or a card number by no check digit or length."""
    if kind == 0:
        return False
    if kind == 2:
        digits = _NOT_DIGITS.sub("", text[start:end])
        if not (13 <= len(digits) <= 19 and _luhn(digits)):
            return True
    return any(m.start() <= start and end <= m.end() for m in {1: _IP, 2: _CARD, 3: _PHONE}[kind].finditer(text))


def all_spans(texts: list[str], net: Network | None) -> list[list[tuple[int, int, int, bool]]]:
    """Base spans, and the network's where they meet none of those and no base rule has refused them; with a mark for base. By kind, then start."""
    out = []
    added = network_spans(texts, net) if net else [[] for _ in texts]
    for text, more in zip(texts, added, strict=True):
        spans = [(*s, True) for s in base_spans(text)]
        if more:
            taken = np.zeros(len(text), bool)
            for _, a, b, _ in spans:
                taken[a:b] = True
            for kind, a, b in more:
                if b - a >= SHORTEST and not taken[a:b].any() and not refused(text, kind, a, b):
                    spans.append((kind, a, b, False))
                    taken[a:b] = True
        out.append(sorted(spans))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Network | None:
    """Learns from windows of at most ``sample_docs`` documents, chosen by a hash of the id.

    Each kind, and windows without a span, have an equal share of ``sample_windows`` at
    most, chosen by a hash of the window; only these reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                rows = [(i, k, w, t) for i, x in zip(part.column(0).to_pylist(), texts, strict=True) for k, w, t in training_windows(x, np.random.default_rng(len(x)))]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["h", "k", "w", "t"])

    keyed = with_text(docs, id_col, text_col).withColumn("h", F.xxhash64("doc_id"))
    ids = keyed.select("h").distinct().orderBy("h").limit(sample_docs)
    rows = keyed.join(F.broadcast(ids), "h").filter(F.col("text").rlike("[0-9@]")).select("h", "text").mapInArrow(run, "h long, k int, w string, t array<long>")
    rows = written(rows.withColumn("order", F.xxhash64("h", "w")), work_dir(docs.sparkSession), "windows")
    share = -(-sample_windows // (1 + len(KINDS)))
    chosen = [r for k in range(-1, len(KINDS)) for r in rows.filter(F.col("k") == k).orderBy("order", "w", "t").limit(share).collect()]
    return fit([(r.w, r.t) for r in chosen])


def find(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, base) of every whole text. A narrow map: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            for part, texts in chunks(batch):
                spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in x] for x in all_spans(texts, net)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return with_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, the digest of the base spans, and all spans as text."""

    def joined(spans):  # type: ignore[no-untyped-def]
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])


    def count(kind: str):  # type: ignore[no-untyped-def]
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans fall together. Null texts stay null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        known = ["" if t is None else t for t in texts]
        out = []
        for old, text, spans in zip(texts, known, all_spans(known, net), strict=True):
            parts, end = [], 0
            for a, b, kind in sorted((a, b, k) for k, a, b, _ in spans):
                if a >= end:
                    parts.append(text[end:a] + f"[{KINDS[kind].upper()}]")
                end = max(end, b)
            out.append(old if old is None else "".join(parts) + text[end:])
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, masked(F.col(text_col)))
