"""BPE encoding and decoding with batched numpy merge rounds.

New words of a batch are laid end to end in one flat array of symbol ids. Each
round finds the rank of every adjacent pair by binary search over the sorted
pair keys, takes the lowest rank of each word, and merges its occurrences in all
words at once, until no word has a known pair left. Encoded words are remembered
in a dictionary of bounded size, so a round runs over new words only.

The format is that of the ``tokenizers`` files of kind BPE with a word-end
suffix: NFC, white space folded, lower case, words by a fixed pattern, then the
bytes of each word. Special tokens in a text are found before anything else.

Edge cases: null and empty texts give no ids and an empty decoded text; repeated
rows are encoded as often as they occur; a word of any length is one word.
Characters younger than Python's Unicode tables, and marks younger than the library's, are listed below as the library has them.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbars.llm.work import chunks, with_text

#: Words remembered in a worker; beyond that the memory starts afresh.
REMEMBERED = 300_000
#: Longer words are encoded but not remembered.
LONG_WORD = 64
# Fixed values of the file format: what counts as white space.
SPACES = "\t-\r \x85\xa0  -     　"

# Letters and numbers of Unicode 16 and small forms of Unicode 17, which the library knows and Python's tables (15.1) don't.
LATER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
LATER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
LATER_SMALL = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}

# Combining marks younger than the library's tables of canonical order, for which they are no marks.
LATER_MARKS = [
    (0x07FD, 0x07FD), (0x0898, 0x089F), (0x08CA, 0x08D3), (0x09FE, 0x09FE), (0x0C3C, 0x0C3C), (0x0D3B, 0x0D3C), (0x0EBA, 0x0EBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
    (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070),
    (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47),
    (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136),
    (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
#: Where a text is cut before NFC: at such a mark, and before the vowel sign of the one pair of letters that the library doesn't know to be one.
_CUT = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER_MARKS) + "])|(?=\U00011930)")

WIDE = re.compile("[\U00010000-\U0010ffff]")
_LATER = re.compile("[" + "".join(map(chr, LATER_SMALL)) + "]")


def composed(text: str) -> str:
    """NFC by the library's tables: marks that these don't have keep their place, and nothing is ordered or composed across them."""
    if text.isascii() or not _CUT.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", part) for part in _CUT.split(text) if part)


def _classes(last: int) -> tuple[str, str]:
    """Letters and numbers up to a code point as ranges of a character class."""
    found: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(last + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in found:
            runs = found[kind]
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    found["L"] += [list(r) for r in LATER_LETTERS if r[0] <= last]
    found["N"] += [list(r) for r in LATER_NUMBERS if r[0] <= last]
    letters, numbers = ("".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in found[k]) for k in "LN")
    return letters, numbers


@lru_cache(2)
def word_pattern(wide: bool) -> re.Pattern:
    """The pattern of a word. Without code points over U+FFFF it is looked up in a table, with them in a list of ranges."""
    letters, numbers = _classes(sys.maxunicode if wide else 0xFFFF)
    return re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACES}{letters}{numbers}]+")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in such files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Bpe:
    """One tokenizer file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        self.base = size
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # All occurrences of a pair may be merged in one round if a pair never
        # ranks before the merge that makes one of its parts.
        made_at = np.full(size, -1)
        made_at[made] = np.arange(len(made))
        self.at_once = len(np.unique(made)) == len(made) and bool((np.maximum(made_at[left], made_at[right]) < np.arange(len(made))).all())
        self.known: dict[str, bytes] = {}

    def ranked(self, symbols: np.ndarray, inside: np.ndarray, at: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs that begin at some places stand in the sorted keys, and their ranks; pairs not inside a word or not known rank last."""
        left, right = (symbols, np.append(symbols[1:], 0)) if at is None else (symbols[at], symbols[after])
        key = np.where(inside, left * self.base + right, -1)
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return found, np.where(self.keys[found] == key, self.ranks[found], len(self.keys))

    def merge(self, words: list[str]) -> list[bytes]:
        """The packed ids of each word, by merge rounds over all of them."""
        data = [w.encode("utf-8") for w in words]
        lengths = np.array([len(d) for d in data], np.int64)
        flat = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.keys)
        at, rank = self.ranked(symbols, np.append(word[:-1] == word[1:], False))
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(starts, len(word)))
            lowest = np.minimum.reduceat(rank, starts)
            if (ended := lowest == none).any():
                over = np.repeat(ended, counts)
                done.append((word[over], symbols[over]))
                symbols, word, rank, at = symbols[~over], word[~over], rank[~over], at[~over]
                lowest, counts = lowest[~ended], counts[~ended]
                if not len(symbols):
                    break
            where = np.flatnonzero(rank == np.repeat(lowest, counts))
            if self.at_once:
                # of overlapping occurrences every other one, from the left
                run = np.append(True, np.diff(where) > 1)
                first = where[run][np.cumsum(run) - 1]
                where = where[(where - first) % 2 == 0]
            else:
                where = where[np.append(True, word[where[1:]] != word[where[:-1]])]
            symbols[where] = self.made[at[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            new = where - np.arange(len(where))  # places after the merge
            symbols, word, rank, at = symbols[keep], word[keep], rank[keep], at[keep]
            mark = np.zeros(len(word) + 1, bool)
            mark[new] = mark[new - 1] = True  # -1 is the spare last place
            changed = np.flatnonzero(mark[:-1])
            after = np.minimum(changed + 1, len(word) - 1)
            inside = (changed < len(word) - 1) & (word[changed] == word[after])
            at[changed], rank[changed] = self.ranked(symbols, inside, changed, after)
        order_word = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(order_word, kind="stable")
        cuts = np.append(0, np.cumsum(4 * np.bincount(order_word, minlength=len(words)))).tolist()
        packed = ids[order].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def words(self, text: str) -> list[str]:
        text = composed(text)
        # one letter at a time, so no final sigma
        text = text.replace("Σ", "σ").lower()
        if not text.isascii() and _LATER.search(text):
            text = text.translate(LATER_SMALL)
        return word_pattern(WIDE.search(text) is not None).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces: list[list[str | int]] = []
        new: set[str] = set()
        if len(self.known) > REMEMBERED:
            self.known = {}
        for text in texts:
            if self.splitter and self.splitter.search(text):
                found: list[str | int] = []
                for part in self.splitter.split(text):
                    found.extend([self.special[part]] if part in self.special else self.words(part))
            else:
                found = self.words(text)
            pieces.append(found)
            new.update(found)
        new = {w for w in new - self.known.keys() if isinstance(w, str)}
        listed = list(new)
        ids = dict(zip(listed, self.merge(listed), strict=True)) if listed else {}
        ids |= {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        short = {w: x for w, x in ids.items() if isinstance(w, int) or len(w) <= LONG_WORD}
        self.known |= short
        long = ids if len(short) < len(ids) else {}
        get = (lambda w, a=self.known, b=long: a[w] if w in a else b[w]) if long else self.known.__getitem__
        return [b"".join(map(get, found)) for found in pieces]

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, special ones too, joined by spaces: these files have no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text.

    Returns ``doc_id``, ``n_tokens`` (long) and ``ids`` (binary, little-endian
    unsigned 32-bit integers). ``tokenizer`` is the path of the file, the same
    on every executor. A narrow map: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for part, texts in chunks(batch, size=2 << 20):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return with_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every whole text, without its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for part, texts in chunks(batch, size=2 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in bpe.encode(texts)], pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return with_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Turns ``ids`` back into text: adds ``decoded`` to the id, ``n_tokens`` and the ids. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for start in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(start, 256)
                texts = [bpe.decode(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    ids = F.coalesce(F.col(ids_col), F.lit(b""))
    rows = encoded.select(F.col(id_col).alias("doc_id"), (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), ids.alias("ids"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """``n_tokens`` and the SHA-256 of the ids and of the decoded text."""
    return decoded.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
