"""Buckets of equal strings, refined by the identifiers at later offsets, and the Spark jobs around them.

A string is a run of symbols: bytes, or words that have identifiers already. See
``spans`` and ``passages``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 15
#: Bytes that are kept or left out together where only some strings are asked for.
BLOCK = 64
#: Bytes of whole texts that a task works through at once.
AT_ONCE = 1 << 20
_PLACE = np.uint64((1 << 28) - 1)
_ODD = np.random.default_rng(20).integers(1, 1 << 63, (2, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

Ids = list[np.ndarray]  # one array of 64 bits for each lane


def mixed(x: np.ndarray, lane: int = 0) -> np.ndarray:
    """A permutation of the numbers of 64 bits."""
    x = x ^ (x >> np.uint64(32 + lane))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29 + lane)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32 - lane)
    return x


def paired(first: Ids, later: Ids) -> Ids:
    """Identifiers of pairs of buckets."""
    out = []
    for lane in range(len(first)):
        x = first[0] * _ODD[lane, 0]
        for part, odd in zip([*first[1:], *later], _ODD[lane, 1:], strict=False):
            x += part * odd
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
        out.append(x)
    return out


def grams(data: np.ndarray, width: int, lanes: int) -> Ids:
    """Buckets of the first level: ``width`` bytes (1, 2, 4 or 8) from every place, without collisions."""
    out = np.empty(max(0, len(data) - width + 1), np.uint64)
    for k in range(min(width, len(out))):
        out[k::width] = np.frombuffer(data, f"<u{width}", (len(data) - k) // width, k)
    return [mixed(out, lane) for lane in range(lanes)]


def refined(ids: Ids, have: int, length: int) -> Ids:
    """Buckets of ``length`` bytes from those of ``have`` bytes, by the identifiers at later offsets."""
    while have < length:
        step = min(have, length - have)
        ids = paired([x[:-step] for x in ids], [x[step:] for x in ids])
        have += step
    return ids


def buckets(data: np.ndarray, length: int, lanes: int = 2) -> Ids:
    """The identifiers of the strings of ``length`` bytes from every place."""
    width = min(8, _level(length))
    if len(data) < length:
        return [np.zeros(0, np.uint64) for _ in range(lanes)]
    return refined(grams(data, width, lanes), width, length)


def anchors(data: np.ndarray, stops: np.ndarray, length: int, q: int, bucket: Callable[[np.ndarray, int], np.ndarray] = lambda part, q: buckets(part, q, 1)[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, first and last start of the strings that have them, and the anchors' buckets, of texts end to end that stop at ``stops``."""
    places, firsts, lasts, found = [], [], [], []
    width = length - q + 1
    sizes = np.diff(stops, prepend=0)
    room = np.maximum(sizes - length + 1, 0)
    fits = np.repeat(np.tile([True, False], len(sizes)), np.stack([room, sizes - room], axis=1).ravel())
    for s in range(0, max(0, len(data) - length + 1), SEGMENT):
        gram = bucket(data[s : s + SEGMENT + length - 1], q)
        n = len(gram)
        starts = np.flatnonzero(fits[s : s + n - width + 1])
        if not len(starts):
            continue
        least, have = (gram & ~_PLACE) | np.arange(n, dtype=np.uint64), 1
        while have < width:
            step = min(have, width - have)
            least, have = np.minimum(least[:-step], least[step:]), have + step
        place = (least[starts] & _PLACE).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        places.append(place[cuts] + s)
        firsts.append(starts[cuts] + s)
        lasts.append(starts[np.append(cuts[1:], len(starts)) - 1] + s)
        found.append(gram[place[cuts]])
    if not places:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    place, first, last, gram = map(np.concatenate, (places, firsts, lasts, found))
    new = np.append(True, place[1:] != place[:-1])  # one anchor may go on in the next segment
    return place[new], first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(place) - 1)], gram[new]


def _level(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def covered(data: np.ndarray, wanted: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """The blocks that strings (starts, length) cover, end to end, and the strings in them; a string's blocks stay neighbours."""
    n = -(-len(data) // BLOCK)
    change = np.zeros(n + 1, np.int64)
    for starts, length in wanted:
        change += np.bincount(starts // BLOCK, minlength=n + 1) - np.bincount((starts + length - 1) // BLOCK + 1, minlength=n + 1)
    live = np.cumsum(change[:-1]) > 0
    blocks = np.append(data, np.zeros(n * BLOCK - len(data), data.dtype)).reshape(n, BLOCK)
    shift = (np.cumsum(live) - 1 - np.arange(n)) * BLOCK
    return blocks[live].ravel(), [(starts + shift[starts // BLOCK], length) for starts, length in wanted]


def at_places(data: np.ndarray, wanted: list[tuple[np.ndarray, int]]) -> list[Ids]:
    """The identifiers of strings (starts, length), each from the last level that is not longer than they are.

    The levels are shared; only blocks of bytes that a string covers are worked through.
    """
    data, wanted = covered(data, wanted)
    out = [[np.zeros(len(starts), np.uint64) for _ in range(2)] for starts, _ in wanted]
    own = [np.argsort(starts // SEGMENT, kind="stable") for starts, _ in wanted]
    cuts = [np.searchsorted(starts[order] // SEGMENT, np.arange(len(data) // SEGMENT + 2)) for (starts, _), order in zip(wanted, own, strict=True)]
    levels, longest = sorted({_level(length) for _, length in wanted}), max(length for _, length in wanted)
    for k in range(len(data) // SEGMENT + 1):
        if not any(c[k] < c[k + 1] for c in cuts):
            continue
        have = min(8, levels[0])
        base = grams(data[k * SEGMENT : (k + 1) * SEGMENT + longest], have, 2)
        for level in levels:
            base, have = refined(base, have, level), level
            for (starts, length), order, c, ids in zip(wanted, own, cuts, out, strict=True):
                here = order[c[k] : c[k + 1]]
                if _level(length) == level and len(here):
                    at = starts[here] - k * SEGMENT
                    later = at + length - level
                    ids[0][here], ids[1][here] = paired([x[at] for x in base], [x[later] for x in base])
    return out


def mapped(rows: DataFrame, work: Callable[..., dict[str, np.ndarray]], schema: str, fields: list[str]) -> DataFrame:
    """Runs ``work(bytes, stops, *lists)`` for runs of whole texts; it returns columns and the number of the text of each row.

    ``lists`` are the columns of structs: each field flat, with the number of the text of each element before them.
    """
    lists = [c for c in rows.columns if c not in ("row", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.asarray(batch.column("row"))
            text, begin = batch.column("text").cast(pa.binary()), 0
            while begin < batch.num_rows:
                data, end, size = [], begin, 0
                while end < batch.num_rows and size < AT_ONCE:
                    data.append(text[end].as_py())
                    size += len(data[-1])
                    end += 1
                flat, stops = np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data])
                more = []
                for name in lists:
                    column = batch.column(name).slice(begin, end - begin)
                    sizes, values = np.asarray(column.value_lengths().fill_null(0)), column.flatten()
                    more.append([np.repeat(np.arange(end - begin), sizes), *[np.asarray(values.field(k)) for k in range(values.type.num_fields)]])
                found = work(flat, stops, *more)
                out = {"row": number[begin:end][found["text"]]} | {name: found[name] for name in fields}
                for at in range(0, len(out["row"]), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 200_000]) for v in out.values()], list(out))
                begin = end

    return rows.mapInArrow(run, "row long, " + schema)


def lists(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of each document as one list, as long as the document at most."""
    return rows.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("found"))


def bucketed(docs: DataFrame, where: str, n: int) -> DataFrame:
    """``row``, ``doc_id``, ``text`` as files in the work folder, bucketed by row; no table of that name stays in the catalogue."""
    spark, name = docs.sparkSession, f"repeated_spans_{uuid.uuid4().hex}"
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    numbered.repartition(n, "row").write.bucketBy(n, "row").format("parquet").option("compression", "zstd").option("path", f"{where}/texts").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table only named them
    return texts
