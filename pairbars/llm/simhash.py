"""SimHash near-dedup: pigeonhole blocks, a join on blocks, then Hamming distances.

A fingerprint of 64 bits is cut into blocks. Two fingerprints that differ in at
most ``distance`` bits agree in ``blocks - distance`` blocks at least, so every
choice of that many blocks is a key, and close pairs share one. Equal
fingerprints are one node from the start. A bucket of up to ``bucket``
fingerprints is verified in one go. A larger one is dealt anew by keys that fix
more bits, so that at most 2**(3 * distance) fingerprints can share one: that
way is exact too, whatever the group's size. Of a bucket only the links of a
spanning forest come out, never all pairs.

Edge cases: a null or empty text, or one without words, has fingerprint zero and
is linked like any other; a null id takes part but is never a component's id
unless all its ids are null; repeated rows fall together; a text of any length has
one fingerprint; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbars.llm.components import components
from pairbars.llm.work import chunks, partitions, with_text, work_dir, written

SEED = 42
BITS = 64


def shingle_hashes(text: str, words: int = 3) -> list[int]:
    found = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0]
    for w in found:
        starts.append(starts[-1] + len(w) + 1)
    shingles = [joined[a : b - 1] for a, b in zip(starts, starts[words:], strict=False)]
    return list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)))


def fingerprint_of(texts: list[str], words: int = 3) -> np.ndarray:
    """One unsigned fingerprint per text: the bits set in over half of its hashes."""
    each = [shingle_hashes(t, words) for t in texts]
    counts = np.array([len(x) for x in each], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        hashes = np.array([h for x in each for h in x], np.uint64)
        starts = np.cumsum(counts[full]) - counts[full]
        bits = np.empty((len(full), BITS), bool)
        for k in range(BITS):  # a bit at a time: little memory for very long texts
            one = ((hashes >> np.uint64(k)) & np.uint64(1)).astype(np.int32)
            bits[:, k] = np.add.reduceat(one, starts) * 2 > counts[full]
        out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprint_of(texts, words).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return with_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _cut(bits: list[int], parts: int) -> list[int]:
    """The bits in as many runs of nearly equal length, each as a mask."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in pairwise(edges)]


def block_masks(blocks: int, distance: int) -> list[int]:
    cut = _cut(list(range(BITS)), blocks)
    return [sum(x) for x in combinations(cut, blocks - distance)]


def fine_masks(mask: int, distance: int, width: int = 3) -> list[int]:
    """Masks that fix what ``mask`` does and all but ``distance`` small blocks of the rest."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cut = _cut(free, -(-len(free) // width))
    return [mask + sum(x) for x in combinations(cut, max(0, len(cut) - distance))]


def _forest(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of one bucket."""
    left = np.unique(fps)
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            close = np.bitwise_count(left ^ x) <= distance
            if close.any():
                found = left[close]
                yield from ((int(x), int(y)) for y in found)
                todo.extend(found)
                left = left[~close]


def _links(candidates: DataFrame, distance: int) -> DataFrame:
    """Verified links of candidates (t, key, fp); buckets are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])))
            sizes = np.diff(np.append(cuts, len(t)))
            two = cuts[sizes == 2]
            two = two[(np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance) & (fp[two] != fp[two + 1])] if len(two) else two
            more = [p for s, n in zip(cuts[sizes > 2], sizes[sizes > 2], strict=True) for p in _forest(fp[s : s + n], distance)]
            a = np.concatenate([fp[two], np.array([x for x, _ in more], np.uint64)]).view(np.int64)
            b = np.concatenate([fp[two + 1] if len(two) else fp[:0], np.array([y for _, y in more], np.uint64)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            t, key, fp = (np.concatenate([h, np.asarray(batch.column(i))]) for i, h in enumerate(held))
            last = np.flatnonzero((t != t[-1]) | (key != key[-1])) if len(t) else t
            end = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
            held = (t[end:], key[end:], fp[end:])
            if end:
                yield of(t[:end], key[:end], fp[:end].view(np.uint64))
        if len(held[0]):
            yield of(held[0], held[1], held[2].view(np.uint64))

    n = partitions(candidates.sparkSession)
    dealt = candidates.select(F.col("t").cast("long"), "key", "fp").repartition(n, "t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(run, "a long, b long")


def close_links(nodes: DataFrame, distance: int = 3, blocks: int = 5, bucket: int = 4096) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` of ``nodes`` within the distance; ``nodes`` are distinct."""
    spark = nodes.sparkSession
    masks = block_masks(blocks, distance)
    keys = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key")
    where = work_dir(spark)
    # written before the join, so that both sides are shuffles and a key of millions of fingerprints can be split
    shared = written(keys.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), where, "shared")
    candidates = written(keys.join(shared, ["t", "key"]), where, "candidates")
    links = _links(candidates.filter(F.col("n") <= bucket), distance)
    large = candidates.filter(F.col("n") > bucket)
    if large.isEmpty():
        return links
    # a fixed table: its size depends on blocks and distance alone
    fine = spark.createDataFrame([(i, j, _signed(f)) for i, m in enumerate(masks) for j, f in enumerate(fine_masks(m, distance))], "t int, j int, mask long")
    again = large.join(F.broadcast(fine), "t").select((F.col("t") * 100_000 + F.col("j")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    return links.unionByName(_links(again, distance))


def _components(fps: DataFrame, where: str, distance: int, blocks: int, bucket: int) -> DataFrame:
    """``fp`` and ``component_id``: the smallest id of the fingerprints that can be reached. Tables are written before they are joined, so that Spark can split a hot one."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), where, "nodes")
    roots = components(close_links(nodes.select("fp"), distance, blocks, bucket))
    linked = written(nodes.join(written(_with_roots(roots), where, "roots"), "fp"), where, "linked")
    least = written(linked.groupBy("root").agg(F.min("first_id").alias("least_id")), where, "least")
    groups = written(linked.join(least, "root").select("fp", "least_id"), where, "groups")
    ids = nodes.join(groups, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return written(ids, where, "ids")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, blocks: int = 5, bucket: int = 4096) -> DataFrame:
    """The near-duplicate group of every document.

    Returns ``doc_id``, ``fingerprint`` (16 hexadecimal digits) and
    ``component_id``, the smallest id reachable over fingerprints that differ in
    at most ``distance`` bits, for every row of ``docs``.
    """
    where = work_dir(docs.sparkSession)
    fps = written(fingerprints(docs, id_col, text_col, words), where, "fingerprints")
    out = fps.join(_components(fps, where, distance, blocks, bucket), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_roots(roots: DataFrame) -> DataFrame:
    """Roots count as linked to themselves."""
    return roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, blocks: int = 5, bucket: int = 4096) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id, of equal ids that with the smallest text digest.

    A row without an id stays only where no row of its group has one. Rows equal in id and text count as one.
    """
    where = work_dir(docs.sparkSession)
    mark = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    place = F.struct(F.isnull(id_col).alias("none"), F.col(id_col).alias("id"), mark.alias("mark"))
    fps = written(fingerprints(docs.select(place.alias("place"), text_col), "place", text_col, words), where, "fingerprints")
    chosen = fps.join(_components(fps, where, distance, blocks, bucket), "fp").filter(F.col("doc_id") == F.col("component_id"))
    chosen = chosen.groupBy(F.col("doc_id.id").alias("_id"), F.col("doc_id.mark").alias("_mark")).agg(F.count("*").alias("_rows"))
    chosen = written(chosen, where, "chosen")
    # the ids grow with the documents, so they are never broadcast
    kept = docs.join(chosen.hint("merge"), docs[id_col].eqNullSafe(chosen["_id"]) & (mark == chosen["_mark"]))
    once = kept.filter("_rows = 1").select(docs.columns)
    repeated = kept.filter("_rows > 1").dropDuplicates(["_id", "_mark"]).select(docs.columns)
    return once.unionByName(repeated)
