"""Filter audit, resampling and mixing against plain restatements on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pairbars.llm import audit, mixture, resample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, part string, bucket string, size string, n long"
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
LOWERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORDS = "The of and then WHAT there being only once more than every other plaCe time é 12 ½ straße".split()


def rows_of(texts, ids=None):
    rng = random.Random(5)
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "a", "Zz", "é", None]), len(t or ""), "clash", "clash", "clash", "clash", 9) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    passage = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "-er"]) for _ in range(n))
    base = [passage(rng.choice([3, 25, 60, 230])) for _ in range(40)]
    texts = [None, "", " \t\n ", "one", None, "", base[0], base[0], base[0], base[1] + " #", "A B C " * 90, passage(3000), "x" * 5000, "a\x00b c", *base]
    ids = [*range(7, 7 + len(texts))]
    found = rows_of(texts, ids)
    # rows without an id, rows that repeat an id and rows equal in everything
    return [*found, (None, base[0], "en", "a", 1, "", "", "", "", 1), (None, "x y", "en", "b", 1, "", "", "", "", 1), (8, "other text", "en", "b", 1, "", "", "", "", 1), *[found[20]] * 3, *[found[30]] * 2]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    found = [(i, 1 if i % 3 else 0, int(i % 5 == 0)) for i in ids if i % 4]
    return found, spark.createDataFrame([*found, (None, 1, 1), (ids[1], None, None), (ids[1], 1, 1), (10**9, 1, 1)], "doc_id long, quality int, toxic int")


def test_filter_audit(spark, docs, rows, empty):
    pairs, table = labels(spark, rows)
    good, toxic = {i for i, q, _ in pairs if q} | {8}, {i for i, _, t in pairs if t} | {8}
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    parts = defaultdict(list)
    for r in rows:
        text = r[1] or ""
        w = PLAIN.findall(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": r[0] is not None and r[0] > first[text]}
        parts[r[2] or ""].append(({f for f, x in fails.items() if x}, r[0] in good, r[0] in toxic))
    want, shapley = {}, Counter()
    for part, found in parts.items():
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                here = [d for d in found if not d[0] & before]
                gone = [d for d in here if f in d[0]]
                want[part, "".join(order), step + 1] = (len(here) - len(gone), len(gone), sum(f in d[0] for d in found) - len(gone), sum(d[0] == {f} for d in found), sum(d[1] for d in gone), sum(d[2] for d in gone))
                shapley[part, f] += len(gone)
    got = audit.audit(docs, table).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) for r in got} == want
    assert len(got) == len(want) == 600 * len(parts)
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in got)
    assert audit.audit(empty, table).count() == 0
    two = audit.audit(docs, table.limit(0), {"A": F.col("n_words") < 200}).collect()
    assert {(r.filter_order, r.step) for r in two} == {("AE", 1), ("AE", 2), ("EA", 1), ("EA", 2)} and not any(r.good_lost for r in two)


def features(text, longest=2):
    w = LOWERED.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled(texts, target, percent, longest, buckets=10000):
    """(n_features, weight, score) of (id, text) rows, and the ranks."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in side for g in features(x, longest)[1]) for side in ([x for _, x in texts], target))
    S, T = s.total(), t.total()
    out = []
    for i, text in texts:
        n, grams = features(text, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, grams)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    wanted = percent * len(fit) // 100
    ranked = [(*r, k + 1 if k < wanted else None) for k, r in enumerate(fit)]
    return sorted([*ranked, *[(*r, None) for r in out if r[1] < 20]], key=str)


@pytest.mark.parametrize(("longest", "chunk", "percent"), [(2, 1 << 20, 25), (2, 40, 60), (3, 7, 100), (1, 500, 0)])
def test_resampling(spark, docs, rows, empty, longest, chunk, percent):
    target = ["then what there", None, "", "other plaCe-er time " * 40]
    table = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, table, percent=percent, longest=longest, chunk_chars=chunk)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == resampled([(r[0], r[1]) for r in rows], target, percent, longest)


def test_resampling_of_empty_tables(spark, docs, rows, empty):
    nothing = empty.select("text")
    assert resample.resample(empty, docs.select("text")).count() == 0
    assert sorted(map(tuple, resample.resample(docs, nothing).collect()), key=str) == resampled([(r[0], r[1]) for r in rows], [], 25, 2)


def mixed(rows, most=3, block=16, seed=13):
    """Seat by seat and block by block."""
    sizes = [(r[0], r[3], len(PLAIN.findall(r[1] or ""))) for r in rows]
    names = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, s or ""))
    total, size = sum(x[2] for x in sizes), {s: sum(n for _, x, n in sizes if x == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    full = set()
    while True:  # the excess goes to the others until none is over its limit
        left, open_weight = total - sum(most * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] > most * size[s] * open_weight}
        if not over:
            break
        full |= over
    target = {s: float(most * size[s]) if s in full else weight[s] * left / open_weight for s in names}
    pieces, seen = [], Counter()
    for row in sizes:
        copy = seen[row]
        seen[row] += 1
        piece = copy // max(1, (1 << 20) // max(row[2], 256))
        h = int(hashlib.sha256(f"{seed}:{'' if row[0] is None else row[0]}:{row[2]}:{piece}".encode()).hexdigest()[:8], 16)
        pieces.append((h, row, piece, copy))
    shards = defaultdict(list)
    for h, row, piece, copy in pieces:
        n = 1 + math.isqrt(sum(x == row[1] for _, x, _ in sizes)) // 16
        shards[row[1], h % n].append((h, row[0] is not None, row[0] or 0, row[2], piece, copy, row))
    words = {k: sum(x[3] for x in v) for k, v in shards.items()}
    blocks = {k: max(1, (2 * words[k] + block) // (2 * block)) for k in shards}
    have = {s: sum(n for (x, _), n in blocks.items() if x == s) for s in names}
    votes = {s: min(math.floor(target[s]), most * block * have[s]) for s in names}

    def seats(votes, number):
        got = dict.fromkeys(votes, 0)
        for _ in range(number if any(votes.values()) else 0):
            got[max(votes, key=lambda s: votes[s] / (2 * got[s] + 1))] += 1
        return got

    got = {s: min(n, most * have[s]) for s, n in seats(votes, (2 * sum(votes.values()) + block) // (2 * block)).items()}
    out = []
    for s in names:
        mine = {k: blocks[k] for k in sorted((k for k in shards if k[0] == s), key=lambda k: k[1])}
        rest = seats(mine, got[s] % have[s])
        for k in mine:
            n, v = blocks[k], words[k]
            quota = got[s] // have[s] * n + rest[k]
            start = int(hashlib.sha256(f"{seed}:block:{names.index(s)}:{k[1]}".encode()).hexdigest()[:8], 16)
            times = [j for j in range(n) for _ in range(j * v // n, (j + 1) * v // n)]
            at = 0
            for *_, row in sorted(shards[k], key=lambda x: x[:6]):
                taken = sum(quota // n + ((j * 2147483647 + start) % n < quota % n) for j in times[at : at + row[2]])
                at += row[2]
                out.append((row[0], row[2], size[s], target[s], taken))
    return sorted(out, key=str)


def test_mixture(spark, docs, rows, empty):
    got = sorted(map(tuple, mixture.mix(docs).collect()), key=str)
    assert got == mixed(rows)
    assert all(t <= 3 * n for _, n, _, _, t in got)
    assert mixture.mix(empty).count() == 0
    nothing = mixture.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(nothing) == len(rows) and {(r.size, r.target, r.taken) for r in nothing} == {(0, 0.0, 0)}


def test_mixture_of_many_shards(spark):
    rng = random.Random(9)
    rows = [(i % 700, " ".join(["w"] * rng.randrange(0, 60)), "en", rng.choice(["big"] * 9 + ["small", None]), 0, "", "", "", "", 1) for i in range(900)]
    rows += [rows[5]] * 400
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = mixture.mix(docs)
    assert sorted(map(tuple, got.collect()), key=str) == mixed(rows)
    near = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 32 + 0.01 * r.target for r in near)


def test_seats_are_those_of_the_highest_quotients(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.choice([0, 1, 5, 5, 40, 1000]), g * 7) for g in range(12) for k in range(1 + 3 * g)]
    got = mixture.apportion(spark.createDataFrame(rows, "g int, k int, v long, s long"), ["g"], "v", "s", "k")
    found = {(r.g, r.k): r.quota for r in got.collect()}
    for g in range(12):
        want = {k: 0 for x, k, _, _ in rows if x == g}
        votes = {k: v for x, k, v, _ in rows if x == g}
        for _ in range(g * 7 if any(votes.values()) else 0):
            want[max(votes, key=lambda k: votes[k] / (2 * want[k] + 1))] += 1
        assert {k: n for (x, k), n in found.items() if x == g} == want


def test_targets_stop_at_three_times_the_source(spark):
    table = spark.createDataFrame([("a", 10), ("b", 1000), (None, 5), ("c", 1)], "source string, source_size long")
    got = {r.source: r.target for r in mixture.targets(table).collect()}
    # weights a 1, b 2, c 3, null 1: c, null and a are at their limits, b takes what is left
    assert got == {"a": 30.0, "c": 3.0, None: 15.0, "b": 1016.0 - 48}
