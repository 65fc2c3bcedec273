"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides keep the smallest k-gram hash of every sliding window of
``WINDOW - K + 1`` k-grams, that is of ``WINDOW`` words. A span of that many words
which both sides share so leaves the same hash on both, and no such span is
missed. Documents and items are joined on these fingerprints, then each match is
extended word by word to both sides; it is a hit if it reaches ``WINDOW`` words.
Items of fewer words are one window each: their fingerprint is the whole item.

The benchmark's fingerprints are broadcast while they are few (counted first). A text
then is read once for all its matches: places whose hash passes a sieve of bits and is
the smallest of a window go on with the words about them, and meet the benchmark
there, so no text is shuffled. Beyond ``BROADCAST_ROWS`` fingerprints are joined by a
shuffle, and so are the texts that hold some.

Edge cases: null and empty texts have no words, so no hits, and an item without
words is never hit; a null item_id can hit but is not listed; repeated items and
documents count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbars.llm.work import work_dir, written

WINDOW = 13
K = 8
BROADCAST_ROWS = 200_000
#: Bits of the sieve; it lets through one place in five that doesn't match, at most.
SIEVE = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# what no word holds, once ASCII letters are in lower case
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z in lower case; ``lower`` does the same as long as all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, BETWEEN), "")


def _grams(hashes: str, k: int) -> Column:
    """A hash for each run of k words, from the hashes of the words."""
    if k == 1:
        return F.col(hashes)
    run = F.transform(hashes, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)]))
    return F.slice(run, 1, F.greatest(F.size(hashes) - (k - 1), F.lit(0)))


def _smallest(grams: str, width: int) -> Column:
    """The smallest hash of each window of that many grams."""
    least = F.transform(grams, lambda x, i: F.least(x, *[F.get(grams, i + j) for j in range(1, width)]))
    return F.slice(least, 1, F.greatest(F.size(grams) - (width - 1), F.lit(0)))


def _length(kind: int) -> int:
    """Words of a fingerprint. Kind 0 is winnowed; kind m is an item of m words, whole."""
    return kind or K


def _reach(kind: int) -> int:
    """Words to each side that a match may have to be extended by."""
    return 0 if kind else WINDOW - K


def _places(kind: int, wanted: str | None) -> Column:
    """(fp, p, about): hash, place, and the words from ``_reach`` before to ``_reach`` after, for the grams of wanted hashes or all."""
    placed = F.transform("grams", lambda x, i: F.struct(x.alias("fp"), i.alias("p")))
    if wanted:
        placed = F.filter(placed, lambda s: F.array_contains(wanted, s["fp"]))
    return F.transform(placed, lambda s: F.struct(s["fp"].alias("fp"), s["p"].alias("p"), _about(kind, s["p"]).alias("about")))


def _about(kind: int, p: Column) -> Column:
    """The words from ``_reach`` before a place to ``_reach`` after its fingerprint."""
    return F.transform(F.sequence(F.lit(-_reach(kind)), F.lit(_length(kind) + _reach(kind) - 1)), lambda j: F.get("words", p + j))


def _run(holds: Callable[[int], Column], most: int) -> Column:
    """How many of ``holds(1)``, ``holds(2)`` … are true before the first that is not."""
    out = F.when(F.lit(False), F.lit(0))
    for j in range(most):
        out = out.when(~F.coalesce(holds(j + 1), F.lit(False)), F.lit(j))
    return out.otherwise(F.lit(most))


def _extended() -> tuple[Column, Column]:
    """The words [a, b) of a match, extended to both sides if it is winnowed; null if the words differ."""
    reach = _reach(0)
    same = lambda j: F.get("about", F.lit(j)) == F.get("item_about", F.lit(j))
    core = F.slice("about", reach + 1, K) == F.slice("item_about", reach + 1, K)
    whole = F.when(F.col("about") == F.col("item_about"), F.col("p"))
    a = F.when(core, F.col("p") - _run(lambda j: same(reach - j), reach))
    b = F.when(core, F.col("p") + K + _run(lambda j: same(reach + K - 1 + j), reach))
    winnowed = F.col("kind") == 0
    return F.when(winnowed, a).otherwise(whole), F.when(winnowed, b).otherwise(whole + F.col("kind"))


def _sieve(marks: DataFrame) -> Callable[[Column], Column]:
    """Whether a hash may be one of those marked: a bit for each, ``SIEVE`` bits for all in one literal."""
    bit = F.col("fp").bitwiseAND(F.lit(SIEVE - 1))
    rows = marks.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    bits = ["0"] * (SIEVE // 64)
    for r in rows.collect():  # at most SIEVE / 64 rows
        bits[r["at"]] = str(r["bits"])
    held = F.split(F.lit(",".join(bits)), ",").cast("array<bigint>")

    def passes(fp: Column) -> Column:
        low = fp.bitwiseAND(F.lit(SIEVE - 1))
        return F.call_function("shiftrightunsigned", F.get(held, F.shiftright(low, 6).cast("int")), low.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return passes


def _in_place(texts: DataFrame, marks: DataFrame, kinds: list[int]) -> DataFrame:
    """Places of the texts that share a fingerprint with the few ``marks``, in one narrow pass."""
    passes = _sieve(marks)
    rows = texts.select("key", words_of(F.col("text")).alias("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumns({f"grams{kind}": _grams("hashes", _length(kind)) for kind in kinds})

    def places(kind: int) -> Column:
        grams = f"grams{kind}"

        def chosen(s: Column) -> Column:
            if kind:
                return passes(s["fp"])
            # the smallest of a window: the run of grams about it that are not smaller is as long as one
            before = _run(lambda j: F.get(grams, s["p"] - j) >= s["fp"], WINDOW - K)
            after = _run(lambda j: F.get(grams, s["p"] + j) >= s["fp"], WINDOW - K)
            return passes(s["fp"]) & (before + after >= WINDOW - K)

        placed = F.filter(F.transform(grams, lambda x, i: F.struct(x.alias("fp"), i.alias("p"))), chosen)
        return F.transform(placed, lambda s: F.struct(F.lit(kind).alias("kind"), s["fp"].alias("fp"), s["p"].alias("p"), _about(kind, s["p"]).alias("about")))

    return rows.select("key", F.inline(F.concat(*map(places, kinds)))).join(F.broadcast(marks), ["kind", "fp"])


def _by_shuffle(texts: DataFrame, marks: DataFrame, kinds: list[int], where: str) -> DataFrame:
    """The same for any number of ``marks``: texts that share a fingerprint are found first, then one of each is read for its places."""
    hashes = texts.select("key", words_of(F.col("text")).alias("words")).select("key", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    parts = []
    for kind in kinds:
        grams = hashes.select("key", _grams("hashes", _length(kind)).alias("grams"))
        if not kind:
            grams = grams.select("key", _smallest("grams", WINDOW - K + 1).alias("grams"))
        own = marks.filter(F.col("kind") == kind).select("fp").distinct()
        parts.append(grams.select("key", F.explode(F.array_distinct("grams")).alias("fp")).join(own, "fp").select("key", F.lit(kind).alias("kind"), "fp"))
    # for each text at most as many as the benchmark has
    found = _union(parts).groupBy("key").agg(F.collect_set(F.struct("kind", "fp")).alias("fps"))
    found = written(found, where, "found")

    # one text of each key, chosen before the shuffle; what is found grows with the documents, so it is never broadcast
    once = texts.select("key", "text").dropDuplicates(["key"])
    hit = once.join(found.hint("merge"), "key").select("key", "fps", words_of(F.col("text")).alias("words"))
    hit = hit.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    parts = []
    for kind in kinds:
        part = hit.withColumn("grams", _grams("hashes", _length(kind))).withColumn("wanted", _of_kind(kind))
        part = part.select("key", F.lit(kind).alias("kind"), F.inline(_places(kind, "wanted")))
        parts.append(part.join(marks.filter(F.col("kind") == kind), ["kind", "fp"]))
    return _union(parts)


def entries(items: DataFrame) -> DataFrame:
    """Fingerprints of the items: ``kind``, ``fp``, ``item_id``, and the item's words about the place."""
    rows = items.select("item_id", words_of(F.col("text")).alias("words"))
    rows = rows.select("item_id", F.inline(F.array(F.struct("words", F.size("words").alias("n"))))).filter("n > 0")
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    parts = []
    for kind in range(WINDOW):
        own = rows.filter(F.col("n") == kind if kind else F.col("n") >= WINDOW).withColumn("grams", _grams("hashes", _length(kind)))
        if not kind:
            own = own.withColumn("kept", F.array_distinct(_smallest("grams", WINDOW - K + 1)))
        parts.append(own.select("item_id", F.lit(kind).alias("kind"), F.inline(_places(kind, None if kind else "kept"))))
    all_parts = parts[0]
    for part in parts[1:]:
        all_parts = all_parts.unionByName(part)
    return all_parts.select("item_id", "kind", "fp", F.col("about").alias("item_about")).distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20) -> DataFrame:
    """How much of every document lies in windows of the items.

    Returns ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``item_ids`` (sorted
    strings) and ``contaminated`` (hit, and one word in ``share`` at least), for
    every row of ``docs``.
    """
    spark = docs.sparkSession
    where = work_dir(spark)
    marks = written(entries(items), where, "entries")
    kinds = sorted(r.kind for r in marks.select("kind").distinct().collect())  # at most WINDOW numbers
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("key"))
    if not kinds:
        return texts.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), *_no_hits())

    few = marks.count() <= BROADCAST_ROWS
    shared = _in_place(texts, marks, kinds) if few else _by_shuffle(texts, marks, kinds, where)
    a, b = _extended()
    matches = shared.select("key", "item_id", "kind", a.alias("a"), b.alias("b"))
    matches = matches.filter(F.col("b") - F.col("a") >= F.when(F.col("kind") == 0, WINDOW).otherwise(F.col("kind")))
    spans = matches.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda x, s: F.struct((x["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], x["end"]))).alias("n"), F.greatest(x["end"], s["b"]).alias("end")),
        lambda x: x["n"],
    )
    spans = written(spans.select("key", covered.cast("long").alias("n_hit"), "item_ids"), where, "spans")

    counts = texts.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return counts.join(spans, "key", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def uncontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", share: int = 20) -> DataFrame:
    """``docs`` without the rows whose text is contaminated, whatever their id; null texts stay."""
    mark = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    found = contamination(docs.select(mark.alias("_mark"), text_col), items, "_mark", text_col, share).filter("contaminated").select(F.col("doc_id").alias("_gone")).distinct()
    found = written(found, work_dir(docs.sparkSession), "contaminated")
    return docs.join(found.hint("merge"), mark == found["_gone"], "left_anti")


def _of_kind(kind: int) -> Column:
    return F.transform(F.filter("fps", lambda s: s["kind"] == kind), lambda s: s["fp"])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _no_hits() -> list[Column]:
    zero = F.lit(0).cast("long")
    return [zero.alias("n_hit"), zero.alias("n_items"), F.array().cast("array<string>").alias("item_ids"), F.lit(False).alias("contaminated")]


def digests(found: DataFrame) -> DataFrame:
    """The item ids as one digest."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
       FROM (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
       FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM t, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
h AS (SELECT r, i, m, item_id FROM dw JOIN bw USING (m, win)),
n AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, m FROM h), range(13) AS x(k) WHERE k < m GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
      FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM t LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""
