"""How filters that run one after another overlap, over all orders of them.

A document fails some of the filters, and that set alone says what happens to it in
every order. So documents are first counted by part, set and labels; the counts then
go to the edges of the lattice of filter sets: an edge is (filters already applied,
next filter), of which five filters have 80. The steps of all orders, 600, are edges of paths
through that lattice, so they are joined to the summed edges, and no document is
looked at once more.

Whether a text is a copy is settled on digests of 256 bits: documents with equal digests
are counted by part and label before they meet, so a text that a third of the corpus
shares is a few rows.

Edge cases: a null text counts as empty; a null part is the empty string; a null id is neither
smaller than another nor larger, so it never makes nor is a copy; rows that repeat an
id with the same text are no copies of each other; of an id with several labels any one
counts; documents without labels are neither good nor toxic; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairbars.llm.work import work_dir, written

BLANK = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def default_filters() -> dict[str, Column]:
    """What fails each filter, over the columns of ``counted``."""
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_upper") > 3 * F.col("n_chars"),
        "D": F.col("has_symbol"),
    }


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id``, ``part``, ``digest`` and the counts that the filters use."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(BLANK))
    rows = text.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)))
    counts = F.struct(
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("n_upper"),
        F.length("text").alias("n_chars"),
        F.col("text").rlike("[#$%&*|]").alias("has_symbol"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    # a generator, so that each count is made once whatever the filters ask
    return rows.select("doc_id", "part", F.inline(F.array(counts)))


def outcomes(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, **columns: str) -> DataFrame:
    """Documents ``n`` by ``part``, set of filters that they fail (``failed``, a bit for each), ``good`` and ``toxic``.

    The last bit is that of the copies: documents whose text a smaller id has.
    """
    filters = default_filters() if filters is None else filters
    bits = F.lit(0)
    for i, fails in enumerate(filters.values()):
        bits = bits + F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    rows = counted(docs, **columns).select("doc_id", "part", "digest", bits.alias("failed"))
    rows = rows.groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("n"))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    known = F.col("doc_id").isNotNull()
    cell = ["part", "failed", "good", "toxic"]
    texts = rows.groupBy("digest", *cell).agg(F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unknown"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"))
    # written, so that both sides of the join are read from it and a text that many parts share can be split
    texts = written(texts, work_dir(docs.sparkSession), "texts")
    first = texts.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"))
    own = F.col("unknown") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(F.lit(0))
    copy = 1 << len(filters)
    both = F.array(F.struct(F.col("failed"), own.alias("n")), F.struct((F.col("failed") + copy).alias("failed"), (F.col("n") - own).alias("n")))
    split = texts.join(first, "digest").select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    return split.groupBy(*cell).agg(F.sum("n").alias("n"))


def edges(cells: DataFrame, n_filters: int) -> DataFrame:
    """Counts of each ``part`` on each edge: filters applied before (``subset``) and the next (``filter``)."""
    every = [(s, f) for s in range(1 << n_filters) for f in range(n_filters) if not s >> f & 1]
    rows = cells.withColumn("edge", F.explode(F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(f).alias("filter")) for s, f in every])))
    reached = F.col("failed").bitwiseAND(F.col("edge.subset")) == 0
    bit = F.call_function("shiftleft", F.lit(1), F.col("edge.filter"))
    fails = F.col("failed").bitwiseAND(bit) != 0
    gone = reached & fails
    when = {"kept": reached & ~fails, "removed": gone, "redundant": ~reached & fails, "unique_fails": F.col("failed") == bit, "good_lost": gone & (F.col("good") == 1), "toxic_lost": gone & (F.col("toxic") == 1)}
    return rows.groupBy("part", "edge.subset", "edge.filter").agg(*[F.sum(F.when(when[c], F.col("n")).otherwise(F.lit(0))).cast("long").alias(c) for c in COUNTS])


def paths(spark: SparkSession, letters: str) -> DataFrame:
    """``filter_order``, ``step`` and the edge of every step of every order: as many rows as the number of filters decides."""
    rows = []
    for order in permutations(range(len(letters))):
        subset = 0
        for step, f in enumerate(order):
            rows.append(("".join(letters[i] for i in order), step + 1, subset, f))
            subset |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, subset int, filter int")


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, copies: str = "E", **columns: str) -> DataFrame:
    """A row for each part, order and step; ``shapley`` is what a step's filter removes, over all orders."""
    filters = default_filters() if filters is None else filters
    letters = "".join(filters) + copies
    summed = edges(outcomes(docs, labels, filters, **columns), len(letters))
    rows = summed.join(paths(docs.sparkSession, letters), ["subset", "filter"])
    # a window holds the orders of one part and filter, whatever the number of documents
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return rows.select("part", "filter_order", "step", *COUNTS, shapley.alias("shapley"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS smallest FROM d),
f AS (SELECT part, doc_id, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
             100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > smallest, false) AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
      FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (SELECT [p.letter, q.letter, r.letter, s.letter, t.letter] AS letters, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
      FROM k p, k q, k r, k s, k t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
g AS (SELECT array_to_string(letters, '') AS filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, range(1, 6) AS x(i)),
x AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN failed & before = 0 AND failed & bit = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN failed & before <> 0 AND failed & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN failed = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
      FROM m, g GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x
"""
