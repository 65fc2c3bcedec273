"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Counts of every whole text come first, since they are results themselves. The
rules are boolean expressions over the counts and the text. On a bounded sample
each rule's cost (time on the sample repeated some times, above that of an empty
rule) and the rows it rejects are measured; the next rule of the chain is the one
with the most rejections per cost among the rows that the rules before it leave. The
chain is one ``CASE WHEN``, which stops at the first rule that rejects. The order
changes the time, never the verdict.

Edge cases: a null text counts as one without words, which fails; a text without
line ends is one line; lines of white space are no lines; repeated rows give
equal rows; of an empty sample the rules keep the order in which they are given.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbars.llm.work import with_text, work_dir, written

BLANK = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"
WINDOW = 5
SAMPLE_ROWS = 2_000
#: How often each sample row is judged in a timed run, and timed runs of a rule; the shortest counts.
COPIES, RUNS = 8, 3
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects the rows where ``fails`` is true; null counts as false."""

    name: str
    fails: Column


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and the counts that the rules use.

    Repeated windows are found on hashes of the windows: only texts in which two
    are equal sort them, by hash and place.
    """
    text = with_text(docs, id_col, text_col)
    trimmed = F.btrim("text", F.lit(BLANK))
    rows = text.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    window = lambda x, i: F.xxhash64(x, *[F.get("hashes", i + k) for k in range(1, WINDOW)])
    rows = rows.withColumn("windows", F.slice(F.transform("hashes", window), 1, F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))))
    placed = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))
    again = lambda s, i: F.when((F.get("placed", i - 1)["x"] == s["x"]) | (F.get("placed", i + 1)["x"] == s["x"]), s["i"])
    rows = rows.withColumn("again", F.sort_array(F.filter(F.transform("placed", again), lambda i: i.isNotNull())))
    new = lambda p, i: F.coalesce(F.least(F.get("again", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
    repeated = F.when(F.size("again") > 0, F.aggregate(F.transform("again", new), F.lit(0), lambda a, b: a + b))
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != "")
    symbols = F.when(F.col("text").rlike(f"[{SYMBOLS}]"), F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")))
    long = lambda c, name: F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(name)
    rows = rows.withColumn("lines", lines)
    counts = F.struct(
        long(F.size("words"), "n_words"),
        long(F.length(F.array_join("words", "")), "word_chars"),
        long(symbols, "n_symbols"),
        long(F.size("lines"), "n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(repeated, "n_repeat_words"),
    )
    # a generator keeps later filters on the counts from being pushed into the functions above, which would then run for each element
    return rows.select("doc_id", "text", F.inline(F.array(counts)))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules() -> list[Rule]:
    n = F.col("n_words")
    many = lambda kept: F.length(F.regexp_replace("text", kept, ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("copied_lines", (2 * F.col("n_dup_lines") > F.col("n_lines")) & (F.col("n_lines") > 3)),
        Rule("short_words", F.col("word_chars") < 2 * n),
        Rule("long_words", F.col("word_chars") > 20 * n),
        Rule("shouting", 2 * many("[^A-Z]+") > F.col("word_chars")),
        Rule("exclaiming", 2 * many("[^!]+") > n),
        Rule("no_letters", 10 * many("[0-9\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+") < 4 * F.col("word_chars")),
    ]


def costs(rules: Sequence[Rule], sample: DataFrame, copies: int = COPIES, runs: int = RUNS) -> list[float]:
    """The seconds that each rule takes on the repeated sample, above an empty rule; whole powers of two.

    A first run of each compiles. Differences below a twentieth of the dearest rule are noise and count as that much.
    """
    many = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

    def timed(fails: Column) -> float:
        took = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            many.agg(F.sum(F.coalesce(fails, F.lit(False)).cast("int"))).first()
            took.append(time.perf_counter() - start)
        return min(took[1:])

    empty = timed(F.lit(False))
    found = [timed(rule.fails) - empty for rule in rules]
    least = max([1e-3, *(x / 20 for x in found)])
    return [2.0 ** round(math.log2(max(x, least))) for x in found]


def patterns(rules: Sequence[Rule], sample: DataFrame) -> list[tuple[tuple[bool, ...], int]]:
    """Which rules reject together, and how many sample rows."""
    fails = [F.coalesce(rule.fails, F.lit(False)).alias(f"r{i}") for i, rule in enumerate(rules)]
    return [(tuple(r[:-1]), r[-1]) for r in sample.select(*fails).groupBy(*[f"r{i}" for i in range(len(rules))]).agg(F.count("*").alias("n")).collect()]


def chain(cost: Sequence[float], found: Sequence[tuple[tuple[bool, ...], int]]) -> list[int]:
    """The order of the rules: always the most rejections per cost of what is left; of equals the cheaper, then the first given."""
    order: list[int] = []
    while len(order) < len(cost):
        left = [(p, n) for p, n in found if not any(p[i] for i in order)]
        rest = [i for i in range(len(cost)) if i not in order]
        order.append(min(rest, key=lambda i: (-sum(n for p, n in left if p[i]) / cost[i], cost[i], i)))
    return order


def ordered(rules: Sequence[Rule], sample: DataFrame) -> list[Rule]:
    """The rules by measured rejections per cost on the sample."""
    found = patterns(rules, sample)
    return [rules[i] for i in chain(costs(rules, sample), found)] if found else list(rules)


def cascade(rules: Sequence[Rule]) -> Column:
    """True unless a rule rejects; later rules are not evaluated."""
    verdict = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        verdict = verdict.when(rule.fails, F.lit(False))
    return verdict.otherwise(F.lit(True))


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows`` different documents, those with the smallest hashes of id and text, whatever ids are null or repeated."""
    keyed = with_text(docs, id_col, text_col).withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = keyed.select("h").distinct().orderBy("h").limit(rows)
    # equal rows are one already within each task
    return keyed.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).select("doc_id", "text")


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row. A narrow map apart from the sample."""
    rules = default_rules() if rules is None else rules
    # the documents are read by many tasks, their few sample rows then meet in one file
    sample = written(counted(sampled(docs, sample_rows, id_col, text_col)).repartition(1), work_dir(docs.sparkSession), "sample")
    order = ordered(rules, sample.filter(~base_failed()))
    rows = counted(docs, id_col, text_col).withColumn("base_failed", base_failed())
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order)).alias("kept"))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
g AS (SELECT r, i, word || ' ' || lead(word, 1) OVER q || ' ' || lead(word, 2) OVER q || ' ' || lead(word, 3) OVER q || ' ' || lead(word, 4) OVER q AS five
      FROM p WINDOW q AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, five FROM g WHERE five IS NOT NULL GROUP BY r, five HAVING count(*) > 1),
e AS (SELECT r, count(DISTINCT i + k) AS n FROM g JOIN f USING (r, five), range(5) AS x(k) GROUP BY r),
c AS (SELECT w.r, doc_id, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(e.n, 0) AS n_repeat_words
      FROM w LEFT JOIN e ON e.r = w.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR (2 * n_dup_lines > n_lines AND n_lines > 3)
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > word_chars
            OR 2 * length(regexp_replace(text, '[^!]+', '', 'g')) > n_words
            OR 10 * length(regexp_replace(text, '[0-9\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) < 4 * word_chars) AS kept
FROM b
"""
