"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

Every source has a weight and a target, its share of all words; a target stops at
``most`` times what the source has, and the rest is shared anew. The targets become whole
blocks of about ``block`` words: blocks go, one at a time, to the source with the
highest quotient target / (2 * blocks so far + 1). Whole passes over a source come first; the
blocks that remain are dealt to its shards by the same rule, so that each shard has an integer
quota and is mixed by itself. In a shard the documents form one stream of words, in the order of
a seeded hash, cut into equal blocks; which blocks go is an arithmetic permutation with a
seeded start, so no block is ever a row. A document takes the words of its parts of chosen blocks.

Quotients near the last seat are the only ones that are ranked: seats that every source is
sure of are counted from the divisor (``apportion``). A source has one shard more for each
16 times the root of its documents, so both the shards of a source and the documents of a shard
stay few: at 3 * 10^9 documents about 3,400 shards of 880,000. Rows equal in id, source and
size give equal results, so they are counted first and dealt in pieces of bounded size.

Edge cases: a null text has size 0, and such rows take nothing; a null source is one of
its own, the last; null and repeated ids are rows like others; if there are no words at
all, targets are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbars.llm.work import copied, work_dir, written

BLANK = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 16
SEED = 13
#: Words in a piece of equal rows, and the least words that a row counts for.
PIECE, LEAST = 1 << 20, 256
#: Steps through the blocks of a shard; a prime over the number of them, so that all are met.
STRIDE = 2147483647


def first_bits(text: Column) -> Column:
    """The first 32 bits of a text's SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows equal in ``doc_id``, ``source`` and ``size`` (words), with their number ``copies``."""
    trimmed = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(BLANK))
    size = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``src`` (place by name, null last), ``weight`` and ``target`` to a table of sources with ``source_size``.

    A mix is weighed source by source, so this table is short. In order of size over weight, a source is
    at its limit if the common level, with all before it at theirs, would exceed it.
    """
    every = Window.partitionBy()
    rows = sources.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")).cast("long"))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("_full", left * F.col("weight") > most * F.col("source_size") * open_weight)
    rest = F.sum("source_size").over(every) - most * F.sum(F.when(F.col("_full"), F.col("source_size")).otherwise(F.lit(0))).over(every)
    share = (F.col("weight") * rest).cast("double") / F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(every)
    return rows.withColumn("target", F.when(F.col("_full"), (most * F.col("source_size")).cast("double")).otherwise(F.coalesce(share, F.lit(0.0)))).drop("_full")


def apportion(rows: DataFrame, group: Sequence[str], votes: str, seats: str, order: str, out: str = "quota") -> DataFrame:
    """Adds the seats that each row of a group has by the highest quotients votes / 1, 3, 5 …; of equals the first in ``order``.

    Of n rows and s seats, with the divisor of s - n/2 seats no more than s are given, with that of s + n/2
    no fewer. So the first are sure, and only the quotients between the two are ranked, about three for each row.
    """
    every = Window.partitionBy(*group)
    n, total = F.count("*").over(every), F.sum(votes).over(every)
    at = lambda k: F.floor(F.coalesce(F.try_divide(F.col(votes) * k, total), F.lit(0.0)) + 0.5)
    rows = rows.withColumn("_sure", F.greatest(at(F.greatest(F.col(seats) - n / 2, F.lit(0))) - 1, F.lit(0)).cast("long")).withColumn("_most", (at(F.col(seats) + n / 2) + 1).cast("long"))
    rows = rows.withColumn("_open", F.col(seats) - F.sum("_sure").over(every))
    asked = rows.filter((F.col("_open") > 0) & (F.col(votes) > 0)).select(*group, votes, order, "_open", F.explode(F.sequence("_sure", "_most")).alias("_k"))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col(votes) / (2 * F.col("_k") + 1)), order)
    won = asked.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= F.col("_open")).groupBy(*group, order).agg(F.count("*").alias("_won"))
    return rows.join(won, [*group, order], "left").withColumn(out, F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_sure", "_most", "_open", "_won")


def quotas(pieces: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """For each shard its source's ``source_size`` and ``target``, its ``words``, its blocks ``n_blocks`` and how many of them it gives, ``quota``.

    ``pieces`` have ``source``, ``hash``, ``size`` and ``copies``.
    """
    sources = pieces.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("source_docs"))
    sources = targets(sources, weights, most).withColumn("n_shards", 1 + F.floor(F.sqrt("source_docs") / 16))
    # `source` may be null, so the join compares it null-safe
    rows = pieces.alias("p").join(sources.select("source", "src", "n_shards").alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.*", "src", (F.col("hash") % F.col("n_shards")).alias("shard"))
    shards = rows.groupBy("src", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    shards = shards.withColumn("n_blocks", F.greatest(div(2 * F.col("words") + block, F.lit(2 * block)), F.lit(1)))
    blocks = shards.groupBy("src").agg(F.sum("n_blocks").alias("blocks"))
    sources = sources.join(blocks, "src").withColumn("votes", F.least(F.floor("target"), most * block * F.col("blocks")))
    sources = sources.withColumn("seats", div(2 * F.sum("votes").over(Window.partitionBy()) + block, F.lit(2 * block)))
    sources = apportion(sources, [], "votes", "seats", "src", "got").withColumn("got", F.least("got", most * F.col("blocks")))
    sources = sources.select("src", "source", "source_size", "target", "n_shards", div(F.col("got"), F.col("blocks")).alias("passes"), (F.col("got") % F.col("blocks")).alias("rest"))
    dealt = apportion(shards.join(sources, "src"), ["src"], "n_blocks", "rest", "shard")
    return dealt.withColumn("quota", F.col("passes") * F.col("n_blocks") + F.col("quota")).drop("passes", "rest")


def taken(rows: DataFrame, seed: int = SEED) -> Column:
    """The words that the row from ``_from`` on, of ``size`` words, has in the blocks that its shard gives."""
    n, v, start, end = F.col("n_blocks"), F.col("words"), F.col("_from"), F.col("_from") + F.col("size")
    at = lambda word: div((word + 1) * n - 1, v)  # noqa: E731  the block that holds a word
    edge = lambda j: div(j * v, n)
    chosen = lambda j: (j * STRIDE + F.col("_start")) % n < F.col("quota") % n
    part = lambda j: F.when(chosen(j), F.least(end, edge(j + 1)) - F.greatest(start, edge(j))).otherwise(F.lit(0))
    some = F.aggregate(F.sequence(at(start), at(end - 1)), F.lit(0).cast("long"), lambda a, j: a + part(j))
    return F.when(F.col("size") == 0, F.lit(0)).otherwise(div(F.col("quota"), n) * F.col("size") + some).cast("long")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED, **columns: str) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` of every document; the same on every run."""
    where = work_dir(docs.sparkSession)
    each = F.greatest(F.lit(1).cast("long"), div(F.lit(PIECE), F.greatest("size", F.lit(LEAST))))
    pieces = sized(docs, **columns).withColumn("_each", each).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("copies") - 1, F.col("_each")))))
    pieces = pieces.withColumn("copies", F.least("_each", F.col("copies") - F.col("piece") * F.col("_each"))).drop("_each")
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "piece")
    pieces = written(pieces.withColumn("hash", first_bits(key)), where, "pieces")
    dealt = written(quotas(pieces, weights, most, block), where, "quotas")
    rows = pieces.alias("p").join(dealt.select("source", "n_shards").distinct().alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.*", (F.col("hash") % F.col("n_shards")).alias("shard"))
    rows = rows.alias("r").join(dealt.alias("d"), F.col("r.source").eqNullSafe(F.col("d.source")) & (F.col("r.shard") == F.col("d.shard"))).select("r.doc_id", "r.size", "r.copies", "r.hash", "r.piece", "r.shard", "d.src", "d.source_size", "d.target", "d.words", "d.n_blocks", "d.quota")
    stream = Window.partitionBy("src", "shard").orderBy("hash", "doc_id", "size", "piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(stream), F.lit(0)))
    rows = rows.withColumn("_start", first_bits(F.concat_ws(":", F.lit(seed), F.lit("block"), "src", "shard")))
    rows = copied(rows, "copies", "_copy").withColumn("_from", F.col("_before") + F.col("_copy") * F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", taken(rows).alias("taken"))


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy, greatest(1, {PIECE} // greatest(size, {LEAST})) AS each FROM d),
p AS (SELECT *, copy // each AS piece, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || (copy // each)), 1, 8))::BIGINT AS hash FROM n),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source),
s1 AS (SELECT *, (src % 3 + 1)::BIGINT AS weight, 1 + floor(sqrt(source_docs) / 16)::BIGINT AS n_shards FROM s0),
s2 AS (SELECT *, coalesce(sum(source_size) OVER b, 0) AS sizes, coalesce(sum(weight) OVER b, 0) AS weights, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights
       FROM s1 WINDOW b AS (ORDER BY source_size::DOUBLE / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (total - {MOST} * sizes) * weight > {MOST} * source_size * (all_weights - weights) AS at_limit FROM s2),
s4 AS (SELECT *, CASE WHEN at_limit THEN ({MOST} * source_size)::DOUBLE
       ELSE coalesce((weight * (total - {MOST} * sum(CASE WHEN at_limit THEN source_size ELSE 0 END) OVER ()))::DOUBLE / nullif(sum(CASE WHEN at_limit THEN 0 ELSE weight END) OVER (), 0)::DOUBLE, 0) END AS target FROM s3),
r AS (SELECT p.*, src, hash % n_shards AS shard FROM p JOIN s4 ON p.source IS NOT DISTINCT FROM s4.source),
h AS (SELECT src, shard, sum(size)::BIGINT AS words, greatest(1, (2 * sum(size) + {BLOCK}) // {2 * BLOCK})::BIGINT AS n_blocks FROM r GROUP BY src, shard),
v AS (SELECT s4.*, blocks, least(floor(target)::BIGINT, {MOST * BLOCK} * blocks) AS votes FROM s4 JOIN (SELECT src, sum(n_blocks)::BIGINT AS blocks FROM h GROUP BY src) USING (src)),
q AS (SELECT src, row_number() OVER (ORDER BY votes::DOUBLE / (2 * k + 1) DESC, src) AS place FROM v, unnest(range(0, {2 * MOST} * blocks + 2)) AS x(k) WHERE votes > 0),
g AS (SELECT v.*, least({MOST} * blocks, coalesce(got, 0)) AS got FROM v LEFT JOIN (SELECT src, count(*) AS got FROM q WHERE place <= (SELECT (2 * sum(votes)::BIGINT + {BLOCK}) // {2 * BLOCK} FROM v) GROUP BY src) USING (src)),
u AS (SELECT h.*, source_size, target, got // blocks AS passes, got % blocks AS rest FROM h JOIN g USING (src)),
y AS (SELECT src, shard, row_number() OVER (PARTITION BY src ORDER BY n_blocks::DOUBLE / (2 * k + 1) DESC, shard) AS place, rest FROM u, unnest(range(0, n_blocks + 1)) AS x(k)),
z AS (SELECT u.*, passes * n_blocks + coalesce(won, 0) AS quota, ('0x' || substr(sha256('{SEED}:block:' || src || ':' || shard), 1, 8))::BIGINT AS start
      FROM u LEFT JOIN (SELECT src, shard, count(*) AS won FROM y WHERE place <= rest GROUP BY src, shard) USING (src, shard)),
e AS (SELECT r.doc_id, r.size, z.*, coalesce(sum(r.size) OVER (PARTITION BY r.src, r.shard ORDER BY r.hash, r.doc_id NULLS FIRST, r.size, r.piece, r.copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
      FROM r JOIN z USING (src, shard))
SELECT doc_id, size, source_size, target, (CASE WHEN size = 0 THEN 0 ELSE (quota // n_blocks) * size + list_sum(list_transform(range(((a + 1) * n_blocks - 1) // words, ((a + size) * n_blocks - 1) // words + 1),
       lambda j: CASE WHEN (j * {STRIDE} + start) % n_blocks < quota % n_blocks THEN least(a + size, (j + 1) * words // n_blocks) - greatest(a, j * words // n_blocks) ELSE 0 END)) END)::BIGINT AS taken
FROM e
"""
