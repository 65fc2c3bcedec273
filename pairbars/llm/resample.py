"""Importance resampling of documents towards the word statistics of a target set.

Each task runs DuckDB over its partition: SQL splits texts into words, unnests
them, makes n-grams with a window, and a registered zlib function gives each its bucket.
What a partition yields is spilled to Parquet: the buckets of each document and the
counts of each bucket, summed over the partition. Spark merges the counts of corpus and
target to one gain for each bucket, a table as long as there are buckets, and
scores the documents from their spilled buckets, so texts are split once.

A draw takes the highest scores, each a weight with seeded Gumbel noise, so a document's chance
follows the exponential of its weight. A histogram of scores, whole numbers, gives the place of
every score; only documents of one score are then put in order by id. Rows equal in all
results are counted first.

Memory of a task: texts go to DuckDB about ``CHUNK_CHARS`` characters at a time. A longer text is
cut between words, with the words before a cut sent again so that no n-gram is lost.

Edge cases: a null text has no features and weight 0; a null id counts as an empty one
in the noise and comes last among ties; repeated rows are drawn separately; an
empty target gives gains against none; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, ShortType, StructField, StructType

from pairbars.llm.work import CHUNK_CHARS, copied, work_dir, written

BUCKETS = 10_000
LONGEST = 2
SEED = 7
PERCENT = 25
LEAST_WORDS = 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII that is neither a letter nor a digit stands between words.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
MEMORY = "400MB"


def zlib_crc32(grams: pa.Array) -> pa.Array:
    """CRC-32 of each string's UTF-8 bytes."""
    grams = grams.combine_chunks() if isinstance(grams, pa.ChunkedArray) else grams
    _, offsets, data = grams.cast(pa.string()).buffers()
    ends = np.frombuffer(offsets, np.int32)[grams.offset : grams.offset + len(grams) + 1].tolist()
    raw = data.to_pybytes() if data else b""
    return pa.array(np.fromiter((zlib.crc32(raw[a:b]) for a, b in pairwise(ends)), np.uint32, len(grams)))


def grams_sql(longest: int, buckets: int) -> str:
    """Buckets of the n-grams of ``pieces`` (row, piece, carried, text); the first ``carried`` words belong to the piece before."""
    later = ", ".join(f"lead(word, {k}) OVER w AS w{k}" for k in range(1, longest)) or "NULL AS w1"
    parts = [f"SELECT row, {n} AS n, " + " || ' ' || ".join(["word", *[f"w{k}" for k in range(1, n)]]) + f" AS gram FROM placed WHERE i + {n - 1} > carried" + (f" AND w{n - 1} IS NOT NULL" if n > 1 else "") for n in range(1, longest + 1)]
    return f"""
        WITH split AS (SELECT row, piece, carried, list_filter(string_split(translate(text, getvariable('from_chars'), getvariable('to_chars')), ' '), lambda x: x <> '') AS words FROM pieces),
        placed AS (SELECT row, carried, i, word, {later} FROM (SELECT row, piece, carried, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split) WINDOW w AS (PARTITION BY piece ORDER BY i)),
        grams AS ({' UNION ALL '.join(parts)})
        SELECT row, n, (zlib_crc32(gram) % {buckets})::SMALLINT AS bucket FROM grams"""


def cut(text: str, size: int, keep: int) -> Iterator[tuple[int, str]]:
    """A text in pieces of about ``size`` characters, cut between words, each with the last ``keep`` words before it and how many those are."""
    start, tail = 0, []
    while start < len(text) or start == 0:
        end = start + size
        if end < len(text):
            found = re.compile(f"[{re.escape(BETWEEN)}]").search(text, end)
            end = found.start() if found else len(text)
        piece = " ".join([*tail, text[start:end]])
        yield len(tail), piece
        start = max(end, 1)
        if keep and start < len(text):
            tail = WORD.findall(piece)[-keep:]


def featurized(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Of each document ``doc_id``, ``n_words``, ``n_features`` and the ``buckets`` of its n-grams; besides, rows ``bucket`` and ``n`` with each partition's counts."""
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("doc_id", kind), StructField("n_words", LongType()), StructField("n_features", LongType()), StructField("buckets", ArrayType(ShortType())), StructField("bucket", IntegerType()), StructField("n", LongType())])
    query = grams_sql(longest, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        con.create_function("zlib_crc32", zlib_crc32, ["VARCHAR"], "UINTEGER", type="arrow")
        con.execute("SET VARIABLE from_chars = $1", [UPPER + BETWEEN])
        con.execute("SET VARIABLE to_chars = $1", [UPPER.lower() + " " * len(BETWEEN)])
        con.execute("CREATE TABLE totals (bucket SMALLINT, n BIGINT)")

        def flushed(rows: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            row, carried, text = zip(*rows, strict=True)
            pieces = pa.table({"row": pa.array(row, pa.int64()), "piece": pa.array(range(len(rows)), pa.int64()), "carried": pa.array(carried, pa.int64()), "text": pa.array(text, pa.string())})
            con.register("pieces", pieces)
            con.execute(f"CREATE OR REPLACE TEMP TABLE hashed AS {query}")
            con.execute("INSERT INTO totals SELECT bucket, count(*) FROM hashed GROUP BY bucket")
            found = con.sql("SELECT row, count(*) AS n, count(*) FILTER (n = 1) AS words, list(bucket) AS buckets FROM hashed GROUP BY row ORDER BY row").to_arrow_table().combine_chunks()
            con.unregister("pieces")
            flat = found["buckets"].combine_chunks().flatten() if len(found) else pa.array([], pa.int16())
            return found["row"].to_numpy(), found["n"].to_numpy(), found["words"].to_numpy(), flat.to_numpy()

        for batch in batches:
            size = batch.num_rows
            features, words, flat = np.zeros(size, np.int64), np.zeros(size, np.int64), []

            def add(rows: list[tuple[int, int, str]], features: np.ndarray = features, words: np.ndarray = words, flat: list[np.ndarray] = flat) -> None:
                at, n, w, values = flushed(rows)
                features[at] += n
                words[at] += w
                flat.append(values)

            waiting, chars = [], 0
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                for carried, piece in cut(text, chunk_chars, longest - 1) if text else ():
                    waiting.append((i, carried, piece))
                    chars += len(piece)
                    if chars >= chunk_chars:
                        add(waiting)
                        waiting, chars = [], 0
            if waiting:
                add(waiting)
            ends = np.concatenate([[0], np.cumsum(features)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int16), *flat]).astype(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(features), lists, pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64())], names=schema.names)
        summed = con.sql("SELECT bucket::INTEGER AS bucket, sum(n)::BIGINT AS n FROM totals GROUP BY bucket").to_arrow_table().combine_chunks()
        con.close()
        size = len(summed)
        if size:
            none = [pa.nulls(size, f.type) for f in pa_schema]
            yield pa.RecordBatch.from_arrays([*none, summed["bucket"].chunk(0), summed["n"].chunk(0)], names=schema.names)

    pa_schema = [pa.field("doc_id", to_arrow_type(kind)), pa.field("n_words", pa.int64()), pa.field("n_features", pa.int64()), pa.field("buckets", pa.list_(pa.int16()))]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def bucket_counts(features: DataFrame) -> DataFrame:
    """``bucket`` and ``n`` of a whole table: the partitions' counts merged."""
    return features.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``gain``: how much commoner a bucket is in the target, in thousandths of a logarithm; a row for every bucket."""
    rows = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    every = Window.partitionBy()  # over a row for each bucket
    above = (F.col("t") + 1).cast("double") * (F.sum("s").over(every) + buckets)
    below = (F.col("s") + 1).cast("double") * (F.sum("t").over(every) + buckets)
    return rows.select("bucket", F.floor(1000 * F.log(above / below)).alias("gain"))


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def weighed(features: DataFrame, table: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of each document."""
    # one array as long as there are buckets
    by_bucket = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains")).scalar()
    rows = features.filter("bucket is null").select("doc_id", "n_words", "n_features", "buckets", by_bucket.alias("gains"))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get("gains", b.cast("int")))
    weight = F.when(F.col("n_features") == 0, 0).otherwise(F.floor(total / F.col("n_features"))).cast("long")
    return rows.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank``, from 1, to that share of the rows of enough words with the highest scores; null for the others."""
    columns = scored.columns
    rows = scored.groupBy(*columns).agg(F.count("*").alias("copies"))
    rows = written(rows.withColumn("eligible", F.col("n_words") >= least_words), work_dir(scored.sparkSession), "scored")
    hist = rows.filter("eligible").groupBy("score").agg(F.sum("copies").alias("n"))
    # a row for each score; scores are thousandths of logarithms, some ten thousand whatever the corpus
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    hist = hist.select("score", F.coalesce(above, F.lit(0)).alias("above"), F.call_function("div", percent * F.sum("n").over(Window.partitionBy()), F.lit(100)).alias("wanted")).filter("above < wanted")
    rows = rows.join(hist.withColumn("eligible", F.lit(True)), ["score", "eligible"], "left")
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), *[c for c in columns if c not in ("doc_id", "score")]).rowsBetween(Window.unboundedPreceding, -1)
    high = rows.filter("wanted is not null").withColumn("_first", F.col("above") + F.coalesce(F.sum("copies").over(inside), F.lit(0)) + 1)
    low = rows.filter("wanted is null").withColumn("_first", F.lit(None).cast("long"))
    out = copied(high.unionByName(low), "copies", "_copy").withColumn("_rank", F.col("_first") + F.col("_copy"))
    return out.select(*columns, F.when(F.col("_rank") <= F.col("wanted"), F.col("_rank")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Weight, score and rank of every document by the statistics of the target's texts."""
    where = work_dir(docs.sparkSession)
    features = written(featurized(docs, longest, buckets, id_col, text_col, chunk_chars), where, "features")
    wanted = target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text"))
    wanted = written(bucket_counts(featurized(wanted, longest, buckets, chunk_chars=chunk_chars)), where, "target")
    table = written(gains(written(bucket_counts(features), where, "corpus"), wanted, buckets), where, "gains")
    return drawn(weighed(features, table, seed), percent, least_words)


def _crc_steps() -> str:
    """The 16 remainders of four bits, for the SQL."""
    found = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        found.append(f"{value}::UINTEGER")
    return f"[{', '.join(found)}]"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CRC-32 of a word or pair is worked out from the hexadecimal digits of its bytes, the lower digit of each byte first.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, 0 AS side, doc_id, {_WORDS} AS words FROM documents
           UNION ALL SELECT row_number() OVER () AS r, 1, NULL, {_WORDS} FROM benchmark),
u AS (SELECT side, r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT side, r, word AS gram FROM u UNION ALL
      SELECT side, r, gram FROM (SELECT side, r, word || ' ' || lead(word) OVER (PARTITION BY side, r ORDER BY i) AS gram FROM u) WHERE gram IS NOT NULL),
h AS (SELECT gram, (xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(range(2 * octet_length(encode(gram))), lambda k: ('0x' || substr(hex(encode(gram)), (k + (CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END))::INT, 1))::UINTEGER)),
        lambda c, x: xor(c >> 4, t[(xor(c, x) & 15)::INT + 1])), 4294967295::UINTEGER) % 10000)::INT AS bucket
      FROM (SELECT DISTINCT gram FROM g), (SELECT {_crc_steps()} AS t)),
n AS (SELECT side, r, bucket, count(*) AS n FROM g JOIN h USING (gram) GROUP BY ALL),
c AS (SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS t FROM n GROUP BY bucket),
a AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
w AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM n JOIN a USING (bucket) WHERE side = 0 GROUP BY r),
s AS (SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r) WHERE side = 0),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS many FROM x)
SELECT doc_id, n_words::BIGINT AS n_words, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, (CASE WHEN n_words >= 20 AND place <= 25 * many // 100 THEN place END)::BIGINT AS rank FROM k
"""
