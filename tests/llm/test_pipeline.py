"""Each stage of the pipeline, and all of it, on small tables with awkward rows."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from pairbars.llm import pii, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and then what there being only once more than every other place time".split()


def passage(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [passage(rng, 20), passage(rng, 30), "short item only", None]
    good = [passage(rng, rng.randrange(30, 80)) + "." for _ in range(120)]
    bad = [passage(rng, 30).upper().replace(" ", "!! ") for _ in range(60)]
    texts = good + bad
    texts += [None, "", "  ", good[0], good[0], passage(rng, 6000) + ".", passage(rng, 12) + " " + items[0] + " " + passage(rng, 12), items[1], f"{passage(rng, 15)} write to joe.{rng.randrange(9)}@mail.example.org or +1 555 010 9999 {passage(rng, 15)}."]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[1], (None, good[2], "en", "s", 1), (None, items[1], None, None, None), (None, passage(rng, 40) + ".", "en", None, 5)]
    labels = [(i, int(i < len(good)), 0) for i in range(len(good) + len(bad))]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, items


def read(spark, at):
    return spark.read.parquet(f"{at}/documents.parquet")


def clashing(docs):
    """With extra columns of names that the stages use themselves."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("clash").alias(c) for c in ("ids", "fp", "_mark", "_gone", "_id", "_rows", "key", "h", "row", "score", "spans", "n_tokens")])


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_stage_of_an_empty_table(spark, tables, name):
    none = spark.createDataFrame([], SCHEMA)
    out = dict(pipeline.STAGES)[name](spark, none, tables[0])
    assert out.count() == 0
    if name != "bpe":
        assert out.columns == pipeline.COLUMNS


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_stage_with_clashing_names(spark, tables, name):
    docs, stage = read(spark, tables[0]), dict(pipeline.STAGES)[name]
    rows = lambda df: sorted(map(str, df.select(stage_columns).collect()))
    plain = stage(spark, docs, tables[0])
    stage_columns = [c for c in plain.columns]
    assert rows(plain) == rows(stage(spark, clashing(docs), tables[0]))


def test_quality_stage(spark, tables):
    at, rows, _ = tables
    kept = [r.doc_id for r in pipeline.keep_good(spark, read(spark, at), at).collect()]
    assert set(range(120)) <= set(kept) and not set(range(120, 180)) & set(kept)
    assert kept.count(1) == 2  # a repeated row stays as often as it is there


def test_near_duplicate_stage(spark, tables):
    at, rows, _ = tables
    kept = [(r.doc_id, r.text) for r in pipeline.keep_first(spark, read(spark, at), at).collect()]
    good = {r[0]: r[1] for r in rows if r[0] is not None}
    ids = [i for i, _ in kept]
    assert ids.count(0) == 1 and 183 not in ids and 184 not in ids  # copies of the first
    assert ids.count(1) == 1  # a repeated row
    assert (None, good[2]) not in kept and (2, good[2]) in kept  # a copy without an id goes
    assert [t for i, t in kept if i is None] == [rows[-1][1]]  # one that has no copy stays
    empty = [i for i, t in kept if not (t or "").strip()]
    assert empty == [180]  # no words: one group


def test_decontamination_stage(spark, tables):
    at, rows, items = tables
    left = [(r.doc_id, r.text) for r in pipeline.keep_clean(spark, read(spark, at), at).collect()]
    gone = [r for r in rows if (r[0], r[1]) not in left]
    assert {r[1] for r in gone} == {r[1] for r in rows if r[1] and (items[0] in r[1] or items[1] in r[1])}
    assert len(gone) == 3  # the one without an id too
    assert sum(t is None for _, t in left) == 1


def test_pii_stage(spark, tables):
    at, rows, _ = tables
    got = {r.doc_id: r for r in pipeline.redact(spark, read(spark, at), at).collect() if r.doc_id is not None}
    for i, r in got.items():
        assert r.n_chars == (None if r.text is None else len(r.text))
        if i != 188:
            assert r.text == rows[i][1]
    assert "[EMAIL]" in got[188].text and "[PHONE]" in got[188].text and not pii.base_spans(got[188].text)


def test_bpe_stage(spark, tables):
    at, rows, _ = tables
    lib = Tokenizer.from_file(queries.WORD_BPE)
    got = pipeline.encode(spark, read(spark, at), at).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pipeline_is_its_stages(spark, tables):
    at, rows, items = tables
    got = [r.doc_id for r in pipeline.run(spark, at).collect()]
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "bpe"]
    assert len(got) == len(set(got)) and not set(range(120, 180)) & set(got)
    # by brute force: good rows, the first of each group of equal texts, without benchmark passages
    first, want = {}, set()
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if i < 120 and t not in first:
            first[t] = i
            want.add(i)
    assert want <= set(got)
    assert not {i for i, t, *_ in rows if i is not None and t and (items[0] in t or items[1] in t)} & set(got)
    assert got.count(None) == 1  # the clean one without an id
