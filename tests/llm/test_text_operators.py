"""Text operators against brute force on small tables with awkward rows."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from pairbars.llm import bpe, components, contamination, lengths, licences, passages, pii, quality, refine, rules, simhash, spans, toxicity, work

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp string"
PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = "the of and then what there being only once more than every other place time".split()


def passage(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    long = passage(rng, 6000)
    base = [passage(rng, rng.randrange(3, 90)) for _ in range(30)]
    out = [None, "", "   \n\t ", "one", "one two", long, base[0], base[0], base[1] + " extra", base[1], "Don't STOP 12½ Σας <|endoftext|>x", base[2] + "\n" + base[2] + "\n" + base[3]]
    out += [base[4] + " " + base[5] + " " + base[6], base[7] + " " + base[5] + " " + base[8], "a@b.co +1 (555) 123-4567 10.0.0.300 10.0.0.30 card 4111 1111 1111 1111 " + base[9]]
    return out + base[10:]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_bpe_equals_the_library(docs, texts, empty):
    lib = Tokenizer.from_file(PATH)
    got = by_id(bpe.decode(bpe.encode(docs, PATH), PATH))
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.digests(bpe.decode(bpe.encode(empty, PATH), PATH)).count() == 0


def test_bpe_of_every_code_point():
    lib, own = Tokenizer.from_file(PATH), bpe.Bpe(PATH)
    texts = [f"a{chr(c)}b 5{chr(c)}!{chr(c)}x" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        want = lib.encode_batch_fast(part, add_special_tokens=False)
        wrong = [t for t, e, w in zip(part, own.encode(part), want, strict=True) if np.frombuffer(e, "<u4").tolist() != w.ids]
        assert not wrong


def test_bpe_of_neighbouring_marks():
    lib, own = Tokenizer.from_file(PATH), bpe.Bpe(PATH)
    all_marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    others = ("\u0301", "\u0334", "\u064e", "\u0345", "\u0898")
    texts = [t for m in all_marks for o in others for t in (f"a{m}{o} e{o}{m}", f"\u0627{m}{o}{m}")]
    # every canonical pair, apart and composed
    split = [unicodedata.decomposition(chr(c)) for c in range(0x110000)]
    texts += [t for c, d in enumerate(split) if d and d[0] != "<" for t in ("x" + "".join(chr(int(x, 16)) for x in d.split()) + "\u0316y", f"x{chr(c)}\u0898\u0301y")]
    rng = random.Random(1)
    letters = ["a", "e", "\u0627", "\U00011935", "\U00011930", "\u1100", "\u1161", "\u11a8"]
    texts += ["".join(rng.choice([*letters, *rng.choices(all_marks, k=3)]) for _ in range(rng.randrange(2, 9))) for _ in range(30_000)]
    want = lib.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for t, e, w in zip(texts, own.encode(texts), want, strict=True) if np.frombuffer(e, "<u4").tolist() != w.ids]
    assert not wrong


def test_bpe_one_merge_at_a_time_is_the_same():
    one, many = bpe.Bpe(PATH), bpe.Bpe(PATH)
    one.at_once = False
    words = ["aaaaaaa", "banana", "mississippi", "x" * 300, "théâtre"]
    assert one.merge(words) == many.merge(words)


def test_lengths(docs, texts, empty):
    n = [r.n_tokens for r in bpe.lengths(docs, PATH).collect()]
    sums = lengths.suffix_sums(lengths.histogram(bpe.lengths(docs, PATH)))
    for r in sums.collect():
        assert (r.tokens_kept, r.docs_over, r.tokens_total) == (sum(min(x, r.context_limit) for x in n), sum(x > r.context_limit for x in n), sum(n))
    limits = {r.limit: r.tokens_kept for r in lengths.at_limits(sums, [0, 5, 10**6]).collect()}
    assert limits == {k: sum(min(x, k) for x in n) for k in (0, 5, 10**6)}
    assert lengths.quantiles(sums, [0.5]).first().length == sorted(n)[(len(n) + 1) // 2 - 1]
    assert lengths.suffix_sums(lengths.histogram(bpe.lengths(empty, PATH))).count() == 0


def _fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs, texts, empty):
    fp = {i: _fingerprint(t) for i, t in enumerate(texts)}
    least = {i: i for i in fp}
    for _ in fp:
        for i in fp:
            least[i] = min(least[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3)
    for bucket in (4096, 1):
        got = by_id(simhash.near_duplicates(docs, bucket=bucket))
        assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", least[i]) for i in fp}
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(least.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("bucket", [4096, 8])
def test_simhash_large_bucket(spark, bucket):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 1 << 62))
    fps = {center}
    while len(fps) < 80:
        fps.add(center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = components.components(simhash.close_links(df, bucket=bucket))
    root = {f: f for f in signed} | {r.node: r.root for r in found.collect()}
    unsigned = lambda f: f & ((1 << 64) - 1)
    least = {f: f for f in signed}
    for _ in range(10):
        for f in signed:
            least[f] = min(least[g] for g in signed if (unsigned(f) ^ unsigned(g)).bit_count() <= 3)
    assert root == least


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_base_spans_by_plain_patterns(texts):
    rng = random.Random(1)
    for t in ["".join(rng.choice("ab@@..1234567890 +-()") for _ in range(60)) for _ in range(3000)]:
        plain = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        plain += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in pii.base_spans(t) if s[0] < 2] == plain


def test_pii(docs, texts, empty):
    got = by_id(pii.digests(pii.find(docs, None)))
    i = next(k for k, t in enumerate(texts) if t and "a@b.co" in t)
    assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == (1, 1, 1, 0)  # the telephone number runs into the address
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[0].spans == ""
    red = {r.doc_id: r.text for r in pii.redact(docs, None).collect()}
    assert red[i].startswith("[EMAIL] +1") and "[CARD]" in red[i] and red[0] is None
    assert pii.train(empty) is None and pii.digests(pii.find(empty, None)).count() == 0


def _card(rng):
    digits = [rng.randrange(10) for _ in range(15)]
    for last in range(10):
        whole = [*digits, last]
        if (sum(whole[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in whole[-2::-2])) % 10 == 0:
            return "".join(map(str, whole))


def _private(rng, kind, other):
    """A span of a kind, as the base rules find it or in another form."""
    name = rng.choice("abcdefgh") + rng.choice(["lee", "kim", "ray", "ortiz", "ng"]) + rng.choice(["", "7", ".m"])
    host = [rng.choice(["mail", "post", "corp"]) + str(rng.randrange(9)), rng.choice(["example", "test"]), rng.choice(["com", "org"])][rng.randrange(2) :]
    a, b, c = rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999)
    if kind == 0:
        at, dot = rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) ")]) if other else ("@", ".")
        return name + at + dot.join(host)
    if kind == 1:
        return rng.choice(["[.]", " . "] if other else ["."]).join(str(rng.randrange(1, 255)) for _ in range(4))
    if kind == 2:
        n = _card(rng)
        return rng.choice([".", "/"] if other else [" ", "-"]).join(n[i : i + 4] for i in range(0, 16, 4))
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"]) if other else f"+1 {a} {b} {c}"


def test_network_finds_other_forms(spark):
    rng = random.Random(2)
    lead = ["write to", "reach us:", "send it to", "call", "host", "paid with", "see", "number"]
    clean = lambda: f"in {rng.randrange(1900, 2030)} there were {rng.randrange(999)} of them at {rng.randrange(24)}:{rng.randrange(10, 60)} for {rng.randrange(99)}.{rng.randrange(10, 99)} each"
    text = lambda kind, other: (f"{passage(rng, 12)} {rng.choice(lead)} ", _private(rng, kind, other), f" {passage(rng, 6)} {clean()} {passage(rng, 6)}")
    rows = ["".join(text(i % 4, False)) for i in range(1600)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    net = pii.train(df)
    planted = [text(i % 4, True) for i in range(400)]
    wholes = ["".join(p) for p in planted]
    found = pii.all_spans(wholes, net)
    assert not any(pii.base_spans(w) for w in wholes)
    right = sum((i % 4, len(a), len(a) + len(b), False) in f for i, ((a, b, _), f) in enumerate(zip(planted, found, strict=True)))
    assert right >= 0.9 * len(planted)
    assert right >= 0.9 * sum(map(len, found))  # of what it adds
    assert sum(map(bool, pii.network_spans([f"{passage(rng, 20)} {clean()} {passage(rng, 5)}" for _ in range(200)], net))) <= 4
    for i, t in enumerate(rows[:200]):
        base = [(*s, True) for s in pii.base_spans(t)]
        assert [s for s in pii.all_spans([t], net)[0] if s[3]] == base and base[0][0] == i % 4  # base ones stay


def test_network_finds_forms_left_out_of_training(monkeypatch):
    """One form of each kind is left out of training, and only these are planted. Telephone numbers with dots are not found so (README)."""
    left_out = [r"\[at\]", r"\[\.\]", "/", r"^\d{3}\.\d{3}\.\d{4}$"]
    draw, rng = pii.other_form, random.Random(2)

    def others(kind, text, seed):
        return next(x for x in iter(lambda: draw(kind, text, seed), None) if not re.search(left_out[kind], x))

    monkeypatch.setattr(pii, "other_form", others)
    text = lambda span: (f"{passage(rng, 12)} {rng.choice(['write to', 'call', 'see', 'number'])} ", span, f" {passage(rng, 6)} in {rng.randrange(1900, 2030)} {passage(rng, 6)}")
    rows = ["".join(text(_private(rng, i % 4, False))) for i in range(1600)]
    windows = [w for r in rows for w in pii.training_windows(r, np.random.default_rng(len(r)))]
    assert not any(re.search(left_out[0], w) for _, w, _ in windows)
    net = pii.fit([(w, t) for k in range(-1, 4) for _, w, t in [x for x in windows if x[0] == k][:720]])
    planted = [text(next(x for x in iter(lambda: _private(rng, i % 3, True), None) if re.search(left_out[i % 3], x))) for i in range(300)]
    found = pii.all_spans(["".join(p) for p in planted], net)
    right = sum((i % 3, len(a), len(a) + len(b), False) in f for i, ((a, b, _), f) in enumerate(zip(planted, found, strict=True)))
    assert right >= 0.9 * len(planted) and right >= 0.9 * sum(map(len, found))


def test_network_reads_a_text_of_any_length_as_one(spark):
    net = pii.Network.fresh(8, 1)
    digits = "7 1 @ " * 30_000
    (spans_found,) = pii.network_spans([digits], net)
    assert all(0 <= a < b <= len(digits) for _, a, b in spans_found)
    assert pii._stretches(digits) == [(0, -(-(len(digits) - pii.WINDOW) // pii.STRIDE))]
    assert pii.network_spans(["", "none here"], net) == [[], []]


def test_base_digests_by_plain_patterns(spark):
    rng = random.Random(4)
    texts = [" ".join(_private(rng, rng.randrange(4), rng.random() < 0.3) + rng.choice(["", ",", "."]) for _ in range(8)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.digests(pii.find(df, None)))
    for i, t in enumerate(texts):
        plain = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        plain += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
                plain.append(("card", *m.span()))
        plain += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[i].spans == joined
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == kind for k, _, _ in plain) for kind in ("email", "ip", "card", "phone"))


def _repeats(texts, size):
    seen = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[k : k + size] for k in range(len(b) - size + 1))
    for b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(b), int(gone.sum()), runs, kept


@pytest.mark.parametrize(("size", "q", "cell"), [(40, 8, 8), (60, 10, 32), (50, 49, 49)])
def test_repeated_spans(docs, texts, empty, size, q, cell):
    got = by_id(spans.repeated_spans(docs, length=size, q=q, cell=cell))
    for i, want in enumerate(_repeats(texts, size)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == want
    assert spans.repeated_spans(empty).count() == 0


def test_repeated_spans_at_the_defaults(spark):
    rng = random.Random(8)
    shared = [passage(rng, n) for n in (70, 75, 80, 120, 400)]
    rows = [" ".join([passage(rng, rng.randrange(120)), rng.choice(shared), passage(rng, rng.randrange(120)), rng.choice(shared)]) for _ in range(60)]
    rows += [rows[0], rows[1][:500], rows[2] + "ä" * 900, "x" * 401, "y" * 400, "z" * 399, "é" * 300]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = by_id(spans.repeated_spans(df))
    for i, want in enumerate(_repeats(rows, spans.LENGTH)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == want


def test_repeated_spans_over_segments(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 105, 5000, dtype=np.uint8)
    stops = np.array([1200, 1210, 3333, 5000])
    monkeypatch.setattr(refine, "SEGMENT", 1 << 20)
    whole, starts = refine.anchors(data, stops, 40, 8), np.arange(0, 4900, 7)
    ids = refine.at_places(data, [(starts, 60), (starts, 32), (starts + 1, 7)])
    monkeypatch.setattr(refine, "SEGMENT", 300)
    for a, b in zip(whole, refine.anchors(data, stops, 40, 8), strict=True):
        assert np.array_equal(a, b)
    for one, cut in zip(ids, refine.at_places(data, [(starts, 60), (starts, 32), (starts + 1, 7)]), strict=True):
        assert all(np.array_equal(a, b) for a, b in zip(one, cut, strict=True))
    strings = [data[s : s + 60].tobytes() for s in starts]
    pairs = list(zip(*ids[0], strict=True))
    assert len(set(strings)) == len(set(pairs)) == len(set(zip(strings, pairs, strict=True)))


def test_refinement_works_only_where_a_string_is(monkeypatch):
    rng = np.random.default_rng(5)
    data, seen, grams = rng.integers(97, 105, 200_000, dtype=np.uint8), [], refine.grams
    starts = np.concatenate([[0, 7, 33_000], np.arange(90_000, 90_064), [len(data) - 500]])
    monkeypatch.setattr(refine, "grams", lambda part, *more: seen.append(len(part)) or grams(part, *more))
    some = refine.at_places(data, [(starts, 400), (starts + 100, 337), (starts[:0], 463)])
    assert sum(seen) < 3_500  # the strings lie in about 2,000 bytes
    for length, at, ids in ((400, starts, some[0]), (337, starts + 100, some[1])):
        (whole,) = refine.at_places(data, [(np.arange(len(data) - length + 1), length)])
        assert all(np.array_equal(a, b[at]) for a, b in zip(ids, whole, strict=True))
    assert [len(x) for x in some[2]] == [0, 0]
    (none,) = refine.at_places(data[:0], [(starts[:0], 400)])
    assert [len(x) for x in none] == [0, 0]


def _shares(texts, size):
    """Documents that hold a run of words that another one holds."""
    seen = defaultdict(set)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - size + 1):
            seen[tuple(w[k : k + size])].add(i)
    return {i for found in seen.values() if len(found) > 1 for i in found}


def test_shared_passages(spark, texts):
    rng = random.Random(14)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = [own(50), own(51), own(52), own(90), " ".join("ab" for _ in range(60))]
    rows = [*texts, *[own(rng.randrange(40)) + "  \n" + rng.choice(shared) + "\t" + own(rng.randrange(40)) for _ in range(60)]]
    rows += [own(60) + " " + shared[3] + " " + own(3) + " " + shared[3], "x" * 400 + " " + own(60), own(70), own(25) + "\n" + own(25) + "\n" + shared[2][:-1], None, "", " ".join("c" for _ in range(300))]
    rows += [rows[-8], own(60) + " é" * 60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in spans.repeated_spans(df).filter("shares_passage").collect()}
    assert got == _shares(rows, passages.LENGTH)
    for size, q in ((10, 3), (6, 6)):
        plain = refine.bucketed(work.with_text(df), work.work_dir(spark), 4)
        found = passages.sharing(plain.select("row", "text"), size, q).join(plain.select("row", "doc_id"), "row")
        assert {r.doc_id for r in found.collect()} == _shares(rows, size)


def test_words_of_texts_end_to_end():
    texts = ["one two", "", "two", "  three\n", "x" * 200, "x" * 201, "Two"]
    data = [t.encode() for t in texts]
    flat, stops = np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data])
    (x, y), ends = passages.word_ids(flat, stops)
    assert ends.tolist() == [2, 2, 3, 4, 5, 6, 7] and len(x) == 7
    assert x[1] == x[2] and y[1] == y[2] and len(set(x.tolist())) == 6


def test_words_of_any_length_and_place(monkeypatch):
    monkeypatch.setattr(passages, "PIECE", 50)
    rng = random.Random(6)
    words = ["a" * n for n in range(1, 40)] + ["b" * 8 + "c" * 8, "c" * 8 + "b" * 8, "a\0", "a\0\0", "\0", "\0\0", "x" * 5000, "x" * 4999 + "y"]
    texts = ["".join(rng.choice(words) + rng.choice(" \n\t\r") for _ in range(rng.randrange(30))) for _ in range(60)] + ["", " ", *words]
    data = [t.encode() for t in texts]
    (x, y), ends = passages.word_ids(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
    plain = [re.findall(rb"[^\x20\x09-\x0D]+", d) for d in data]
    assert ends.tolist() == np.cumsum([len(w) for w in plain]).tolist()
    flat = [w for found in plain for w in found]
    assert len(set(flat)) == len(set(x.tolist())) == len(set(y.tolist())) == len(set(zip(flat, x.tolist(), y.tolist(), strict=True)))


def test_rules(docs, texts, empty):
    got = by_id(rules.judge(docs))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = defaultdict(list)
        for k in range(len(w) - 4):
            grams[tuple(w[k : k + 5])].append(k)
        again = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(5)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert got[i].base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
    assert rules.judge(docs).filter("kept").count() == sum(r.kept for r in got.values())
    assert rules.judge(empty).count() == 0


def test_cascade_order_changes_nothing(docs, empty):
    some = rules.counted(docs)
    verdicts = [[r[0] for r in some.orderBy("doc_id").select(rules.cascade(order)).collect()] for order in (rules.default_rules(), rules.default_rules()[::-1])]
    assert verdicts[0] == verdicts[1]
    given = rules.default_rules()
    assert sorted(r.name for r in rules.ordered(given, some)) == sorted(r.name for r in given)
    assert rules.ordered(given, rules.counted(empty)) == given


def test_cascade_is_ordered_by_conditional_rejection_per_cost():
    # the second rule rejects most, but the first rejects more per cost; the third rejects nearly the same rows as the first, the fourth others
    found = [((True, True, True, False), 38), ((True, True, False, False), 2), ((False, True, False, False), 30), ((False, False, True, False), 1), ((False, False, False, True), 5), ((False,) * 4, 24)]
    assert rules.chain([1, 4, 1, 1], found) == [0, 1, 3, 2]
    assert rules.chain([1, 1], []) == [0, 1]


def test_rules_symbols_and_verdict(spark):
    plain = "there was only one more time for the other place and then what "
    texts = [plain * 1, "word " * 9, "# $ % " + plain, "BIG " * 12 + plain[:8], "\n".join(["same line here"] * 5), "a b c d e f g h i j k l m", "!!!!!!! " + plain, "x" * 300 + " " + "y" * 300 + " " + " ".join("abcdefgh")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(rules.judge(df))
    for i, t in enumerate(texts):
        n, chars = len(t.split()), len("".join(t.split()))
        assert got[i].n_symbols == sum(c in rules.SYMBOLS for c in t)
        lines = [x for x in t.split("\n") if x.strip()]
        bad = 10 * got[i].n_symbols > n or (2 * (len(lines) - len(set(lines))) > len(lines) > 3) or chars < 2 * n or chars > 20 * n
        bad = bad or 2 * sum("A" <= c <= "Z" for c in t) > chars or 2 * t.count("!") > n or 10 * sum(c.isalpha() for c in t) < 4 * chars
        assert got[i].kept == (not got[i].base_failed and not bad), t


@pytest.mark.parametrize("broadcast", [contamination.BROADCAST_ROWS, 0])
def test_contamination(spark, docs, texts, empty, monkeypatch, broadcast):
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", broadcast)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    items = [(1, texts[5][100:400]), (2, None), (3, "!!"), (4, texts[15]), (10, "then once"), (11, " ".join(words(texts[20])[2:10])), (12, texts[16] + " unseen words follow here"), (None, texts[17])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(contamination.contamination(docs, bench))
    windows = [(i, tuple(w[k : k + m])) for i, t in items for w in [words(t)] if w for m in [min(13, len(w))] for k in range(len(w) - m + 1)]
    for d, t in enumerate(texts):
        w, hit, ids = words(t), set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids.add(i)
        ids = sorted(str(i) for i in ids if i is not None)
        assert (got[d].n_words, got[d].n_hit, got[d].item_ids) == (len(w), len(hit), ids), d
        assert got[d].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert contamination.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in contamination.contamination(docs, bench.filter("item_id in (2, 3)")).collect())
    assert contamination.uncontaminated(docs, bench).count() == sum(not r.contaminated for r in got.values())


def test_licences(spark, empty):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x", "text"), (3, "a/b/LICENSE", "Licensed under CC BY-NC 4.0."), (4, "a/b/c/y", "code\nAll rights reserved.\nmore"), (5, "z/q", None), (6, None, ""), (7, "a/w", "we hold a driving license for cars")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r.doc_id: (r.own_licence, r.inherited, r.licence) for r in licences.scan(df, licences.default_templates(spark)).collect()}
    assert got[1] == ("MIT", "MIT", "MIT") and got[2] == (None, "CC-BY-NC-4.0", "CC-BY-NC-4.0") and got[4] == ("Proprietary", "CC-BY-NC-4.0", "Proprietary")
    assert got[5] == got[6] == (None, None, None) and got[7] == (None, "MIT", "MIT")
    assert licences.scan(licences.document_paths(empty), licences.default_templates(spark)).count() == 0


def test_licences_of_repeated_and_tied_rows(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [(1, "a/LICENSE", apache, "x"), (1, "a/LICENSE", mit, "x"), (2, "a/f", None, "x"), (2, "a/f", None, "x"), (3, "a/f", "", "y"), (4, "LICENSE", mit, None), (5, "b/c/d", "x" * 200_000, None), (6, "a", "All rights reserved.", None), (7, None, None, None)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string, licence string")
    got = sorted((r.doc_id, r.own_licence, r.inherited, r.licence) for r in licences.scan(df, licences.default_templates(spark)).collect() if r.doc_id != 1)
    first = min([(hashlib.md5(t.encode()).hexdigest(), n) for t, n in ((mit, "MIT"), (apache, "Apache-2.0"))])[1]
    assert got == [(2, None, first, first), (2, None, first, first), (3, None, first, first), (4, "MIT", "MIT", "MIT"), (5, None, "MIT", "MIT"), (6, "Proprietary", "MIT", "Proprietary"), (7, None, "MIT", "MIT")]


def test_licences_beyond_single_lines(spark):
    mpl = "# This Source Code Form is subject to the terms of the Mozilla\n# Public License, v. 2.0. If a copy of the MPL was not distributed\n# with this file, You can obtain one at http://mozilla.org/MPL/2.0/.\nimport os\n"
    gpl = "/* This file is free: you can redistribute it\n * under the terms of the GNU General Public\n * License version 3. */"
    long = "Some text before. Licensed under the Apache License, Version 2.0. The module below reads tables and writes them again in another order."
    full = {r.licence: r.text for r in licences.default_texts(spark).collect()}
    texts = ["// SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: Apache-2.0\nx = 1", "SPDX-License-Identifier: GPL-3.0-or-later", long, mpl, gpl, *full.values()]
    want = ["MIT", "Apache-2.0", "GPL-3.0", "Apache-2.0", "MPL-2.0", "GPL-3.0", *full]
    texts += ["we hold a driving license for cars and a licence for boats, which the town gave us", "the copyright of this book is with its writers, says the court", "SPDX-License-Identifier: none-such"]
    df = spark.createDataFrame([(i, f"d{i}/x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_licence for r in licences.scan(df, licences.default_templates(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == [*want, None, None, None]


def labelled(spark, make, n=400):
    rng = random.Random(9)
    rows = [(i, *make(rng)) for i in range(n)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_quality_learns(spark, empty):
    docs, labels = labelled(spark, lambda r: (passage(r, 40), 1) if r.random() < 0.7 else (passage(r, 40).upper().replace(" ", "!! "), 0))
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").filter("held_out")
    assert got.count() > 40 and got.filter("predicted != quality").count() == 0
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0
    assert quality.kept(docs, model).count() == labels.filter("quality = 1").count()


def test_toxicity_learns_pairs(spark, empty):
    def make(r):
        w = passage(r, 25).split() + [x for x in ("clown", "neighbours") if r.random() < 0.5]
        r.shuffle(w)
        return " ".join(w), int("clown" in w and "neighbours" in w)

    docs, labels = labelled(spark, make, 800)
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out")
    assert got.filter("predicted = toxic").count() >= 0.95 * got.count()
    assert toxicity.score(empty, model).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 and not (r.doc_id is None and r.held_out) for r in toxicity.score(nulls, model).collect())


def _auc(scores, y):
    """How often a positive row is over a negative one; ties count half."""
    above = scores[y == 1][:, None] - scores[y == 0][None, :]
    return (above > 0).mean() + 0.5 * (above == 0).mean()


@pytest.mark.parametrize("rule", [lambda a, b: a != b, lambda a, b: a == b, lambda a, b: a and b])
def test_toxicity_learns_pairs_of_words_that_tell_nothing_alone(rule):
    rng = np.random.default_rng(5)
    filler = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{i}" for i in range(400)]
    texts, y = [], []
    for _ in range(4000):
        a, b = (int(x) for x in rng.random(2) < 0.5)
        texts.append(" ".join(rng.permutation([*rng.choice(filler, 30), *["maple"] * a, *["copper"] * b])))
        y.append(float(rule(a, b)))
    found, y = toxicity.terms(texts), np.array(y)
    model = toxicity.fit(found[:3000], y[:3000])
    assert _auc(model.margin(found[3000:]), y[3000:]) > 0.95


def test_pair_evidence_of_chance_is_small():
    rng = np.random.default_rng(6)
    x = rng.random((3000, 300)) < 0.2
    row, at = np.nonzero(x)
    y = rng.random(3000) < 0.3
    args = at, row, 3000, x.sum(0), (y - 0.3).astype(np.float32), np.full(3000, 0.21, np.float32)
    assert toxicity.pair_evidence(*args).max() < 0.1
    assert (toxicity.pair_evidence(*args, terms=10) > 0).sum() <= 10


def test_toxicity_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    kept = np.sort(rng.choice(1000, 40, replace=False))
    model = toxicity.Machine(kept, 0.3, np.append(rng.normal(size=40), 0), np.vstack([rng.normal(size=(40, 4)), np.zeros((1, 4))]))
    rows = [np.sort(rng.choice(1000, n, replace=False)) for n in (0, 1, 5, 60, 300)]
    for x, got in zip(rows, model.margin(rows), strict=True):
        at = [int(np.flatnonzero(kept == t)[0]) for t in x if t in kept]
        want = 0.3 + sum(model.weights[i] for i in at) + sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        assert abs(got - want) < 1e-9


def test_toxicity_terms(spark):
    a, b, c = toxicity.terms(["running runner runs", "RUNS runs runs", ""])
    assert len(a) == 3 + 1 + 2 and len(b) == 2 and not len(c)  # words, one beginning, shared by two and by three
    long = toxicity.terms([" ".join(f"w{i}" for i in range(50_000))])[0]
    assert len(long) > 40_000 and (np.diff(long) > 0).all()


def test_quality_margin_is_the_sum_of_table_entries():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs
    bin_of = lambda j, v: sum(v > e for e in model.edges[j])
    for row, got in zip(x[:40], model.margin(x[:40]), strict=True):
        want = model.base + sum(float(t[bin_of(j, row[j])]) for j, t in enumerate(model.tables))
        want += sum(float(t[model.coarse[i][bin_of(i, row[i])], model.coarse[j][bin_of(j, row[j])]]) for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(got - want) < 1e-9


def test_rules_sample_is_bounded_for_any_ids(spark):
    rows = [(None if i % 2 else 7, f"text number {i % 900} of a table") for i in range(3000)]
    table = spark.createDataFrame([*rows, *[(7, "one text")] * 2000], "doc_id long, text string").repartition(6)
    got = rules.sampled(table, 50)
    assert got.count() == 50 == got.distinct().count()
    assert rules.sampled(table, 10_000).count() == table.distinct().count()
    assert rules.judge(table, sample_rows=50).count() == 5000


def test_pii_adds_nothing_that_a_base_rule_refused():
    net = pii.Network.fresh(4, 1)
    texts = ["card 4845168114407328 here", "no 007592323165 card", "ip 10.0.0.300 and 10.0.0.1", "call +12 34 now", "4111.1111.1111.1111", "4111.1111.1111.1112"]
    spans = {t: [(k, t.index(x), t.index(x) + len(x)) for k, x in found] for t, found in zip(texts, ([(2, "4845168114407328")], [(2, "007592323165")], [(1, "10.0.0.300")], [(3, "+12 34")], [(2, "4111.1111.1111.1111")], [(2, "4111.1111.1111.1112")]), strict=True)}
    whole, pii.network_spans = pii.network_spans, lambda texts, net: [spans[t] for t in texts]
    try:
        got = pii.all_spans(texts, net)
    finally:
        pii.network_spans = whole
    assert [[s for s in x if not s[3]] for x in got] == [[], [], [], [], [(2, 0, 19, False)], []]
    assert [len(x) for x in got] == [0, 0, 1, 0, 1, 0]
