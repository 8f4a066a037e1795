import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import bpe, decontamination, jaccard, licenses, lm, substring
from siftline.llm.components import components
from siftline.llm.queries import ORACLES, QUERIES
from siftline.llm.textops import Words, ngrams, sliding_min

from . import brute

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    import duckdb

    df = QUERIES[name](spark, small)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    cur = db.execute(ORACLES[name])
    cols = sorted(c[0] for c in cur.description)
    at = {c[0]: i for i, c in enumerate(cur.description)}
    assert cols == sorted(df.columns)
    same([tuple(r[c] for c in cols) for r in df.collect()], [tuple(r[at[c]] for c in cols) for r in cur.fetchall()])


def test_decontamination_equals_brute_force(spark, frame, prose):
    long = [t for _, t in prose if t and len(t.split()) > 30]
    items = [(1, " ".join(long[0].split()[5:25])), (2, "one"), (3, None), (4, "!!"), (5, " ".join(long[1].split()[:10])), (5, long[2]), (None, "of"), (6, "four WORDS are")]
    docs = [*prose, (900, "Ein, ONE two"), (901, " ".join(long[0].split()[5:25]) + " x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(docs, [x for x in items if x[0] is not None])
    same(rows(decontamination.decontaminated(frame(docs), bench)), want)
    # several pattern blocks give the same answer
    many = decontamination.find(frame(docs), bench, block_bytes=400)
    same(rows(many.select("n_words", "n_hit", F.size("items"))), [(w[1], w[2], w[3]) for w in want])
    kept = decontamination.clean(frame(docs), bench)
    assert kept.count() == sum(not w[5] for w in want) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert decontamination.decontaminated(frame(docs), bench.where("false")).where("contaminated").count() == 0
    assert decontamination.decontaminated(frame([]), bench).count() == 0


def test_decontamination_by_items_without_an_id(spark, frame, tmp_path):
    """The query equals its SQL on a benchmark with null ids, and the pipeline's stage rejects what holds their text."""
    import corpus_pipeline
    import duckdb

    text = [" ".join(f"{x}{i}" for i in range(14)) for x in "abcd"]
    docs = [(1, f"x {text[0]} y"), (2, f"{text[1]} {text[0]}"), (3, text[2]), (4, "clean words only"), (5, text[3])]
    items = [(None, text[0]), (None, text[3]), (7, text[1]), (8, text[3])]
    frame(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    same(rows(decontamination.query(spark, str(tmp_path))), db.execute(decontamination.ORACLE).fetchall())
    many = decontamination.find(frame(docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=400, nameless=True)
    assert {r._k: (r.n_hit, r["items"]) for r in many.collect()} == {1: (14, [None]), 2: (28, ["7", None]), 3: (0, []), 4: (0, []), 5: (14, ["8", None])}
    assert sorted(r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, frame(docs), str(tmp_path)).collect()) == [3, 4]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. é", max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_slices_cover_a_text(text, longest, size):
    """Every run of `longest` words lies within a slice, at its place."""
    raw = text.encode()
    want = decontamination.words(raw)
    seen, end = set(), 0
    for first, part in decontamination.slices(raw, longest, size):
        assert want[first : first + len(part)] == part
        seen |= {first + i for i in range(len(part) - longest + 1)}
        end = first + len(part)
    assert end == len(want) and seen == set(range(len(want) - longest + 1))


def test_decontamination_window_of_many_items(spark, frame, monkeypatch):
    """A window that very many items hold is dealt to parts and blocks; a document that holds it names them all."""
    text = " ".join(f"w{i}" for i in range(10))
    items = spark.createDataFrame([(i, text) for i in range(300)] + [(None, text)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "ITEMS", 20)
    assert decontamination.patterns_of(items, nameless=True).count() > 10
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(decontamination, "SLICE", 16)
    got = decontamination.find(frame([(1, f"a {text} b"), (2, "no hit")]), items, nameless=True).collect()
    assert {r._k: (r.n_words, r.n_hit, r["items"]) for r in got} == {1: (12, 10, [*sorted(str(i) for i in range(300)), None]), 2: (2, 0, [])}
    assert [r.doc_id for r in decontamination.clean(frame([(1, f"a {text} b"), (2, "no hit")]), items).collect()] == [2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), min_size=1, max_size=4), min_size=1, max_size=6), st.lists(st.sampled_from("abc"), max_size=40))
def test_wu_manber_finds_all(patterns, text):
    pats = {tuple(p): (i,) for i, p in enumerate(patterns)}
    got = sorted((s, x.length) for x in decontamination.searchers(pats) for s, _ in x.occurrences(text))
    want = sorted((i, len(p)) for p in pats for i in range(len(text) - len(p) + 1) if tuple(text[i : i + len(p)]) == p)
    assert got == want


def test_substring_equals_brute_force(frame, prose, monkeypatch):
    want = [(d, n, g, k) for d, n, g, k in brute.substrings(prose)]
    same(rows(substring.deduplicated(frame(prose))), want)
    # all minimisers hot: windows travel one by one
    plain = substring.repeats_of
    monkeypatch.setattr(substring, "repeats_of", lambda blobs, **k: plain(blobs, hot_least=1, **k))
    same(rows(substring.deduplicated(frame(prose, 2))), want)
    # a bitmap that says "perhaps" to everything
    monkeypatch.setattr(substring, "repeats_of", lambda blobs, **k: plain(blobs, map_bits=1, **k))
    same(rows(substring.deduplicated(frame(prose, 1))), want)
    assert substring.deduplicated(frame([])).count() == 0


def test_substring_small_alphabet(frame):
    import random

    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([5, 25, 60])))) for i in range(40)]
    same(rows(substring.deduplicated(frame(docs), width=6)), brute.substrings(docs, 6))


def test_substring_repeats_of_every_period(frame):
    """Texts of one period each whose words occur in no other document: one window repeated, and many."""
    docs = [(100 * n + p, " ".join(f"p{p}n{n}w{j % p}" for j in range(length))) for p in range(1, 41) for n, length in enumerate((p + 20, 4 * p + 20))]
    got = rows(substring.deduplicated(frame(docs)))
    assert all(r[2] for r in got)
    same(got, brute.substrings(docs))


@pytest.mark.parametrize("doc", [5, None])
def test_substring_rows_of_one_id_at_one_position(spark, doc):
    """Different texts of one id hold a passage at the same word; one task reads them before the earlier document."""
    passage = " ".join(f"w{i}" for i in range(40))
    docs = [(doc, f"{passage} a"), (doc, f"{passage} b"), (doc, f"{passage} a"), (doc, f"{passage} c"), (None if doc is None else 1, f"{passage[3:]} end")]
    data = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    same(rows(substring.deduplicated(data)), brute.substrings(docs))


def test_jaccard_equals_brute_force(frame, prose):
    same(rows(jaccard.near_duplicates(frame(prose))), brute.jaccard(prose))
    assert jaccard.near_duplicates(frame([])).count() == 0


def test_jaccard_large_region_in_blocks(frame, monkeypatch):
    """One base text and many edits of it, cut into blocks of a few classes."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = [(0, " ".join(base))]
    for i in range(1, 70):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"z{rng.randint(0, 20)}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join([f"u{i}x{j}" for j in range(30)] + base[:30])) for i in range(10)]  # share a passage only
    want = brute.jaccard(docs)
    same(rows(jaccard.near_duplicates(frame(docs))), want)
    monkeypatch.setattr(jaccard, "CELL_BYTES", 12 * 8 * 56)  # cells of a few classes: dealt on once, then met in blocks
    monkeypatch.setattr(jaccard, "DEPTH", 1)
    same(rows(jaccard.near_duplicates(frame(docs, 3))), want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[150] == got[200] == got[100] == 100 and 300 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_drops_members_of_no_near_size(spark):
    """In a cell, sets of a size that no unconnected set is near to are not dealt; sets of near sizes are, and those that are copies alone are not."""
    kinds = "cell string, x long, n long, component long, side long"
    rows_ = [("a", 1, 10, 1, 3), ("a", 2, 100, 2, 3), ("b", 3, 30, 3, 3), ("b", 4, 40, 4, 1), ("b", 5, 90, 5, 3), ("c", 6, 30, 6, 1), ("c", 7, 31, 7, 1), ("c", 8, 99, 8, 3), ("d", 9, 50, 9, 3), ("d", 10, 50, 9, 3)]
    assert sorted(r.x for r in jaccard._open(spark.createDataFrame(rows_, kinds)).collect()) == [3, 4]


def test_jaccard_owners_are_found_without_a_join(spark):
    """The map of owners finds every owner and few other rows, and no text is dealt for it."""
    owners = spark.range(0, 2000, 4).select(F.xxhash64("id").alias("_fp"))
    rows_ = spark.range(2000).select(F.col("id").cast("string").alias("text"), F.xxhash64("id").alias("_fp"))
    found = rows_.mapInArrow(jaccard._owned(jaccard._owner_map(owners)), "text string")
    got = {int(r.text) for r in found.collect()}
    assert got >= set(range(0, 2000, 4)) and len(got) < 520
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_lm_base_score_is_exact(spark, frame, prose):
    docs = frame(prose).select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c, n, v = brute.base_scores([t for d, t in prose if not held(d)])
    want = []
    for d, t in prose:
        toks = brute.tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks)
        want.append((d, held(d), len(toks), sum(c[x] > 0 for x in toks), n, round(base, 6)))
    for hot in (lm.HOT_WORDS, 5):  # broadcast counts, and counts by the join
        got = lm.scored(docs, lm.train(docs.where("not held_out"), hot_words=hot))
        assert all(r.score < 0 for r in got.collect())
        same(rows(got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6))), want)


def test_lm_filter_levels():
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 1 << 63, 3000).astype(np.uint64), rng.integers(1, 5000, 3000)
    own = 1 << 10
    from siftline.llm.textops import dealt

    bitmap = np.zeros(lm.BUCKETS * own // 8, np.uint8)
    for q in range(lm.BUCKETS):
        flags, at = np.zeros(own, bool), dealt(keys, lm.BUCKETS) == q
        lm.Filter(own, None).put(keys[at], lm.level_of(counts[at]), flags)
        bitmap[q * own // 8 : (q + 1) * own // 8] = np.packbits(flags, bitorder="little")
    got, want = lm.Filter(own, bitmap).levels(keys), lm.level_of(counts)
    assert (got >= want).all() and (got == want).mean() > 0.8  # one-sided error
    assert (lm.least_of(want) <= counts).all() and (lm.greatest_of(want) >= counts).all()


def test_lm_filter_follows_its_entries(frame, prose):
    """A filter beyond the broadcast's bound has the bits of any other, and gives the same scores."""
    docs = frame(prose).select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"))
    train = docs.where("not held_out")
    got, want = (rows(lm.scored(docs, lm.train(train, most_bits=most)).select("doc_id", "held_out", "n_tokens", "n_known", F.round("base_score", 6), F.round("score", 9))) for most in (1, 1 << 31))
    assert got == want and len(got) == len(prose)


def test_lm_buckets_follow_the_input(frame, prose, monkeypatch):
    """More buckets, as for tables of many splits, give the same scores, by the broadcast filter and by dealt segments."""
    docs = frame(prose).select("doc_id", "text", F.lit(False).alias("held_out"))
    got = []
    for fine, most in ((1, 1 << 31), (3, 1 << 31), (3, 1)):
        monkeypatch.setattr(lm, "fineness", lambda _, n=fine: n)
        got.append(rows(lm.scored(docs, lm.train(docs, most_bits=most, bits_each=40)).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6), F.round("score", 6))))
    assert got[0] == got[1] == got[2]


def test_lm_bits_do_not_depend_on_buckets(frame, prose, monkeypatch):
    """The filter's bits are those of its entries, whatever the buckets, and a chunk of which two splits hold parts is answered in two pieces."""
    docs, got = frame(prose).select("doc_id", "text", F.lit(False).alias("held_out")), []
    for fine in (1, 3):
        monkeypatch.setattr(lm, "fineness", lambda _, n=fine: n)
        got.append(lm.train(docs)["model"].value)
    assert (got[0][0] == got[1][0]).all() and (got[0][1] == got[1][1]).all()
    batch = pa.RecordBatch.from_pydict({"chunk": [7, 7, 7], "n": [0, 1, 5], "text": ["a b", "b c", "a"]})
    asked = pa.Table.from_batches(lm._probes(1)([batch]))
    assert asked["n"].to_pylist() == [0, 5] and [len(x) // 8 for x in asked["keys"].to_pylist()] == [11, 5]


def test_lm_sends_steps_between_hashes():
    """A sorted hash costs some four bytes where it was sent as eight, and comes back whole, far steps too."""
    rng = np.random.default_rng(2)
    for n, buckets, most in ((200_000, 2048, 4.4), (200_000, 3, 4.4), (50, 7, None), (1, 1, None)):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64) & lm._SHORT)
        own, blobs = lm.thinned(keys, lm.bucket_of(keys, buckets), buckets)
        assert (np.concatenate([lm.thickened([b], q, buckets)[0] for q, b in zip(own, blobs)]) == keys).all()
        assert most is None or sum(map(len, blobs)) < most * len(keys)
    ends = np.array([0, lm._FAR, lm._FAR + 1, (1 << 48) - 1], np.uint64) << np.uint64(16)
    _, blobs = lm.thinned(ends, np.zeros(4, np.int64), 1)
    got, counts = lm.thickened(blobs + blobs, 0, 1)
    assert (got == np.append(ends, ends)).all() and counts.tolist() == [4, 4]
    keys, counts = np.sort(rng.integers(0, 1 << 64, 100, dtype=np.uint64)), rng.integers(1, 1000, 100)
    rows = [pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, (pa.int64(), pa.int64(), *[pa.binary()] * 4))], lm._COUNTS) for r in lm._blobs(keys, counts, 0, 1)]
    got = lm._summed(rows + rows, 0, 0, 1)
    assert (got[0] == keys).all() and (got[1] == 2 * counts).all()


def test_lm_segment_answers_chunks_together(monkeypatch):
    """What many chunks ask of a segment is one probe; it was one for each chunk, whose number times the buckets grows with the input."""
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 90, dtype=np.uint64) & lm._SHORT)
    texts = pa.RecordBatch.from_pydict({"text": ["a b", "b c", "a a b"]})
    counts = pa.Table.from_batches(lm._count(1)([texts])).to_batches()
    segment = next(lm._added(12, 1)(counts))
    asked = [keys, lm._asked(texts["text"])]
    chunks = [asked[i % 2] for i in range(40)]
    blobs = [segment["segment"][0].as_py(), *(lm.thinned(k, np.zeros(len(k), np.int64), 1)[1][0] for k in chunks)]
    batch = pa.RecordBatch.from_pydict({"q": [0] * 41, "chunk": [lm._SEGMENT, *range(40)], "n": [0] * 41, "keys": blobs, "sizes": [segment["sizes"][0].as_py(), *[None] * 40]})
    calls, levels = [], lm.Filter.levels
    monkeypatch.setattr(lm.Filter, "levels", lambda self, k: calls.append(len(k)) or levels(self, k))
    got = pa.Table.from_batches(lm._looked_up(1)([batch]))
    assert calls == [sum(map(len, chunks))] and got["chunk"].to_pylist() == list(range(40))
    answers = got["levels"].to_pylist()
    assert [len(x) for x in answers] == [len(k) for k in chunks] and set(answers[1::2]) == {answers[1]} and min(answers[1]) > 0


def test_lm_query_asks_segments_at_every_size(spark, monkeypatch):
    fitted, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **b: fitted.append(train(*a, **b)) or fitted[-1])
    lm.query(spark, "/root/testdata/sf0.001")
    assert fitted[0]["segments"] is not None


def test_lm_knows_pairs_seen_once(frame):
    text = [f"w{i}" for i in range(200)]
    train = frame([(1, " ".join(text))])
    asked = frame([(2, " ".join(text)), (3, " ".join(reversed(text)))]).withColumn("held_out", F.lit(True))
    score = {r.doc_id: r.score for r in lm.scored(asked, lm.train(train)).collect()}
    assert score[2] > score[3] + 5


def test_lm_empty(spark, frame):
    docs = frame([]).select("doc_id", "text", F.lit(False).alias("held_out"))
    assert lm.scored(docs, lm.train(docs)).count() == 0
    one = frame([(1, None)]).select("doc_id", "text", F.lit(True).alias("held_out"))
    r = lm.scored(one, lm.train(docs)).first()
    assert r.n_tokens == 1 and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0.0


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path), bpe.Codec(bpe.load(path))


def test_bpe_equals_the_library(tokenizer):
    _, library, codec = tokenizer

    @settings(max_examples=400, deadline=None)
    @given(st.text())
    def check(x):
        e = library.encode(x, add_special_tokens=False)
        ids, decoded = codec.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids and decoded == library.decode(e.ids, skip_special_tokens=False)

    check()
    for x in ["ΑΣ ΟΔΟΣ Σ", "İstanbul", "a<|endoftext|>B <|startoftext|>", "x" * 700 + " " + "abc" * 300, "don't 'S it'S", "½ ² Ⅷ", ":\U0003d000a\U0003d001 \u0558x", ""]:
        check.hypothesis.inner_test(x)


def test_bpe_rows(frame, prose, tokenizer):
    path, library, _ = tokenizer
    want = []
    for d, t in prose:
        e = library.encode(t or "", add_special_tokens=False)
        want.append((d, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    same(rows(bpe.digests(frame(prose), path)), want)
    got = bpe.encoded(frame([(1, "the cat")]), path).first()
    assert got.n_tokens == len(got.ids) and got.decoded == "the</w> cat</w>"
    assert bpe.digests(frame([]), path).count() == 0


def test_licenses_equal_brute_force(frame, prose):
    text = licenses.TEMPLATES
    mit = text["mit"].split()
    docs = [*prose, (500, "intro. " + text["mit"].upper() + " end"), (501, " ".join(mit[:40])), (502, " ".join(w if i % 25 else "xx" for i, w in enumerate(mit))),
            (503, text["mit-line"] + " " + text["cc-by-nc-4.0-line"]), (504, "word " * 3000 + text["gpl-3.0-line"])]
    got = {r.doc_id: {m.license: m.containment for m in r.matches} for r in licenses.scanned(frame(docs)).collect() if r.doc_id and r.doc_id >= 500}
    assert "mit" in got[500] and got[501] == {} and set(got[503]) == {"mit-line", "cc-by-nc-4.0-line"} and set(got[504]) == {"gpl-3.0-line"}
    assert ("mit" in got[502]) == (share(mit, docs[-3][1]) >= licenses.MATCH)
    assert licenses.scanned(frame(prose)).count() == len(prose)
    # the band settings find what MATCH admits
    assert licenses.collision(licenses.MATCH / (licenses.WINDOW * licenses.GROWTH + 1 - licenses.MATCH)) > 0.99


def share(template, text):
    grams = lambda w: {tuple(x.lower() for x in w[i : i + 5]) for i in range(len(w) - 4)}
    t = grams(brute.ALNUM.findall(brute.low(" ".join(template))))
    return len(t & grams(brute.ALNUM.findall(brute.low(text)))) / len(t)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\x0cé\x85\xa0")), max_size=8))
def test_words_and_ngrams(texts):
    import pyarrow as pa

    w = Words(pa.array(texts, pa.string()))
    want = [brute.SPACE.findall(t or "") for t in texts]
    text, starts, ends = w.normal()
    assert [text[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())] == [x for t in want for x in t]
    assert w.counts.tolist() == [len(t) for t in want]
    flat = [x for t in want for x in t]
    assert (len(set(flat)) == len(set(w.hash.tolist()))) and len(ngrams(w.hash, 3)) == max(0, len(flat) - 2)


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    from siftline.llm import textops

    texts = pa.array(["ab cd  " * 20, None, "", "x" * 500, "é ü\tß" * 30, "a"])
    want = Words(texts, lower=True)
    for piece in (1, 7, 64):
        monkeypatch.setattr(textops, "PIECE", piece)
        got = Words(texts, lower=True)
        assert all(np.array_equal(getattr(got, k), getattr(want, k)) for k in ("starts", "ends", "first", "row", "hash"))


def test_word_hashes_are_sums_of_powers():
    """A word's hash is the sum of its bytes' codes times the powers of their places, wherever it stands; running sums give just that."""
    from siftline.llm import textops

    texts, most = ["ab " * 5 + "é", "x" * 300, "y ab"], 1 << 64
    code, step = [int(x) for x in textops._BYTE], int(textops._STEP)
    want = []
    for w in (w for t in texts for w in t.split()):
        data = w.encode()
        x = sum(code[b] * pow(step, i, most) for i, b in enumerate(data)) % most ^ len(data) * 0x9FB21C651E98DF25 % most
        want.append(int(textops.mix(np.array([x], np.uint64))[0]))
    assert Words(pa.array(texts)).hash.tolist() == want


def test_word_memory_of_a_long_text():
    """Beside the words' spans and hashes only pieces are held: some bytes a byte of text."""
    import tracemalloc

    import pyarrow as pa

    text = pa.array(["word " * 2_000_000])
    tracemalloc.start()
    Words(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * 10_000_000


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for width in (1, 2, 5, 16, 17, 50, 51):
        assert sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(50 - width + 1)]


def test_jaccard_carries_each_set_once(frame, monkeypatch):
    """Copies in several tasks cost a fingerprint each; their set is written for one of them."""
    held, real = [], jaccard.written_at

    def spied(df):
        out = real(df)
        if "set" in out[0].columns:
            held.append(out[0].where("set is not null").count())
        return out

    monkeypatch.setattr(jaccard, "written_at", spied)
    text = "one two three four five six seven eight nine ten"
    found = rows(jaccard.near_duplicates(frame([(i, text) for i in range(12)], parts=6)))
    assert held == [1] and {r[2] for r in found} == {0}
