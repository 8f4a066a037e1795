import hashlib
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import embeddings, langid, toxicity, warc
from siftline.llm.common import scratch
from siftline.llm.components import components

from . import brute


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- language identification


def test_langid_held_out_accuracy(spark, small):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = langid.query(spark, small).collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_langid_edge_rows(spark, frame):
    path = langid.vocabulary_path()
    docs = [(i, "the cat and the dog with you") for i in range(4)] + [(i, "der Hund und die Katze mit dir") for i in range(4, 8)]
    df = frame(docs).withColumn("lang", F.when(F.col("doc_id") < 4, "en").otherwise("de"))
    model = langid.train(df, path)
    odd = frame([(1, None), (1, ""), (2, "123 … !"), (3, "THE DOG"), (None, "die Katze"), (4, "日本語"), (5, "the " * 20000)])
    got = sorted((r.text[:9] if r.text else r.text, r.lang_pred) for r in langid.predicted(odd, model).collect() if r.text is not None)
    assert ("", "und") in got and ("123 … !", "und") in got and ("THE DOG", "en") in got and ("die Katze", "de") in got and ("the the t", "en") in got
    assert dict(got)["日本語"] in ("de", "en")
    assert [r.lang_pred for r in langid.predicted(odd.where("text is null"), model).collect()] == ["und"]
    none = langid.predicted(odd, langid.train(df.where("false"), path))
    assert all(r.lang_pred == "und" and r.score == 0 for r in none.collect())
    assert langid.predicted(frame([]), model).count() == 0


def test_langid_cuts_long_texts_between_words(spark, small, frame, monkeypatch):
    docs = frame([(1, "the cat and the dog, with you " * 4), (2, "der Hund-und-die Katze " * 5), (3, "x" * 90 + " 12"), (4, "…" * 80), (5, "")])
    train = docs.where("doc_id < 3").withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("de"))
    got = []
    for size in (langid.SLICE, 40):
        monkeypatch.setattr(langid, "SLICE", size)
        monkeypatch.setattr(langid.sliced, "__defaults__", (size,))
        model = langid.train(train, langid.vocabulary_path())
        got.append(sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predicted(docs, model).collect()))
    assert got[0] == got[1] and [x[1] for x in got[0]][:2] == ["en", "de"]


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁", "a", "ab", "b", "▁ab"]
    v = langid.Vocabulary(pieces, langid.letter_tables())
    p = np.array([0.1, 0.2, 0.3, 0.05, 0.25, 0.1, 0.0])[:, None]
    codes, _, starts, ends, _, _ = v.words(["ab"])
    got = math.exp(langid.log_probs(v, codes, starts, ends, p)[0, 0])
    by = dict(zip(pieces, p[:, 0]))
    want = by["▁ab"] + by["▁a"] * by["b"] + by["▁"] * by["ab"] + by["▁"] * by["a"] * by["b"]
    assert abs(got - want) < 1e-12
    # expected counts of a segmentation lattice: every letter position is covered once
    use = langid.expected_counts(v, codes, starts, ends, np.ones((1, 1)), p[:, 0])[:-1, 0]
    assert abs(sum(u * len(x) for u, x in zip(use, pieces)) - 3) < 1e-9


def test_forward_of_long_words():
    v = langid.Vocabulary(["▁", "a", "aa"], langid.letter_tables())
    p = np.array([0.2, 0.5, 0.3, 0.0])[:, None]
    codes, _, starts, ends, _, _ = v.words(["a" * 400])
    got = langid.log_probs(v, codes, starts, ends, p)[0, 0]
    f = [math.log(0.2), math.log(0.2 * 0.5)]
    for _ in range(399):
        f.append(np.logaddexp(f[-1] + math.log(0.5), f[-2] + math.log(0.3)))
    assert abs(got - f[400]) < 1e-6 * abs(got)
    use = langid.expected_counts(v, codes, starts, ends, np.ones((1, 1)), p[:, 0])[:-1, 0]
    assert abs(use[1] + 2 * use[2] - 400) < 1e-4


def test_words_of_many_letters(monkeypatch):
    """The walk over positions gives what the arrays of whole words give; memory does not follow the word."""
    vocabulary = langid.Vocabulary(langid.pieces_of(langid.vocabulary_path()), langid.letter_tables())
    rng = np.random.default_rng(2)
    probs = np.vstack([rng.random((len(vocabulary.keys), 3)) ** 8 / 1e3, np.zeros(3)])
    start = langid._start(len(vocabulary.keys))
    codes, _, starts, ends, _, _ = vocabulary.words([" ".join("".join(rng.choice(list("abdeinorst日é"), n)) for n in (1, 40, 256, 257, 700))])
    weight = rng.random((len(starts), 3))
    both = []
    for long, walk in ((1 << 30, 1), (2, 50), (2, 1 << 14)):
        monkeypatch.setattr(langid, "LONG", long)
        monkeypatch.setattr(langid, "WALK", walk)
        both.append((langid.log_probs(vocabulary, codes, starts, ends, probs), langid.expected_counts(vocabulary, codes, starts, ends, weight, start)))
    for logs, counts in both[1:]:
        assert np.allclose(logs, both[0][0], rtol=1e-12) and np.allclose(counts, both[0][1], rtol=1e-9, atol=1e-12)
    monkeypatch.undo()
    import tracemalloc

    codes, _, starts, ends, _, _ = vocabulary.words(["".join(rng.choice(list("abdeinorst"), 200_000))])
    tracemalloc.start()
    langid.log_probs(vocabulary, codes, starts, ends, probs)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_langid_of_a_text_without_a_break(spark, frame):
    """Letters without a break are one word, in training and prediction."""
    docs = [(i, "the cat and the dog with you") for i in range(4)] + [(i, "der Hund und die Katze mit dir") for i in range(4, 8)]
    long = (8, "thedogandthecat" * 10_000)
    df = frame([*docs, long]).withColumn("lang", F.when(F.col("doc_id").between(4, 7), "de").otherwise("en"))
    model = langid.train(df, langid.vocabulary_path())
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(df.select("doc_id", "text"), model).select("doc_id", "lang_pred", "score").collect()}
    assert got[8] == ("en", 1.0) and got[4][0] == "de" and len(got) == 9


# ---- WARC


def pages_of(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string")


PAGES = [
    (1, "http://a.example/x?y=1", "<html>" + "é" * 200 + "</html>"), (2, None, None), (3, "http://b.example", "short"), (4, "http://c.example/", "short"),
    (5, "https://d.example/p", "<html>" + "é" * 200 + "</html>"), (6, "u v\r\nw", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 5), (7, "http://e.example/", "y" * 99), (8, "http://e.example/", "y" * 99),
    (9, "http://e.example/", "z" * 100), (10, "http://e.example/", "z" * 100), (0, "http://f.example/", "z" * 100), (11, "", "big " * 100_000),
]


def test_warc_round_trip(spark):
    path = scratch(spark)
    warc.write(pages_of(spark, PAGES).repartition(3), path)
    got = {r.page_id: r for r in warc.transactions(warc.parsed(spark, path, payloads=True)).collect()}
    assert len(got) == len(PAGES)
    for page, url, html in PAGES:
        r, raw = got[page], (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "")]
        first = min(same) if len(raw) >= 100 else page
        if first == page:
            assert r.response.type == "response" and r.response.payload == (html or "") and r.response.bytes == len(raw)
            assert r.response.digest == r.response.declared == hashlib.sha256(raw).hexdigest() and r.resolved is None
        else:
            assert r.response.type == "revisit" and r.response.payload is None and r.resolved.page_id == first
            assert r.response.declared == r.resolved.digest == hashlib.sha256(raw).hexdigest() and r.resolved.bytes == len(raw)
        assert r.request is not None and r.metadata.fields["page-id"] == str(page)
    raw = spark.read.format("binaryFile").load(path).where("path like '%.warc.gz'").collect()
    ids, referred = set(), set()
    for x in raw:
        for member in warc.members(bytes(x.content)):
            assert member.startswith(b"WARC/1.1\r\n") and member.count(b"WARC-Record-ID: ") == 1  # a member a record
        for h, _ in warc.records(bytes(x.content)):
            assert h["WARC-Record-ID"] not in ids
            ids.add(h["WARC-Record-ID"])
            referred |= {h["WARC-Refers-To"]} if "WARC-Refers-To" in h else set()
    assert len(ids) >= 3 * len(PAGES) and referred and referred <= ids  # any reader resolves revisits
    assert got[6].metadata.fields["page-url"] == '"u v\\r\\nw"' and got[6].response.url == "u%20v%0D%0Aw"
    assert {x.path.rpartition("/")[2] for x in raw if not x.path.endswith(".warc.gz")} == set()


def test_warc_files_are_bounded_by_bytes(spark, monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(warc, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(warc, "BLOCKS", 4)
    pages = [(i, f"http://x.example/{i}", rng.integers(0, 1 << 62, 60).astype(str).tobytes().decode("utf-32-le").replace("\0", "")) for i in range(60)]
    pages += [(100 + i, "http://x.example/same", pages[3][2]) for i in range(30)]
    path = scratch(spark)
    warc.write(pages_of(spark, pages).repartition(2), path)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) > 4 and max(sizes) < 4 * 6000
    got = warc.transactions(warc.parsed(spark, path)).collect()
    assert len(got) == 90 and sum(r.response.type == "revisit" and r.resolved.page_id == 3 for r in got) == 30


def test_warc_missing_records_and_repeats(spark):
    path = scratch(spark)
    warc.write(pages_of(spark, [(1, "u", "p" * 200), (1, "u", "p" * 200), (2, "u", "p" * 200), (None, "u", "p" * 200), (3, "u", "q")]), path)
    records = warc.parsed(spark, path)
    full = warc.transactions(records).collect()
    assert len(full) == 5
    kinds = sorted((r.page_id or -1, r.response.type, r.resolved.page_id if r.resolved else None) for r in full)
    assert kinds == [(-1, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None)]
    part = warc.transactions(records.where("type not in ('request')")).collect()
    assert len(part) == 5 and all(r.request is None for r in part)
    assert len(warc.transactions(records.where("type <> 'metadata'")).collect()) == 5
    empty = scratch(spark)
    warc.write(pages_of(spark, []), empty)
    assert warc.transactions(warc.parsed(spark, empty)).count() == 0


# ---- embeddings


def vectors(rng, groups, dim=16):
    out = []
    for size, spread in groups:
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        out += [(centre + spread * rng.normal(size=dim)).astype(np.float32) for _ in range(size)]
    return out


def brute_links(data):
    rows = []
    for i, x in data:
        bad = i is None or not x or None in x or not np.isfinite(np.array(x, np.float64)).all() or not np.any(x)
        rows.append((i, None if bad else np.array(x, np.float64) / np.linalg.norm(np.array(x, np.float64))))
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] is not None and rows[b][1] is not None and rows[a][1] @ rows[b][1] >= 0.95:
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, links[i], least.get(root(i)), d is None or d == least[root(i)]) for i, (d, _) in enumerate(rows)]


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    found = vectors(rng, [(1, 0.0)] * 150 + [(12, 0.03), (30, 0.04), (3, 0.001), (8, 0.08)])
    data = [(i, [float(x) for x in v]) for i, v in enumerate(found)]
    data += [(1000 + i, data[3][1]) for i in range(40)] + [(2000, [2 * x for x in data[5][1]])]  # copies, another length
    data += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0] * 15 + [None]), (3004, [float("nan")] * 16), (3005, [float("inf")] + [0.0] * 15), (None, data[3][1]), (-4, data[3][1]), (7, data[7][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).repartition(4)
    got = rows(embeddings.near_duplicates(df))
    want = sorted(brute_links(data), key=repr)
    assert got == want
    assert [g for g in got if g[0] is None or g[0] >= 3000] == [w for w in want if w[0] is None or w[0] >= 3000]


def test_embeddings_small_and_empty(spark):
    kind = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    assert rows(embeddings.near_duplicates(spark.createDataFrame([(5, None)], kind))) == [(5, 0, 5, True)]
    assert rows(embeddings.near_duplicates(spark.createDataFrame([(5, [1.0, 0.0]), (3, [1.0, 0.01]), (4, [0.0, 1.0])], kind))) == [(3, 1, 3, True), (4, 0, 4, True), (5, 1, 3, False)]


def frame_of(spark, data):
    return spark.createDataFrame([(i, len(v), 1, (v / np.linalg.norm(v)).astype(np.float64).tobytes()) for i, v in enumerate(data)], "id long, dim int, copies long, v binary")


def test_embeddings_audit_sees_links_that_were_all_missed(spark, monkeypatch):
    """5% of the vectors are linked, in pairs of two; a search that misses 30% of the pairs is noticed and made good."""
    rng = np.random.default_rng(4)
    data = vectors(rng, [(1, 0.0)] * 3800 + [(2, 0.001)] * 100, dim=32)
    true = [(3800 + 2 * i, 3801 + 2 * i) for i in range(100)]
    frame = frame_of(spark, data)
    links = lambda found: spark.createDataFrame([(embeddings.COUNT, x, None, 1) for p in found for x in p], "kind byte, a long, b long, n long")
    counts = lambda found: embeddings.link_counts(links(found))
    assert embeddings.recall(frame, counts(true)) == 1.0
    assert embeddings.recall(frame, counts(true[:70])) < 0.85
    found = embeddings.exact_links(frame).collect()
    assert sorted((r.a, r.b) for r in found if r.kind == embeddings.CONNECTED) == true
    assert sorted((r.a, r.n) for r in found if r.kind == embeddings.COUNT) == [(i, 1) for i in range(3800, 4000)]
    monkeypatch.setattr(embeddings, "near_links", lambda *_: links([]))
    rows_ = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    report = {}
    assert embeddings.near_duplicates(rows_, report=report).where("n_links = 1").count() == 200
    assert report == {"recall": [0.0] * 3, "exhaustive": True}


def test_embeddings_of_several_lengths(spark):
    """Vectors of each length link among themselves, however few they are."""
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(rng, [(1, 0.0)] * 40 + [(5, 0.02)], dim=8))]
    data += [(100, [1.0, 0.0]), (101, [1.0, 0.01]), (102, [0.0, 1.0]), (103, [3.0]), (104, [0.5]), (105, [-1.0]), (106, [1e-310, 0.0]), (107, [1e300, 1e298])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got[100] == (3, 100) and got[101] == (3, 100) and got[102] == (0, 102) and got[103] == (1, 103) and got[104] == (1, 103) and got[105] == (0, 105)
    assert got[106] == (3, 100) and got[107] == (3, 100) and all(got[i] == (4, 40) for i in range(40, 45))


def symmetric(spark, frame, **settings):
    """The counts are those of the pairs that were found, each pair once and counted at both ends; and what is connected is what they connect."""
    found = embeddings.near_links(frame, pairs=True, **settings)
    pairs = [(r.a, r.b) for r in found.where(f"kind = {embeddings.PAIR}").collect()]
    assert len(set(pairs)) == len(pairs) and all(a < b for a, b in pairs)
    ends = {}
    for p in pairs:
        for x in p:
            ends[x] = ends.get(x, 0) + 1
    assert {r.id: r.linked for r in embeddings.link_counts(found).collect()} == ends
    label = lambda kind: {r.node: r.component for r in components(found.where(f"kind = {kind}").select("a", "b")).collect()}
    assert label(embeddings.PAIR) == label(embeddings.CONNECTED)
    return pairs


def test_embeddings_large_shards_and_dense_groups(spark, monkeypatch):
    """Shards are dealt on until they are small; the counts equal the union of the pairs found, exactly."""
    rng = np.random.default_rng(6)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(rng, [(1, 0.0)] * 300 + [(90, 0.02), (20, 0.03)], dim=16))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(embeddings, "MOST_SHARDS", 2)
    monkeypatch.setattr(embeddings, "LARGE", 12 * embeddings.SHARD // 60)
    frame = frame_of(spark, [np.array(v) for _, v in data])
    members = embeddings.sharded(frame, shard=60)
    assert members.groupBy("shard").count().agg(F.count("*")).first()[0] > 4
    pairs = symmetric(spark, frame, shard=60)
    v = np.array([x for _, x in data])
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = {(a, b) for a, b in zip(*np.nonzero(v @ v.T >= 0.95)) if a < b}
    assert set(pairs) <= want and len(pairs) >= 0.97 * len(want)
    report = {}
    got = rows(embeddings.near_duplicates(df, report=report))
    assert len(got) == len(data) and sum(r[1] for r in got) % 2 == 0 and report["recall"][0] >= 0.97


def test_embeddings_of_one_dense_cone(spark, monkeypatch):
    """A group in which nearly all are linked is searched in bounded pieces."""
    rng = np.random.default_rng(11)
    frame = frame_of(spark, vectors(rng, [(900, 0.033), (1, 0.0)], dim=32))
    monkeypatch.setattr(embeddings, "CELLS", 1 << 14)
    found = embeddings.near_links(frame)
    counts = {r.id: r.linked for r in embeddings.link_counts(found).collect()}
    assert sum(counts.values()) % 2 == 0
    assert embeddings.recall(frame, embeddings.link_counts(found)) >= 0.97
    symmetric(spark, frame)


def test_embeddings_of_equal_vectors_that_nothing_tells_apart(spark, monkeypatch):
    """Dealing large shards on ends where it does not make them smaller."""
    monkeypatch.setattr(embeddings, "LARGE", 1)
    frame = frame_of(spark, [np.array([1.0, 0.0])] * 40)
    assert embeddings.sharded(frame, shard=4).select("id").distinct().count() == 40


def test_robust_prune_and_search():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    lists = embeddings.robust_prune(v, 40, 8, 1.2)
    assert all(len(x) <= 8 and i not in x for i, x in enumerate(lists)) and all(len(x) for x in lists)
    src = np.repeat(np.arange(300), [len(x) for x in lists])
    dst = np.concatenate(lists)
    both = np.unique(np.concatenate([src * 300 + dst, dst * 300 + src]))
    heads = np.searchsorted(both // 300, np.arange(301))
    qi, nodes = embeddings.search(v, heads, both % 300, np.arange(300), 0, 24, 0.8)
    want = {(a, b) for a, b in zip(*np.nonzero(v @ v.T >= 0.8))}
    got = set(zip(qi.tolist(), nodes.tolist()))
    assert got <= want and len(got) >= 0.98 * len(want)


# ---- toxicity


def toxic_corpus(n=1500):
    rng = random.Random(4)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["idiot", "vumro", "zekla", "qopti"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 80))]
        y = int(rng.random() < 0.15)
        if y:
            for _ in range(rng.randint(1, 4)):
                x = rng.choice(bad)
                w.insert(rng.randrange(len(w)), x if x == "idiot" else x + rng.choice("abcdef") + rng.choice("abcdef"))
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    return docs, labels


def test_toxicity_held_out(spark, frame):
    docs, labels = toxic_corpus()
    df = frame(docs).select("doc_id", "text", F.expr("crc32(cast(doc_id as string)) % 3 = 1").alias("held_out"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df.where("not held_out"), lab.where("crc32(cast(doc_id as string)) % 3 <> 1"))
    truth = dict(labels)
    got = [r for r in toxicity.scored(df, model).collect() if r.held_out]
    hit = sum(r.predicted and truth[r.doc_id] for r in got)
    assert hit >= 0.9 * sum(truth[r.doc_id] for r in got) and sum(r.predicted and not truth[r.doc_id] for r in got) <= 2
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    odd = frame([(1, None), (1, ""), (None, "you idiot"), (2, "abc " * 30000)]).select("doc_id", "text", F.lit(False).alias("held_out"))
    out = {(r.doc_id, round(r.score, 3)) for r in toxicity.scored(odd, model).collect()}
    assert len(out) >= 2 and toxicity.scored(odd, model).count() == 4
    assert toxicity.scored(df.where("false"), model).count() == 0


def test_toxicity_without_labels(spark, frame):
    df = frame([(1, "you idiot"), (2, "good day")]).select("doc_id", "text", F.lit(False).alias("held_out"))
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.scored(df, model).collect()}
    assert got == {1: 1, 2: 0}


def test_label_model_shares_weight():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.2
    votes = np.column_stack([(rng.random(3000) < np.where(y, 0.6, 0.01)) for _ in range(4)])
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0]])  # two copies of one voter
    m = toxicity.LabelModel(votes, np.ones(6, bool), 0.2)
    assert m.weight[0] < 0.6 and m.weight[1] > 0.8
    assert ((m.labels > 0.5) == y).mean() > 0.9


def test_label_model_uses_clean_voters():
    """Accuracies come from the votes alone: a voter at chance gets no say, a clean voter pulls the other way."""
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.15
    toxic = np.column_stack([(rng.random(4000) < np.where(y, 0.5, 0.01)) for _ in range(5)])
    chance = rng.random(4000) < 0.3
    clean = rng.random(4000) < np.where(y, 0.05, 0.6)
    m = toxicity.LabelModel(np.column_stack([toxic, chance, clean]), np.array([True] * 6 + [False]), 0.15)
    say = np.log(m.hit / m.miss) * m.weight
    assert (say[:5] > 2).all() and abs(say[5]) < 0.3 and say[6] < -1
    assert ((m.labels > 0.5) == y).mean() > 0.95 and m.accuracy[0] > 0.8


# ---- pipeline


def test_pipeline_equals_plain_stages(spark, small):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = [(r.doc_id, r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    groups = {d: c for d, _, c in brute.jaccard(kept)}
    kept = [(d, t) for d, t in kept if groups[d] == d]
    kept = [(d, k) for d, _, _, k in brute.substrings(kept) if k]
    bad = {d for d, *_, c in brute.contamination(kept, bench) if c}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, text in kept:
        if d not in bad:
            e = t.encode(text, add_special_tokens=False)
            want.append((d, len(e.ids), brute.sha(np.array(e.ids, "<u4").tobytes()), brute.sha(t.decode(e.ids, skip_special_tokens=False))))
    assert rows(corpus_pipeline.run(spark, small)) == sorted(want, key=repr)


def test_pipeline_keeps_different_texts_of_one_id(spark, small, frame):
    """Of rows that share an id only near copies go, whatever the partitioning; of rows equal in all columns one stays."""
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    data = [(1, a), (1, b), (1, a + " tail"), (2, a), (2, c), (3, c), (3, c), (None, b), (None, "un named text here"), (4, None), (4, ""), (5, "y z"), (5, "y z")]
    kept = []
    for n in (1, 3, 7):
        out = corpus_pipeline.jaccard_join(spark, frame(data, n), small).collect()
        kept.append(sorted((r.doc_id or 0, r.text or "") for r in out))
    assert kept[0] == kept[1] == kept[2]
    left = kept[0]
    assert (1, b) in left and (2, c) in left and (0, "un named text here") in left and left.count((5, "y z")) == 1
    assert sum(t.startswith("a0 ") for _, t in left) == 1 and sum(t == c for _, t in left) == 1 and sum(t == b for _, t in left) == 1
    assert left.count((4, "")) == 2  # without words: linked with nothing


def test_pipeline_stages_keep_the_columns(spark, small, frame):
    import corpus_pipeline

    docs = frame([(1, "the cat sat on the mat with a dog"), (1, "the cat sat on the mat with a dog"), (2, None), (3, ""), (None, "some words in here and more"), (4, "123")])
    clashes = ("lang_pred", "score", "_k", "_fp", "kept", "n_words", "component", "n", "spans", "copies", "d_doc_id", "n_hit")
    docs = docs.withColumns({c: F.lit(c) for c in clashes})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.collect()
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, small).collect() if r.doc_id in (2, 3, 4)] == []
