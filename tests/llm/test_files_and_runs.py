"""Token files, the Merkle manifest and periodic runs against plain versions."""
import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import merkle, periodic, tokenfile
from siftline.llm.common import scratch

from . import brute
from .test_text_operators import rows, same


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(tokenizer_path())
    out.no_padding()
    out.no_truncation()
    return out


# ---- token files


def test_numbers_come_back():
    rng = np.random.default_rng(0)
    for sizes in ([], [0], [1], [3, 0, 4], [5, 1001, 2]):
        sizes = np.array(sizes, np.int64)
        for most in (2, 256, 257, 1 << 16, 1 << 20, 1 << 32):
            x = rng.integers(0, most, int(sizes.sum())).astype(np.uint32)
            control, data, own = tokenfile.pack(x, sizes)
            assert len(control) == sum(-(-n // 4) for n in sizes) and len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in x) == own.sum() and len(own) == len(sizes)
            assert (tokenfile.unpack(control, data, sizes) == x).all()
    control, data, _ = tokenfile.pack(np.array([1, 300], np.uint32), np.array([2]))
    assert control.tolist() == [0b0100] and data.tolist() == [1, 300 & 255, 1]
    for sizes in ([1], [9]):
        with pytest.raises(ValueError, match="agree"):
            tokenfile.unpack(control, data, np.array(sizes))


def in_order(docs):
    """(doc_id, text) as the files have them but for equal ids: null first, by id."""
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))


def test_token_files_equal_the_library(spark, frame, prose):
    odd = [(901, "naïve Σίσυφος ＡＢ\x1c x y <|endoftext|>z\u0085 don't WE'RE 12ab34"), (902, "Å = ̸ ̸a  b"), (903, "<|startoftext|><|endoftext|>"), (-(1 << 63), "least id"), (904, "日本語 текст 🙂🙂")]
    docs = [*prose, *odd]
    path, model = scratch(spark), library()
    tokenfile.write(frame(docs), tokenizer_path(), path, end=1)
    got = tokenfile.read(spark, path).collect()
    want = [(d, model.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in docs]
    same([(r.doc_id, r.n_tokens, tuple(r.ids)) for r in got], [(d, len(x), tuple(x)) for d, x in want])
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in in_order(docs)]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    counts = {}
    for _, x in want:
        for i in x:
            counts[i] = counts.get(i, 0) + 1
    assert [(r.n, r.id) for r in ranks] == sorted(((n, i) for i, n in counts.items()), key=lambda x: (-x[0], x[1]))
    digests = {(r.doc_id, r.start): r.ids for r in tokenfile.read(spark, path, digest=True).collect()}
    assert digests == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4")) for r in got}
    # the staged ids are gone
    assert not spark.sparkContext._jvm.java.io.File(path.removeprefix("file://") + "/staged").exists()


def test_token_files_of_long_texts_and_none(spark, frame, monkeypatch):
    monkeypatch.setattr(tokenfile, "SLICE", 1000)
    encoder, model = tokenfile.Encoder(open(tokenizer_path(), encoding="utf-8").read(), "<u4"), library()
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "Ünï\n", "x", "\t", "12", " "]) for _ in range(9000)) + "y" * 3000
    assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(tokenfile, "REMEMBERED", 10)  # a memory that is always full changes nothing
    assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids
    path = scratch(spark)
    tokenfile.write(frame([]), tokenizer_path(), path, end=1)
    assert tokenfile.read(spark, path).count() == 0
    long = [(1, "word " * 60_000), (2, None), (3, "a b c " * 20_000)]  # blocks of one long text, and of the end id alone
    path = scratch(spark)
    tokenfile.write(frame(long), tokenizer_path(), path)
    assert [(r.doc_id, r.start, r.n_tokens) for r in tokenfile.read(spark, path).orderBy("start", "n_tokens").collect()] == [(1, 0, 60_000), (2, 60_000, 0), (3, 60_000, 60_000)]


def test_token_files_send_letters_past_the_pattern(monkeypatch):
    """Stretches of Latin letters need the library's model alone, and give its ids; a file that does not allow that is used whole."""
    import public_tokenizers

    source, model = open(tokenizer_path(), encoding="utf-8").read(), library()
    rng, letters = random.Random(2), [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
    words = [*letters, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)), "naïve", "ÉTÉ", "straße", "a" * 500]
    text = " ".join(words)
    want = model.encode(text, add_special_tokens=False).ids
    alone = tokenfile.Encoder(source, "<u4")
    alone.model = None  # would fail on the first stretch that is sent to it
    assert np.frombuffer(alone.encode(text.encode()), "<u4").tolist() == want
    odd = "É\u0301 x× ÷y é\u0301é İi ΑΣ Éa,b don't été's 1é2 ÿŸ <|endoftext|> A\u0301b\u0301"
    for short in (tokenfile.plain, lambda _: None):
        monkeypatch.setattr(tokenfile, "plain", short)
        for t in (text, odd):
            assert np.frombuffer(tokenfile.Encoder(source, "<u4").encode(t.encode()), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids
    monkeypatch.undo()
    assert tokenfile.plain(source) and tokenfile.plain(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()) is None


def test_token_files_remember_half_a_million_words():
    """A worker's memory holds the words of some hundred MB of text; the former one held some 200,000."""
    encoder, letters = tokenfile.Encoder(open(tokenizer_path(), encoding="utf-8").read(), "<u2"), "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in letters).encode()
    first = encoder.encode(text)
    encoder.letters = encoder.model = None
    assert encoder.encode(text) == first and len(first) > 400_000


def test_token_files_notice_damage(spark, frame):
    path, bad = scratch(spark), scratch(spark)
    tokenfile.write(frame([(1, "the cat"), (2, "a dog")]), tokenizer_path(), path)
    for name in ("ranks", "shards"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{bad}/{name}")
    spark.read.parquet(f"{path}/blocks").withColumn("crcs", F.transform("crcs", lambda x: x + 1)).write.parquet(f"{bad}/blocks")
    with pytest.raises(Exception, match="damaged"):
        tokenfile.read(spark, bad).collect()


def test_token_files_refuse_tokenizers_that_look_across_white_space():
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        tokenfile.cutting(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


# ---- Merkle manifest


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_proof(levels, i, digest, fanout):
    siblings = []
    for level in levels[:-1]:
        first = i - i % fanout
        run = level[first : first + fanout]
        others = run[: i - first] + run[i - first + 1 :]
        siblings += others
        digest, i = H(*others[: i - first], digest, *others[i - first :]), i // fanout
    return siblings, digest


def plain_manifest(docs, fanout=2, changed=lambda d: d):
    """Per row of (doc_id, text, lang, source, n_chars): doc_id, leaf, subroot, root, H of the siblings, folded root."""
    fields = lambda d: (d[0], d[3], d[2], d[4], d[1])
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append((d, H(*map(field, fields(d)))))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for rows_ in groups.values():
        rows_.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    low = {k: plain_tree([x for _, x in groups[k]], fanout) for k in names}
    high = plain_tree([low[k][-1][0] for k in names], fanout)
    out = []
    for g, k in enumerate(names):
        for i, (d, x) in enumerate(groups[k]):
            s, y = plain_proof(low[k], i, H(*map(field, fields(changed(d)))), fanout)
            t, y = plain_proof(high, g, y, fanout)
            out.append((d[0], x, low[k][-1][0], high[-1][0], H(*s, *t), y))
    return out


def manifest_rows(df, fanout=2, levels=None):
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    got = merkle.folded(merkle.manifest(df, merkle.leaf(*map(F.col, fields)), fanout=fanout, levels=levels), fanout=fanout, keep=("doc_id", "leaf", "subroot", "root"))
    return [tuple(x if i == 0 else bytes(x).hex() for i, x in enumerate(r)) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_digest", "folded").collect()]


@pytest.mark.parametrize("fanout, levels", [(2, None), (2, 1), (2, 3), (3, 2), (5, 1)])
def test_manifest_equals_plain_trees(spark, fanout, levels):
    rng = random.Random(fanout)
    docs = [(i, f"text {i % 7} é", rng.choice(["en", "de", "", "zz", "é"]), rng.choice(["a", None]), rng.choice([None, i])) for i in range(83)]
    docs += [(1000, None, None, None, None), (2000, "alone", "xx", "s", 1 << 62), (None, "no id", "en", "s", 3), (None, "no id", None, "s", 3), (None, "z", "en", "s", 3)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    same(manifest_rows(df, fanout, levels), plain_manifest(docs, fanout))


def test_manifest_of_few_rows_and_repeats(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, tree string, k_shown int"
    make = lambda rows_: spark.createDataFrame([(*r, "t", 1) for r in rows_], kind)  # noqa: E731  columns that clash with inner names do no harm
    assert manifest_rows(make([])) == []
    one = [(5, "x", "en", "s", 1)]
    same(manifest_rows(make(one)), plain_manifest(one))
    assert plain_manifest(one)[0][1] == plain_manifest(one)[0][3]
    many = [(5, "x", "en", "s", 1)] * 5 + [(None, None, None, None, None)] * 3 + [(6, "long " * 200_000, "fr", "s", 2)]
    same(manifest_rows(make(many)), plain_manifest(many))


def test_manifest_query_finds_what_was_changed(spark, small, tmp_path):
    """The largest n_chars, null ids and nulls are no errors; a changed row and no other fails."""
    docs = [(i, f"t{i}", "en" if i % 3 else None, "s", (1 << 63) - 1 if i < 30 else None if i < 40 else i) for i in range(70)] + [(None, "x", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    tampered = lambda d: d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[4] is not None
    want = plain_manifest(docs, changed=lambda d: (*d[:4], d[4] + 1) if tampered(d) else d)
    got = merkle.query(spark, str(tmp_path)).collect()
    same([tuple(r)[:6] for r in got], want)
    assert {r.doc_id for r in got if not r.verified} == {d[0] for d in docs if tampered(d)} and len(got) == len(docs)


def test_fold_refuses_other_places():
    levels = plain_tree([H(str(i)) for i in range(9)], 2)
    siblings, _ = plain_proof(levels, 5, levels[0][5], 2)
    proof, root = bytes.fromhex("".join(siblings)), bytes.fromhex(levels[-1][0])
    assert merkle.fold(bytes.fromhex(levels[0][5]), 5, 9, proof) == (root, b"")
    assert merkle.fold(bytes.fromhex(levels[0][5]), 4, 9, proof)[0] != root and merkle.fold(bytes.fromhex(levels[0][4]), 5, 9, proof)[0] != root


# ---- periodic runs


def plain_runs(w, least=24):
    out = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(least, 3 * p):
                out.setdefault((s, i - s + p), p)
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def plain_periodic(doc, text):
    w = brute.SPACE.findall(text or "")
    n = len(w)
    if doc is not None and n and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, brute.sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)),
            brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_plain_search(monkeypatch):
    rng = random.Random(3)
    for trial in range(400):
        monkeypatch.setattr(periodic, "PAIRS", rng.choice([1, 7, 1 << 19]))
        texts = []
        for _ in range(rng.randint(1, 5)):
            letters, n = rng.choice([1, 2, 3, 40]), rng.choice([0, 1, 23, 24, 25, 70, 130])
            w = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                p, a = rng.randint(1, max(1, n // 3)), rng.randrange(n)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if n and rng.random() < 0.3:
                w[rng.randrange(n)] = 99
            texts.append(w)
        first = np.cumsum([0] + [len(w) for w in texts])
        got = periodic.runs(np.array([c for w in texts for c in w], np.uint64), first)
        assert got[:, [0, 1, 2, 3]].tolist() == [[i, *r] for i, w in enumerate(texts) for r in plain_runs(w)]


def test_periodic_query_equals_plain_version(spark, prose, tmp_path):
    rng = random.Random(9)
    repeats = []
    for i in range(200):
        base = [rng.choice(["a", "b", "cc", "é", "The"]) for _ in range(rng.randint(1, 12))]
        repeats.append((1000 + i, rng.choice([" ", "\n ", "\t"]).join((base * rng.randint(2, 30))[: rng.randint(1, 150)] + [rng.choice("xyz") for _ in range(rng.randint(0, 9))])))
    docs = [*prose, *repeats, (5000, "w " * 3000), (5001, " ".join(str(i % 900) for i in range(2700))), (5002, " ".join(str(i % 901) for i in range(2700)))]
    spark.createDataFrame([(*d, "en", 7) for d in docs], "doc_id long, text string, start string, _crc long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = [plain_periodic(*d) for d in docs]
    assert sum(w[1] > 0 for w in want) > 60
    same(rows(periodic.query(spark, str(tmp_path))), want)


def test_periodic_lists_runs_and_texts(spark, frame):
    df = frame([(1, "x " + "a b " * 12 + "c"), (2, None), (3, "")])
    got = {r.doc_id: r for r in periodic.periodic(df).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 24, 2)] and got[1].collapsed == "x a b c" and got[1].n_words == 26
    assert (got[2].n_words, got[2].n_runs, got[2].length, got[2].collapsed) == (0, 0, None, "") == (got[3].n_words, got[3].n_runs, got[3].length, got[3].collapsed)
    assert periodic.periodic(df.where("false")).count() == 0


def test_words_that_share_a_hash_are_told_apart(spark, frame, monkeypatch):
    """Runs are verified on the words: with a hash that tells nothing apart, the answer stays."""
    import pyarrow as pa

    class Blind(periodic.Words):
        def __init__(self, column):
            super().__init__(column)
            self.hash = np.zeros_like(self.hash)

    monkeypatch.setattr(periodic, "Words", Blind)
    text = "a b c " * 10 + " ".join(f"w{i}" for i in range(30))
    batch = pa.RecordBatch.from_arrays([pa.array([text, "one two"])], ["text"])
    got = [(n, own.tolist()) for n, own, _ in periodic.texts(batch, 24)]
    assert got == [(60, [[0, 30, 3]]), (2, [])]


def test_ties_of_the_greatest_run():
    """Exponents are compared exactly; of equal ones the first counts."""
    assert periodic.greatest(np.array([[0, 48, 4], [60, 24, 2], [100, 36, 3]])) == 0
    least, most = [3 * 10**9 + 4, 10**9 + 1], [3 * 10**9 + 1, 10**9]  # 3 + 1 / (10^9 + 1) and 3 + 1 / 10^9
    assert periodic.greatest(np.array([[5, *least], [6, *most]])) == 1 and periodic.greatest(np.array([[5, *most], [6, *least]])) == 0
