"""Operators that SQL cannot express, held against plain versions."""
import math
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import langid, licenses, lm, toxicity

from . import brute

# ---- licenses


def contained(index, text, least):
    """{template: greatest containment over its class's windows} of one text, by sets of word tuples."""
    words = brute.ALNUM.findall(brute.low(text))
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    out = {}
    for top, members in index.classes.items():
        size, stride = max(1, math.ceil(top * licenses.WINDOW)), max(1, top // 3)
        for t in members:
            own = brute.ALNUM.findall(brute.low(licenses.TEMPLATES[index.names[t]]))
            own = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
            best = max((len(own & set(grams[a : a + size])) / len(own) for a in range(0, max(1, len(grams)), stride)), default=0.0)
            if best >= least:
                out[index.names[t]] = round(best, 9)
    return out


def test_license_scan_equals_containment_on_a_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    index = licenses.Index(licenses.TEMPLATES)
    want = {r.doc_id: contained(index, r.text, licenses.MATCH) for r in docs.collect()}
    got = {r.doc_id: {m.license: round(m.containment, 9) for m in r.matches} for r in licenses.scanned(docs).collect()}
    assert got == want and sum(map(bool, want.values())) >= 3


# ---- language model


def plain_scores(train, asked):
    """The smoothed score from exact counts that are rounded to their levels, as the filter gives them without an error."""
    tokens, pairs = Counter(), Counter()
    for t in train:
        seq = brute.tokens(t)
        tokens.update([*seq, b"<s>"])
        pairs.update(zip([b"<s>", *seq], seq))
    n, v = sum(c for x, c in tokens.items() if x != b"<s>"), len([x for x in tokens if x != b"<s>"])
    level = lambda c: int(lm.level_of(np.array([c]))[0]) if c else 0
    low = lambda c: float(lm.least_of(np.array([level(c)]))[0])
    high = lambda c: float(lm.greatest_of(np.array([level(c)]))[0])
    out = []
    for t in asked:
        seq, total = brute.tokens(t), 0.0
        for before, x in zip([b"<s>", *seq], seq):
            above = high(tokens[before])
            total += math.log10((min(low(pairs[before, x]), above) + lm.MU * (low(tokens[x]) + 1) / (n + v + 1)) / (above + lm.MU))
        out.append(total)
    return out


def test_lm_score_equals_exact_counts(frame, prose):
    """With bits enough for no false positive the score is that of exact counts; with the usual bits its mean error is below 1%."""
    named = [(i, t) for i, (_, t) in enumerate(prose)]
    docs = frame(named).select("doc_id", "text", (F.col("doc_id") % 4 == 1).alias("held_out"))
    want = dict(zip([i for i, _ in named], plain_scores([t for i, t in named if i % 4 != 1], [t for _, t in named])))
    for bits, error in ((400, 1e-9), (12, 0.01)):
        got = {r.doc_id: r.score for r in lm.scored(docs, lm.train(docs.where("not held_out"), bits_each=bits)).collect()}
        assert got.keys() == want.keys()
        assert sum(abs(got[i] - want[i]) for i in want) <= error * sum(map(abs, want.values()))


# ---- language identification


def words_of(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if unicodedata.category(c)[0] in "LM":
            now += c.lower() if len(c.lower()) == 1 else c
        elif now:
            out.append("▁" + now)
            now = ""
    return out


def forward(word, p, longest):
    a = [1.0] + [0.0] * len(word)
    for i in range(1, len(word) + 1):
        for j in range(max(0, i - longest), i):
            q = p.get(word[j:i], langid.RARE if i == j + 1 else 0.0)
            a[i] += a[j] * q
    return a


def plain_langid(train, asked):
    pieces = langid.pieces_of(langid.vocabulary_path())
    longest = max(map(len, pieces))
    start = {x: 1.0 / (i + 10.0) for i, x in enumerate(pieces)}
    total = sum(start.values())
    start = {x: y / total for x, y in start.items()}
    langs = sorted({la for _, la in train})
    counts = {la: Counter() for la in langs}
    for text, la in train:
        for w in words_of(text):
            a = forward(w, start, longest)
            b = [0.0] * len(w) + [1.0]
            for j in range(len(w) - 1, -1, -1):
                b[j] = sum(start.get(w[j:i], langid.RARE if i == j + 1 else 0.0) * b[i] for i in range(j + 1, min(len(w), j + longest) + 1))
            for j in range(len(w)):
                for i in range(j + 1, min(len(w), j + longest) + 1):
                    if w[j:i] in start:
                        counts[la][w[j:i]] += a[j] * start[w[j:i]] * b[i] / a[-1]
    out = []
    probs = {}
    for la in langs:
        whole = sum(counts[la].values()) + langid.SMOOTHING * len(pieces)
        probs[la] = {x: (counts[la][x] + langid.SMOOTHING) / whole for x in pieces}
    for text in asked:
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            out.append(("und", 0.0))
            continue
        z = [sum(math.log(forward(w, probs[la], longest)[-1]) for w in words_of(text)) for la in langs]
        out.append((langs[z.index(max(z))], 1 / sum(math.exp(x - max(z)) for x in z)))
    return out


def test_langid_equals_a_plain_version(frame):
    train = [("The cat sat on the mat, and the DOG barked.", "en"), ("Der Hund und die Katze sind über der Straße", "de"), ("le chat et l'été à la maison", "fr"), ("thé 日本 cat", "fr")]
    asked = ["the mat", "die Straße", "une maison d'été", "", None, "12 !", "日本", "Überstraßenkatzen and the dog " * 5, "x"]
    df = frame([(i, t) for i, (t, _) in enumerate(train)]).drop("lang")
    df = df.withColumn("lang", F.element_at(F.array(*[F.lit(la) for _, la in train]), F.col("doc_id").cast("int") + 1))
    rows = langid.predicted(frame([(i, t) for i, t in enumerate(asked)]).select("doc_id", "text"), langid.train(df, langid.vocabulary_path())).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    for i, (la, score) in enumerate(plain_langid(train, asked)):
        assert got[i][0] == la and abs(got[i][1] - score) < 1e-9


# ---- toxicity


def test_toxicity_scores_equal_a_plain_version(frame, prose):
    """The score is the classifier's over the distinct voters of the text's tokens."""
    names = ["idiot", "the~", "abc~", "of", "#caps", "#masked", "#shout", "gab~", "einß"]
    weights, bias = np.array([4.0, 0.5, 1.25, -0.75, 0.3, 2.0, 0.1, -1.5, 0.2]), -1.0
    texts = [*prose, (900, "You IDIOT!! the thesis (abcdef) s**t"), (901, "OF of Of, gabriel")]
    want = []
    for d, t in texts:
        voters = {f for w in brute.SPACE.findall((t or "").translate({})) for f in toxicity.features_of(w)}
        want.append((d, round(1 / (1 + math.exp(-(bias + sum(w for n, w in zip(names, weights) if n in voters)))), 9)))
    docs = frame(texts).select("doc_id", F.lit(False).alias("held_out"), "text")
    got = [(r.doc_id, round(r.score, 9)) for r in toxicity.scored(docs, {"names": names, "weights": weights, "bias": bias}).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_label_model_equals_plain_expectation_maximisation():
    rng = np.random.default_rng(5)
    y = rng.random(400) < 0.25
    votes = np.column_stack([rng.random(400) < np.where(y, 0.5, 0.03) for _ in range(3)] + [rng.random(400) < np.where(y, 0.1, 0.7)])
    toxic, prior = np.array([True, True, True, False]), 0.25
    m = toxicity.LabelModel(votes, toxic, prior, rounds=6)
    p = [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + 3.0 * sum(v[:3]) - 0.5 * v[3]))) for v in votes.tolist()]
    for step in range(6):
        hit, miss = [], []
        for j in range(4):
            h = (sum(q for q, v in zip(p, votes) if v[j]) + (0.5 if toxic[j] else 0.05)) / (sum(p) + 2)
            n = (sum(1 - q for q, v in zip(p, votes) if v[j]) + (0.05 if toxic[j] else 0.5)) / (sum(1 - q for q in p) + 2)
            h, n = min(max(h, 1e-5), 0.999), min(max(n, 1e-5), 0.999)
            hit.append(h if toxic[j] else min(h, n))
            miss.append(min(n, h) if toxic[j] else n)
        weight = [1.0] * 4
        if step >= 3:
            rest = [[v[j] - q * hit[j] - (1 - q) * miss[j] for j in range(4)] for q, v in zip(p, votes.astype(float))]
            norm = [math.sqrt(sum(r[j] ** 2 for r in rest)) + 1e-9 for j in range(4)]
            corr = lambda a, b: sum(r[a] * r[b] for r in rest) / norm[a] / norm[b]  # noqa: E731, B023
            weight = [1 / (1 + sum(c for b in range(4) if b != a and (c := corr(a, b)) >= toxicity.SAME)) for a in range(4)]
        p = [1 / (1 + math.exp(-min(30, max(-30, sum(math.log(hit[j] / miss[j]) * weight[j] for j in range(4) if v[j]) + math.log(prior / (1 - prior)))))) for v in votes.tolist()]
    assert np.allclose(m.labels, p) and np.allclose(m.hit, hit) and np.allclose(m.miss, miss) and np.allclose(m.weight, weight)
