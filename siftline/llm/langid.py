"""Language identification with segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary (a sentencepiece file).  A word is
a maximal run of letters and marks, lower-cased, with the word mark in front.  A
language gives each piece a probability; a word's probability in the language is the
sum over all its segmentations into pieces, by the forward algorithm; a text's is
the product over its words; of a word of over LONG letters only the last positions are held.  A single letter that is no piece counts as a rare piece.

Training is one expectation step over all training rows: forward-backward under a
language-independent start (a piece's probability falls with its rank in the file)
gives expected piece counts, which are summed by language and smoothed.

score is the posterior of the predicted language under equal priors.  Null texts and
texts without a letter are `und` with score 0; ties go to the language that sorts
first.  With nothing to learn from, every text is `und`.  Rows are predicted one by
one, repeated ids included; a null doc_id is a training row.
"""
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, column, split_mod, table
from .textops import mix, run_hashes

SMOOTHING = 0.5
RARE = 1e-7
_STEP = np.uint64(0x9E3779B97F4A7C1B)
_MARK = "▁"
#: characters of text that are looked at together
SLICE = 4 << 20
#: letters of a word beyond which its positions are walked one by one, with a ring of the last ones
LONG = 256
#: positions of such a word whose pieces are looked up together
WALK = 1 << 14
#: ASCII characters and spaces that are in no word: a long text may be cut behind them
_BREAK = re.compile(r"[\s\x00-@\[-`{-~]")


def sliced(texts: list, most: int = SLICE):
    """(rows, pieces): lists of about `most` characters; a longer text is cut where no word is."""
    rows, pieces, size = [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while True:
            found = _BREAK.search(text, at + most) if len(text) - at > most else None
            end = found.end() if found else len(text)
            rows.append(row)
            pieces.append(text[at:end])
            size += end - at
            if size >= most:
                yield np.array(rows), pieces
                rows, pieces, size = [], [], 0
            at = end
            if at >= len(text):
                break
    if rows:
        yield np.array(rows), pieces


def pieces_of(path: str) -> list:
    """The vocabulary's pieces made of letters only, in the file's order, lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    out = {}
    for x in found:
        bare = x.removeprefix(_MARK)
        if bare and bare == bare.lower() and all(unicodedata.category(c)[0] in "LM" for c in bare):
            out.setdefault(x, len(out))
        elif x == _MARK:
            out.setdefault(x, len(out))
    return list(out)


def letter_tables() -> tuple:
    """By code point: is it a letter or mark, is it a letter, its lower case.  Sizes are Unicode's."""
    size = 0x110000
    inside, letter, lower = np.zeros(size, bool), np.zeros(size, bool), np.arange(size, dtype=np.uint32)
    for c in range(size):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            inside[c] = True
            letter[c] = kind == "L"
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return np.packbits(inside), np.packbits(letter), lower


class Vocabulary:
    """Finds pieces by the hash of their code points."""

    def __init__(self, pieces: list, tables: tuple):
        self.inside, self.letter = np.unpackbits(tables[0]).astype(bool), np.unpackbits(tables[1]).astype(bool)
        self.lower = tables[2]
        codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in pieces]
        self.longest = max(map(len, codes))
        slots = 1 << 20
        self.mask = np.uint64(slots - 1)
        self.slot = np.full(slots, -1, np.int32)
        self.keys = np.zeros(len(pieces), np.uint64)
        for i, c in enumerate(codes):
            self.keys[i] = h = self._hash(c[None, :])[0]
            at = int(h & self.mask)
            while self.slot[at] >= 0:
                at = (at + 1) & (slots - 1)
            self.slot[at] = i

    @staticmethod
    def _hash(codes):
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = h * _STEP + codes[:, j].astype(np.uint64) + np.uint64(1)
        return mix(h)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or len(keys)."""
        none = len(self.keys)
        out = np.full(len(hashes), none, np.int32)
        at = (hashes & self.mask).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            got = self.slot[at[left]]
            there = got >= 0
            hit = there & (self.keys[got] == hashes[left])
            out[left[hit]] = got[hit]
            left = left[there & ~hit]
            at[left] = (at[left] + 1) & int(self.mask)
        return out

    def words(self, texts: list):
        """(code points of all, first, length, row) of every word, and whether each row has a letter."""
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        codes = self.lower[codes]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        heads = np.cumsum(sizes + 1) - (sizes + 1)
        inside = self.inside[codes]
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        letters = np.concatenate([[0], np.cumsum(self.letter[codes], dtype=np.int32)])
        has = letters[heads + sizes] > letters[heads]
        row = np.searchsorted(heads, starts, "right") - 1
        return codes, inside, starts, ends, row, has


def _lattice(vocabulary, codes, starts, sizes):
    """For words of one size: piece ids of every span [j, i) as {(j, i): ids}; position 0 is the word mark."""
    n = int(sizes) + 1
    grid = np.empty((len(starts), n), np.uint64)
    grid[:, 0] = ord(_MARK) + 1
    for j in range(n - 1):
        grid[:, j + 1] = codes[starts + j].astype(np.uint64) + np.uint64(1)
    spans = {}
    for j in range(n):
        h = np.zeros(len(starts), np.uint64)
        for i in range(j + 1, min(n, j + vocabulary.longest) + 1):
            h = h * _STEP + grid[:, i - 1]
            spans[j, i] = vocabulary.ids(mix(h))
    return n, spans


def _forward(n, spans, probs, words):
    """(alpha by position, scaled; log of the scale): probs has a row for each piece and a last row for none."""
    none = len(probs) - 1
    width = probs.shape[1]
    alpha = [np.ones((words, width))]
    scale = np.zeros((words, width))
    scales = [scale]
    for i in range(1, n + 1):
        total = np.zeros((words, width))
        for j in range(i - 1, -1, -1):
            ids = spans.get((j, i))
            if ids is None:
                break
            p = probs[ids]
            if i == j + 1:
                p = np.where((ids == none)[:, None], RARE, p)
            total += alpha[j] * p * (np.exp(scales[j] - scales[i - 1]) if i > 24 else 1.0)
        now = scales[i - 1]
        if i >= 24:  # long words: keep the numbers in range
            now = now + np.log(total)
            total = np.ones_like(total)
        alpha.append(total)
        scales.append(now)
    return alpha, scales


def _spans(vocabulary, word, first, last, probs):
    """probs of the pieces that end at the positions first + 1 .. last of one word, as (position, span, language): the longest span first.

    word: the code points + 1 with the word mark in front.  Spans that begin before the word have probability 0.
    """
    none, most, ends = len(probs) - 1, vocabulary.longest, np.arange(first + 1, last + 1)
    ids = np.full((len(ends), most), none, np.int32)
    h = np.zeros(len(ends), np.uint64)
    for size in range(1, min(most, last) + 1):
        there = ends >= size
        h[there] += word[ends[there] - size] * np.uint64(pow(int(_STEP), size - 1, 1 << 64))
        ids[there, most - size] = vocabulary.ids(mix(h[there]))
    p = probs[ids]
    p[ids[:, -1] == none, -1] = RARE
    return ids, p


def _rescaled(ring, scale):
    """Keeps the ring of the last positions in range: its greatest value by language becomes 1."""
    top = ring.max(0)
    ring /= top
    scale += np.log(top)


def _marked(codes, start, end):
    return np.concatenate([[np.uint64(ord(_MARK) + 1)], codes[start:end].astype(np.uint64) + np.uint64(1)])


def long_log_prob(vocabulary, codes, start, end, probs, each=None) -> np.ndarray:
    """log P(word) by language, for a word of any length: memory is that of one piece of WALK positions.

    each, if given, gets the log of the forward value of every position (one language)."""
    word, most = _marked(codes, start, end), vocabulary.longest
    n, scale = len(word), np.zeros(probs.shape[1])
    ring = np.zeros((most, probs.shape[1]))
    ring[-1] = 1
    for a in range(0, n, WALK):
        b = min(n, a + WALK)
        _, p = _spans(vocabulary, word, a, b, probs)
        held = np.concatenate([ring, np.zeros((b - a, probs.shape[1]))])
        for i in range(b - a):
            value = np.einsum("sl,sl->l", held[i : i + most], p[i])
            held[i + most] = value
            if each is not None:
                each[a + i + 1] = np.log(value[0]) + scale[0]
            if i % 8 == 7 or i == b - a - 1:
                _rescaled(held[i + 1 : i + 1 + most], scale)
        ring = held[-most:].copy()
    return np.log(ring[-1]) + scale


def _long_counts(vocabulary, codes, start, end, first, weight, out) -> None:
    """Adds the expected uses of each piece in one long word, times its weights, to out."""
    word, most, probs = _marked(codes, start, end), vocabulary.longest, first[:, None]
    n, none = len(word), len(first) - 1
    ahead = np.zeros(n + 1)
    whole = float(long_log_prob(vocabulary, codes, start, end, probs, ahead)[0])
    ring, scale = np.zeros(most + 1), 0.0  # of the positions before the one at the end
    ring[-1] = 1
    for a in range((n - 1) // WALK * WALK, -1, -WALK):
        b = min(n, a + WALK)
        ids, p = _spans(vocabulary, word, a, b, probs)
        p = p[:, :, 0]
        held, behind = np.concatenate([np.zeros(b - a), ring]), np.zeros(b - a)
        for i in range(b - a - 1, -1, -1):  # position a + i + 1 stands at held[i + 1 + most]
            value = held[i + 1 + most]
            behind[i] = np.log(value) + scale
            held[i + 1 : i + 1 + most] += p[i] * value
            if i % 8 == 0:
                top = held[i : i + 1 + most].max()
                held[i : i + 1 + most] /= top
                scale += np.log(top)
        ring = held[: most + 1]
        at, span = np.nonzero(ids != none)
        use = p[at, span] * np.exp(ahead[a + at + 1 - (most - span)] + behind[at] - whole)
        out += np.bincount(ids[at, span], weights=use, minlength=len(out))[:, None] * weight


def _groups_of(sizes, among):
    """The numbers of the words among them, by size."""
    order = np.flatnonzero(among)
    order = order[np.argsort(sizes[order], kind="stable")]
    cut = np.flatnonzero(np.diff(sizes[order])) + 1
    return np.split(order, cut) if len(order) else []


def log_probs(vocabulary, codes, starts, ends, probs) -> np.ndarray:
    """log P(word) by language."""
    out = np.zeros((len(starts), probs.shape[1]))
    long = ends - starts > LONG
    for i in np.flatnonzero(long).tolist():
        out[i] = long_log_prob(vocabulary, codes, starts[i], ends[i], probs)
    for group in _groups_of(ends - starts, ~long):
        for part in np.array_split(group, max(1, len(group) // 20_000)):
            n, spans = _lattice(vocabulary, codes, starts[part], ends[part[0]] - starts[part[0]])
            alpha, scales = _forward(n, spans, probs, len(part))
            out[part] = np.log(alpha[n]) + scales[n]
    return out


def expected_counts(vocabulary, codes, starts, ends, weight, start) -> np.ndarray:
    """Expected uses of each piece over words, each weighted by a row of weight (words x languages)."""
    out = np.zeros((len(start), weight.shape[1]))
    probs = start[:, None]
    none = len(start) - 1
    long = ends - starts > LONG
    for i in np.flatnonzero(long).tolist():
        _long_counts(vocabulary, codes, starts[i], ends[i], start, weight[i], out)
    for group in _groups_of(ends - starts, ~long):
        for part in np.array_split(group, max(1, len(group) // 20_000)):
            size = int(ends[part[0]] - starts[part[0]])
            n, spans = _lattice(vocabulary, codes, starts[part], size)
            alpha, scales = _forward(n, spans, probs, len(part))
            beta = [None] * n + [np.ones(len(part))]
            back = [None] * n + [np.zeros(len(part))]
            for j in range(n - 1, -1, -1):
                total = np.zeros(len(part))
                reach = max(i for i in range(j + 1, n + 1) if (j, i) in spans)
                base = back[j + 1]
                for i in range(j + 1, reach + 1):
                    p = start[spans[j, i]]
                    if i == j + 1:
                        p = np.where(spans[j, i] == none, RARE, p)
                    total += p * beta[i] * (np.exp(back[i] - base) if n - j > 24 else 1.0)
                if n - j >= 24:
                    base, total = base + np.log(total), np.ones_like(total)
                beta[j], back[j] = total, base
            whole = np.log(alpha[n][:, 0]) + scales[n][:, 0]
            for (j, i), ids in spans.items():
                real = ids != none
                if real.any():
                    log_use = scales[j][:, 0] + back[i] - whole
                    use = alpha[j][:, 0] * start[ids] * beta[i] * np.exp(log_use)
                    np.add.at(out, ids[real], use[real][:, None] * weight[part][real])
    return out


def _start(size: int) -> np.ndarray:
    """Zipf's law over the ranks of the file, and 0 for no piece."""
    p = 1.0 / (np.arange(size) + 10.0)
    return np.append(p / p.sum(), 0.0)


def _coded(codes):
    return lambda a, b: codes[a:b].astype(np.uint64) + np.uint64(1)


def _train(shared):
    def run(batches):
        pieces, tables, langs = shared.value
        vocabulary = Vocabulary(pieces, tables)
        index = {x: i for i, x in enumerate(langs)}
        start = _start(len(pieces))
        sums = np.zeros((len(start), len(langs)))
        for batch in chunked(batches, most=2 << 20):  # words are looked at once a slice
            lang = np.array([index[x] for x in column(batch, "lang").to_pylist()])
            for rows, pieces in sliced(column(batch, "text").to_pylist()):
                codes, inside, starts, ends, row, _ = vocabulary.words(pieces)
                if not len(starts):
                    continue
                hashes = run_hashes(_coded(codes), inside, starts, ends)
                _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                weight = np.bincount(inverse * len(langs) + lang[rows[row]], minlength=len(at) * len(langs)).reshape(len(at), len(langs)).astype(float)
                sums += expected_counts(vocabulary, codes, starts[at], ends[at], weight, start)
        piece, which = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(sums[piece, which])], ["lang", "piece", "n"])

    return run


def train(docs: DataFrame, path: str) -> dict:
    """Piece probabilities by language, from rows (text, lang) with a lang."""
    spark = docs.sparkSession
    docs = docs.where("lang is not null and text is not null").select("text", "lang")
    langs = sorted(r.lang for r in docs.select("lang").distinct().collect())  # one value a language
    pieces, tables = pieces_of(path), letter_tables()
    if not langs:
        return {"langs": [], "shared": None}
    shared = spark.sparkContext.broadcast((pieces, tables, langs))
    sums = (docs.mapInArrow(_train(shared), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))).toArrow()  # pieces x languages
    counts = np.zeros((len(pieces), len(langs)))
    counts[sums["piece"].to_numpy(), sums["lang"].to_numpy()] = sums["n"].to_numpy()
    counts += SMOOTHING
    probs = np.vstack([counts / counts.sum(0), np.zeros(len(langs))])
    return {"langs": langs, "shared": spark.sparkContext.broadcast((pieces, tables, langs, probs))}


def _predict(shared, names: list):
    def run(batches):
        pieces, tables, langs, probs = shared.value
        vocabulary = Vocabulary(pieces, tables)
        for batch in chunked(batches, most=2 << 20):
            texts = [x or "" for x in column(batch, "text").to_pylist()]
            total, has = np.zeros((len(texts), len(langs))), np.zeros(len(texts), bool)
            for rows, pieces in sliced(texts):
                codes, inside, starts, ends, row, letters = vocabulary.words(pieces)
                has[rows[letters]] = True
                if len(starts):
                    hashes = run_hashes(_coded(codes), inside, starts, ends)
                    _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                    logs = log_probs(vocabulary, codes, starts[at], ends[at], probs)[inverse]
                    heads = np.flatnonzero(np.diff(np.concatenate([[-1], row])))
                    np.add.at(total, rows[row[heads]], np.add.reduceat(logs, heads, axis=0))
            best = total.argmax(1)
            post = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            lang = [langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(np.where(has, post, 0.0))], names)

    return run


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """docs with the columns lang_pred and score appended."""
    if not model["langs"]:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    return docs.mapInArrow(_predict(model["shared"], [*docs.columns, "lang_pred", "score"]), schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", split_mod(4, 2).alias("held_out"))
    model = train(docs.where("not held_out"), vocabulary_path())
    return predicted(docs.select("doc_id", "held_out", "text"), model).drop("text")
