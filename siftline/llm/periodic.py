"""Periodic runs of words: a harmonic grid of (period, place) pairs, whose common extensions are found together by binary search.

A run is a stretch of words with least period q (words q apart are identical), of at least max(LEAST, 3q) words, that no neighbour
extends.  Words q apart then match over at least max(LEAST - q, 2q) places in a row, so for each period a grid of that step has a
place inside every such stretch: some n log n pairs over all periods.  All pairs of a slice of texts are handled at once: prefix
hashes give the longest common extensions of place and place + period by binary search, to the right and to the left.  A stretch
that is found under several periods belongs to the least one.  Words are compared as 64-bit hashes; every run is then verified on
the words themselves, and a text for which that fails is searched again with its words numbered exactly.

Null texts have no words, as empty ones.  Rows are judged one by one, so repeated rows and ids need no rule; of a null id nothing is
replaced.  Extra columns are kept aside by name: `more` columns may not be called like a result column.  Texts are taken in slices of
1 MB, or one longer text by itself: some 120 bytes a word are held, and the grid is walked in pieces of PAIRS pairs.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, column, table
from .textops import Words, mix

#: least words of a run
LEAST = 24
#: pairs of the grid that are held at once
PAIRS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Prefixes:
    """Hashes of all stretches of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        self.powers = np.full(len(codes) + 1, _BASE, np.uint64)
        self.powers[0] = 1
        np.cumprod(self.powers, out=self.powers)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes) * self.powers[:-1], out=self.sums[1:])

    def same(self, a: np.ndarray, gap: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` codes at a and at a + gap are equal."""
        b = a + gap
        return (self.sums[a + size] - self.sums[a]) * self.powers[gap] == self.sums[b + size] - self.sums[b]


def extensions(codes: Prefixes, a: np.ndarray, gap: np.ndarray, most: np.ndarray, left: bool) -> np.ndarray:
    """The greatest size up to `most` for which the stretches from a and a + gap on are equal; with left, those that end before them."""
    low, high = np.zeros_like(most), most.copy()
    whole = codes.same(a - most if left else a, gap, most)  # within long runs most pairs end here
    low[whole] = most[whole]
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        mid = (low[live] + high[live] + 1) >> 1
        fits = codes.same(a[live] - mid if left else a[live], gap[live], mid)
        low[live[fits]] = mid[fits]
        high[live[~fits]] = mid[~fits] - 1


def _grid(sizes: np.ndarray, least: int):
    """(text, period, places) in pieces: of every text and period, how many places 0, step, 2 step, ... there are."""
    most = sizes // 3
    most[sizes < least] = 0
    ends = np.cumsum(most)
    total, at = int(ends[-1]) if len(ends) else 0, 0
    while at < total:
        end = min(total, at + PAIRS)
        k = np.arange(at, end)
        text = np.searchsorted(ends, k, "right")
        period = k - (ends - most)[text] + 1
        step = np.maximum(least - period, 2 * period)
        places = -(-(sizes[text] - period) // step)
        cuts = np.searchsorted(np.cumsum(places), np.arange(PAIRS, int(places.sum()), PAIRS))
        for a, b in zip([0, *(cuts + 1).tolist()], [*(cuts + 1).tolist(), len(k)]):
            if a < b:
                yield text[a:b], period[a:b], step[a:b], places[a:b]
        at = end


def runs(codes: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(text, start, length, period) of all runs, sorted: the codes of text i stand at first[i] .. first[i + 1]."""
    sizes = np.diff(first)
    if not len(sizes) or sizes.max() < least:
        return np.zeros((0, 4), np.int64)
    hashes, found = Prefixes(codes), []
    for text, period, step, places in _grid(sizes, least):
        which = np.repeat(np.arange(len(text)), places)
        place = (np.arange(len(which)) - np.repeat(np.cumsum(places) - places, places)) * step[which]
        a, gap = first[text][which] + place, period[which]
        hit = np.flatnonzero(codes[a] == codes[a + gap])
        if not len(hit):
            continue
        which, a, gap = which[hit], a[hit], gap[hit]
        owner = text[which]
        right = extensions(hashes, a, gap, first[owner + 1] - a - gap, False)
        left = extensions(hashes, a, gap, a - first[owner], True)
        length = left + right + gap
        keep = length >= np.maximum(least, 3 * gap)
        found.append(_least(np.stack([owner, a - left - first[owner], length, gap], 1)[keep]))
    return _least(np.concatenate(found)) if found else np.zeros((0, 4), np.int64)


def _least(rows: np.ndarray) -> np.ndarray:
    """Of rows that agree in text, start and length, that of the least period; by start and period (of runs of one start the longer has the greater)."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    return rows[new]


def _verified(words: list, found: np.ndarray) -> bool:
    return all(words[s : s + n - q] == words[s + q : s + n] for s, n, q in found.tolist())


def greatest(found: np.ndarray) -> int:
    """The row of the greatest exact length / period; ties by the least start, then the least period."""
    ratio = found[:, 1] / found[:, 2]
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-12))
    best = int(near[0])
    for i in near[1:].tolist():
        if int(found[i, 1]) * int(found[best, 2]) > int(found[best, 1]) * int(found[i, 2]):
            best = i
    return best


def replaced(n: int, h: int) -> np.ndarray:
    """Word numbers of a text of n words whose tail is replaced by repeats, as its id's crc32 says."""
    out, g = np.arange(n), h // 10
    if h % 10 == 0 and n:
        a = g % n
        out[a:] = a + (out[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return out


def _kept(n: int, found: np.ndarray) -> np.ndarray:
    """The words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) == 0)


def _joined(text: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> bytes:
    """The words of numbers `at` with one space between; words that follow each other in the text go as one piece."""
    if not len(at):
        return b""
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    heads, tails = at[np.append(0, cut)], at[np.append(cut, len(at)) - 1]
    return b" ".join([text[a:b] for a, b in zip(starts[heads].tolist(), ends[tails].tolist())])


def _numbered(words: list) -> np.ndarray:
    """Exact word codes."""
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.uint64)


def texts(batch, least: int, crc: str | None = None):
    """For each text of a slice: (words, runs as (start, length, period), bytes that are kept)."""
    words = Words(column(batch, "text"))
    n = len(words.counts)
    source = np.arange(len(words.hash))
    if crc is not None:
        first = words.first
        for i, h in enumerate(column(batch, crc).to_pylist()):
            if h is not None and h % 10 == 0 and words.counts[i]:
                source[first[i] : first[i + 1]] = first[i] + replaced(int(words.counts[i]), h)
    codes = words.hash[source]
    found = runs(codes, words.first, least)
    text, starts, ends = words.normal()
    cuts = np.searchsorted(found[:, 0], np.arange(n + 1))
    for i in range(n):
        a, b = int(words.first[i]), int(words.first[i + 1])
        own, here = found[cuts[i] : cuts[i + 1], 1:], source[a:b]
        if len(own):
            plain = [text[s:e] for s, e in zip(starts[here].tolist(), ends[here].tolist())]
            if not _verified(plain, own):  # two words share a hash
                own = runs(_numbered(plain), np.array([0, b - a]), least)[:, 1:]
        yield b - a, own, _joined(text, starts, ends, here[_kept(b - a, own)] if len(own) else here)


def _found(least: int, crc: str | None, more: tuple, digest: bool):
    def run(batches):
        for batch in chunked(batches):
            n, best, listed, kept = [], [], [], []
            for words, own, text in texts(batch, least, crc):
                n.append((words, len(own)))
                best.append((*own[greatest(own)].tolist(),) if len(own) else (None, None, None))
                listed.append(hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in own.tolist()).encode()).hexdigest() if digest else
                              [{"start": s, "length": k, "period": q} for s, k, q in own.tolist()])
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            kind = pa.string() if digest else pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            cols = [pa.array([x[j] for x in n], pa.int64()) for j in (0, 1)] + [pa.array([x[j] for x in best], pa.int64()) for j in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in more), *cols, pa.array(listed, kind), pa.array(kept, pa.string())],
                                             [*more, "n_words", "n_runs", "start", "length", "period", "runs", "collapsed"])

    return run


def periodic(docs: DataFrame, more: tuple = ("doc_id",), least: int = LEAST, crc: str | None = None, digest: bool = False) -> DataFrame:
    """more, n_words, n_runs, start, length, period, runs, collapsed of every text.

    start, length and period are those of the run of the greatest exponent; runs lists all, by start and period; collapsed is the text
    without the words that a run holds after its first period.  With digest, the last two are SHA-256, of lines start,length,period and of
    the text.  crc names a column: by its values the ends of some texts are replaced by repeats first (replaced()).
    """
    rows = docs.select(*more, "text", *([crc] if crc else []))
    kinds = "string, collapsed string" if digest else "array<struct<start:long,length:long,period:long>>, collapsed string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*more).schema)
    return rows.mapInArrow(_found(least, crc, more, digest), f"{schema}, n_words long, n_runs long, start long, length long, period long, runs {kinds}")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("_crc"))
    rows = periodic(docs, crc="_crc", digest=True)
    milli = F.expr("1000 * length div period")  # whole numbers; a run has a period of at least 1
    return rows.select("doc_id", "n_runs", "start", "length", "period", milli.alias("exponent_milli"), F.col("runs").alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
