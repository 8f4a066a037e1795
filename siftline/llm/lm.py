"""Language-model scoring with a log-frequency Bloom filter.

Tokens are the words [^\\x20\\x09-\\x0D]+ of the lower-cased (A-Z) text and one end
token.  Training counts tokens and pairs of neighbours (a pair spans the start of
the text, too).  A count c is kept as its level 1 + floor(log_BASE c); an n-gram is
put into the filter once for each level up to its own, so that a reader probes
level 1, 2, ... until one is absent.  Every token and every pair enters the filter,
which has `bits_each` bits an entry at every size.  Hashes are dealt to CELLS cells, whose
sizes follow their own entries, so that a bucket of cells makes its segment where its n-grams
are counted, and the bits do not depend on the number of buckets.  A filter of up to
`most_bits` bits is broadcast; the segments of a larger one stay apart, and the n-grams
of each chunk of texts are sent to them; their levels alone come back, a byte each, in the
order in which they were asked.  Both ways probe the same bits and give the same score.
The query asks segments at every size.

The filter knows n-grams by the upper 48 bits of their hashes.  What is shuffled are sorted
hashes as steps of 32 bits from each to the next (thinned()); counts keep all 64 bits of tokens.

Score: log10 of the product over tokens of
    (c(v, w) + MU * P(w)) / (c(v) + MU),   P(w) = (c(w) + 1) / (N + V + 1)
with c taken from the filter: the numerators' counts rounded down to the least count
of their level, the denominators' up to the greatest, so that probabilities do not
sum to more than 1 (but for the filter's false positives).

The base score needs exact counts.  The HOT_WORDS most frequent tokens at most are
broadcast with them; the other tokens' counts come from a join on the token's hash,
with one row per document and distinct token.

Null texts are empty: one end token.  Rows that share an id are scored one by one;
a null doc_id is a training document.
"""
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, chunked, column, dropped, grouped, longs, parts, split_mod, table, trimmed, written, written_at
from .substring import fineness
from .textops import Words, dealt, mix, runs

BASE = 1.5
MU = 2000.0
HASHES = 3
HOT_WORDS = 1_000_000
BUCKETS = 2048
#: bytes of text whose n-grams are counted at once, and are asked at once
COUNTED, ASKED = 4 << 20, 2 << 20
#: hashes that are probed at once
PROBED = 1 << 18
#: cells of the filter, each with its own number of bits; buckets are runs of cells
CELLS = 1 << 16
_END_TOKEN = np.uint64(0xA0761D6478BD642F)
_START_TOKEN = np.uint64(0xE7037ED1A0B428DB)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = 0xD6E8FEB86659FD93
#: the bits of a hash that the filter looks at
_SHORT = np.uint64((1 << 64) - (1 << 16))
#: a step that stands for no hash
_FAR = (1 << 32) - 1


class Tokens:
    """Hashes of all tokens of a column, the pair that each closes, and the row of each."""

    def __init__(self, column):
        words = Words(column, lower=True)
        self.rows, self.counts = words.rows, words.counts + 1
        n = len(words.hash) + words.rows
        self.row = np.repeat(np.arange(words.rows), self.counts)
        last = np.cumsum(self.counts) - 1
        first = last - words.counts
        self.hash = np.empty(n, np.uint64)
        inner = np.ones(n, bool)
        inner[last] = False
        self.hash[inner] = words.hash
        self.hash[last] = _END_TOKEN
        self.before = np.empty(n, np.uint64)
        self.before[1:] = self.hash[:-1]
        self.before[first] = _START_TOKEN
        self.pair = mix(self.before * _PAIR + self.hash) & _SHORT
        self.first = first


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash: whole cells, in the order of the hashes."""
    return dealt(keys, CELLS) * buckets // CELLS


def _least(q, buckets: int):
    """The upper 48 bits of a bucket's least hash."""
    return -(-q * CELLS // buckets) << 32


def thinned(keys: np.ndarray, q: np.ndarray, buckets: int) -> tuple[list, list]:
    """(buckets, blobs) of sorted hashes, q their buckets: of each bucket the steps of the upper 48 bits from its least hash on.

    A step has 32 bits; one of _FAR and more is told by as many _FAR as it holds, and its rest.
    """
    starts, _ = runs(q)
    high = (keys >> np.uint64(16)).astype(np.int64)
    step = np.diff(high, prepend=0)
    step[starts] = high[starts] - _least(q[starts], buckets)
    far, rest = np.divmod(step, _FAR)
    ends = np.cumsum(far + 1)
    codes = np.full(int(ends[-1]) if len(ends) else 0, _FAR, np.uint32)
    codes[ends - 1] = rest
    cuts = (4 * np.append(0, ends)[np.append(starts, len(ends))]).tolist()
    data = codes.tobytes()
    return q[starts].tolist(), [data[a:b] for a, b in zip(cuts, cuts[1:])]


def thickened(blobs: list, q: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many of each blob) of a bucket's blobs; the lower 16 bits are 0."""
    codes = np.frombuffer(b"".join(blobs), np.uint32)
    ends = np.cumsum([len(b) // 4 for b in blobs])
    high = np.cumsum(codes, dtype=np.uint64)
    before = np.append(np.uint64(0), high)[np.append(0, ends[:-1])]  # what the blobs in front have summed up to
    high -= np.repeat(before, np.diff(ends, prepend=0))
    there = codes != _FAR
    keys = (high[there] + np.uint64(_least(q, buckets))) << np.uint64(16)
    return keys, np.diff(np.append(0, np.cumsum(there))[ends], prepend=0)


def _blobs(keys: np.ndarray, counts: np.ndarray, kind: int, buckets: int):
    """(q, kind, hashes, lower bits of tokens' hashes, counts of a byte, and those that a byte does not hold)."""
    q = bucket_of(keys, buckets)
    starts, sizes = runs(q)
    low, small = keys.astype(np.uint16), np.minimum(counts, 255).astype(np.uint8)
    for own, blob, a, n in zip(*thinned(keys, q, buckets), starts.tolist(), sizes.tolist()):
        some = counts[a : a + n]
        yield own, kind, blob, b"" if kind else low[a : a + n].tobytes(), small[a : a + n].tobytes(), some[some >= 255].astype(np.uint32).tobytes()


_COUNTS = ["q", "kind", "keys", "low", "counts", "large"]


def _count(buckets: int):
    """The blobs of tokens (kind 0) and pairs (1), added up over COUNTED bytes of text."""

    def run(batches):
        for batch in chunked(batches, most=COUNTED):
            tokens = Tokens(column(batch, "text"))
            rows = []
            for kind, keys in ((0, np.append(tokens.hash, np.full(tokens.rows, _START_TOKEN, np.uint64))), (1, tokens.pair)):
                rows += _blobs(*np.unique(keys, return_counts=True), kind, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), *[pa.binary()] * 4))], _COUNTS)

    return run


def _summed(held: list, kind: int, q: int, buckets: int) -> tuple:
    """(keys, sums) of a kind's n-grams of bucket q, in the order of the keys."""
    own = pa.Table.from_batches(held).drop_columns("q")
    own = own.filter(pa.compute.equal(own["kind"], kind)).to_pydict()
    if not own["keys"]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, _ = thickened(own["keys"], q, buckets)
    if kind == 0:
        keys |= np.frombuffer(b"".join(own["low"]), np.uint16)
    counts = np.frombuffer(b"".join(own["counts"]), np.uint8).astype(np.uint32)
    counts[counts == 255] = np.frombuffer(b"".join(own["large"]), np.uint32)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    starts, _ = runs(keys)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _added(bits_each: int, buckets: int):
    """Of each bucket its tokens with their counts, and its segment of the filter with the words of 64 bits that each of its cells has."""

    def run(batches):
        for q, held in grouped(batches, "q"):
            (keys, sums), (pairs, pair_sums) = (_summed(held, kind, q, buckets) for kind in (0, 1))
            every, levels = np.append(keys & _SHORT, pairs), level_of(np.append(sums, pair_sums))
            first = -(-q * CELLS // buckets)
            entries = np.bincount(dealt(every, CELLS) - first, weights=levels, minlength=-(-(q + 1) * CELLS // buckets) - first).astype(np.int64)
            lbf = Filter(64 * -(-bits_each * entries // 64), None, first=first)
            flags = np.zeros(int(lbf.own.sum()), bool)
            lbf.put(every, levels, flags)
            token = keys != _START_TOKEN
            by_level = np.bincount(level_of(sums[token]), minlength=64)[:64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([q], pa.int64()), pa.array([keys[token].tobytes()], pa.binary()), pa.array([sums[token].tobytes()], pa.binary()),
                 pa.array([int(token.sum())], pa.int64()), pa.array([int(sums[token].sum())], pa.int64()), pa.array([by_level.tolist()], pa.list_(pa.int64())),
                 pa.array([(lbf.own // 64).astype(np.uint32).tobytes()], pa.binary()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())],
                ["q", "keys", "counts", "distinct", "total", "by_level", "sizes", "segment"])

    return run


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def least_of(levels: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(levels > 0, np.ceil(BASE ** (levels - 1.0) - 1e-6), 0.0)


def greatest_of(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, np.maximum(np.ceil(BASE ** levels.astype(float) - 1e-6) - 1, 1), 0.0)


class Filter:
    """The Bloom filter: of `own` bits for each of `buckets` buckets of hashes, or of own[i] bits for the cell `first` + i."""

    def __init__(self, own, bitmap: np.ndarray, buckets: int = BUCKETS, first: int = 0):
        self.own, self.map, self.buckets, self.first = own, bitmap, buckets, first
        self.cells = isinstance(own, np.ndarray)
        if self.cells:
            self.base = np.cumsum(own) - own

    def _cell(self, keys):
        """(first bit, bits) of the part of the filter that holds the keys."""
        if not self.cells:
            return dealt(keys, self.buckets) * self.own, np.full(len(keys), self.own, np.uint64)
        at = dealt(keys, CELLS) - self.first
        return self.base[at], self.own[at].astype(np.uint64)

    def _places(self, keys, level: int, base, own):
        x = mix(keys + np.uint64(level * _LEVEL % (1 << 64)))
        for _ in range(HASHES):
            yield base + (x % own).astype(np.int64)
            x = mix(x + np.uint64(1))

    def put(self, keys: np.ndarray, levels: np.ndarray, flags: np.ndarray) -> None:
        """Sets flags, of the filter's cells or of the keys' one bucket."""
        base, own = self._cell(keys)
        if not self.cells:
            base = np.zeros(len(keys), np.int64)
        left, level = np.arange(len(keys)), 1
        while len(left):
            for at in self._places(keys[left], level, base[left], own[left]):
                flags[at] = True
            left = left[levels[left] > level]
            level += 1

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each hash: the number of levels found before the first that is absent."""
        out = np.zeros(len(keys), np.int64)
        base, own = self._cell(keys)
        left, level = np.flatnonzero(own > 0), 1  # a cell without bits holds nothing
        while len(left) and level < 64:
            there = np.ones(len(left), bool)
            for at in self._places(keys[left], level, base[left], own[left]):
                there &= (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            left = left[there]
            out[left] = level
            level += 1
        return out


def _table(from_level: int, to_level: int):
    """(key, count) of tokens whose level lies between."""

    def run(batches):
        for batch in batches:
            for keys, counts in zip(column(batch, "keys").to_pylist(), column(batch, "counts").to_pylist()):
                keys, counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                levels = level_of(counts)
                keep = (levels >= from_level) & (levels <= to_level) & (keys != _START_TOKEN)
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep])], ["key", "c"])

    return run


def train(docs: DataFrame, bits_each: int = 12, most_bits: int = 1 << 29, hot_words: int = HOT_WORDS) -> dict:
    """Counts the training documents' n-grams: the filter, the hot tokens' counts, and the table of all counts."""
    spark = docs.sparkSession
    buckets = min(CELLS, BUCKETS * fineness(docs))  # a bucket is one task's at a time, so their number follows the input
    blobs = docs.select("text").mapInArrow(_count(buckets), "q long, kind long, keys binary, low binary, counts binary, large binary")
    counts = blobs.repartition(parts(spark), "q").sortWithinPartitions("q").mapInArrow(
        _added(bits_each, buckets), "q long, keys binary, counts binary, distinct long, total long, by_level array<long>, sizes binary, segment binary")
    counts = written(counts)
    distinct, total, size = counts.agg(F.sum("distinct"), F.sum("total"), F.sum(F.octet_length("segment"))).first()
    by_level = counts.select(F.posexplode("by_level").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()
    level, held = 64, 0
    for r in sorted(by_level, key=lambda r: -r.level):
        if held + r.n > hot_words:
            break
        level, held = r.level, held + r.n
    segments, own, bitmap = counts.select("q", "sizes", "segment"), None, None
    if 8 * (size or 0) <= most_bits:
        own = np.zeros(CELLS, np.int64)
        for r in counts.select("q", "sizes").toLocalIterator():  # four bytes a cell
            sizes = np.frombuffer(r.sizes, np.uint32)
            first = -(-r.q * CELLS // buckets)
            own[first : first + len(sizes)] = 64 * sizes.astype(np.int64)
        base = (np.cumsum(own) - own) // 8
        bitmap = np.zeros(size or 0, np.uint8)
        for r in segments.select("q", "segment").toLocalIterator():  # most_bits at most
            at = base[-(-r.q * CELLS // buckets)]
            bitmap[at : at + len(r.segment)] = np.frombuffer(r.segment, np.uint8)
        segments = None
    tokens = counts.select("keys", "counts")
    hot = tokens.mapInArrow(_table(level, 64), "key long, c long").toArrow()
    keys = hot["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model = spark.sparkContext.broadcast((own, bitmap, keys[order], hot["c"].to_numpy()[order], total or 0, distinct or 0))
    return {"model": model, "segments": segments, "buckets": buckets, "N": total or 0, "V": distinct or 0, "cold": tokens.mapInArrow(_table(1, level - 1), "key long, c long")}


def _scores(batch, level_of_hash, hot, hot_c, total, distinct):
    """The batch's answers; level_of_hash gives the filter's levels of hashes."""
    space = total + distinct + 1.0
    t = Tokens(column(batch, "text"))
    words, inverse = np.unique(np.append(t.hash, _START_TOKEN), return_inverse=True)
    inverse = inverse[:-1]
    at = np.minimum(np.searchsorted(hot, words), max(len(hot) - 1, 0))
    known = hot[at] == words if len(hot) else np.zeros(len(words), bool)
    exact = np.where(known, hot_c[at] if len(hot) else 0, 0)
    level = level_of_hash(words & _SHORT)
    low, high = least_of(level), greatest_of(level)
    uni = (low + 1) / space
    pairs, pair_at = np.unique(t.pair, return_inverse=True)
    joint = least_of(level_of_hash(pairs))[pair_at]
    before = np.empty(len(inverse), np.int64)
    before[1:] = inverse[:-1]
    before[t.first] = np.searchsorted(words, _START_TOKEN)
    above = high[before]
    p = (np.minimum(joint, above) + MU * uni[inverse]) / (above + MU)
    add = lambda x: np.add.reduceat(x, t.first)
    base = add(np.where(known[inverse], np.log10(exact[inverse] + 1.0), 0.0))
    # tokens that are not hot: one entry per document and distinct token
    cold = np.flatnonzero(~known[inverse])
    order = cold[np.lexsort((t.hash[cold], t.row[cold]))]
    new = np.ones(len(order), bool)
    new[1:] = (t.hash[order][1:] != t.hash[order][:-1]) | (t.row[order][1:] != t.row[order][:-1])
    starts = np.flatnonzero(new)
    tf = np.diff(np.append(starts, len(order))).astype(np.int32)
    keys = t.hash[order][starts].view(np.int64)
    ends = np.searchsorted(t.row[order][starts], np.arange(t.rows + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [column(batch, "doc_id"), column(batch, "held_out"), pa.array(t.counts.astype(np.int64)), pa.array(add(known[inverse].astype(np.int64))),
         pa.array(base), pa.array(add(np.log10(p))), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)), pa.ListArray.from_arrays(pa.array(ends), pa.array(tf))],
        ["doc_id", "held_out", "n_tokens", "hot_known", "hot_base", "score", "cold", "tf"])


def _score(model):
    """Scores by the broadcast filter."""

    def run(batches):
        own, bitmap, *known = model.value
        lbf = Filter(own, bitmap)
        for batch in chunked(batches, most=1 << 19):  # beside the filter, little else fits
            yield _scores(batch, lbf.levels, *known)

    return run


def _chunks(batches):
    """The rows with the number of their chunk, which no other chunk has, and their place in it."""
    task = TaskContext.get().partitionId() << 32
    for i, batch in enumerate(chunked(batches, most=ASKED)):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, task + i)), pa.array(np.arange(batch.num_rows)), *batch.columns], ["chunk", "n", *batch.schema.names])


_SEGMENT = -1  # stands before every chunk
_TEXT = -1  # the bucket of a chunk's texts, which stand before its levels


def _asked(text) -> np.ndarray:
    """The distinct tokens and pairs of a column of texts as the filter knows them, in the order of their hashes, and so of buckets."""
    t = Tokens(text)
    return np.unique(np.concatenate([t.hash, t.pair, np.array([_START_TOKEN])]) & _SHORT)


def _probes(buckets: int):
    """(q, chunk, n, keys): the distinct tokens and pairs of a chunk's rows from its n-th on, by bucket.

    A chunk is one piece, unless a split of the table that is read ends in it.
    """

    def run(batches):
        for batch in trimmed(batches):
            chunk, n = longs(batch, "chunk"), longs(batch, "n")
            cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (n[1:] != n[:-1] + 1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)]):
                if a == b:
                    continue
                keys = _asked(column(batch, "text").slice(a, b - a))
                q = bucket_of(keys, buckets)
                firsts, lengths = runs(q)
                blobs = [keys[i : i + m].tobytes() for i, m in zip(firsts.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q[firsts], pa.int64()), pa.array(np.full(len(blobs), chunk[a])), pa.array(np.full(len(blobs), n[a])), pa.array(blobs, pa.binary())], ["q", "chunk", "n", "keys"])

    return run


def _sent(buckets: int):
    """_probes() with thinned keys."""

    def run(batches):
        for batch in _probes(buckets)(batches):
            keys = np.frombuffer(b"".join(column(batch, "keys").to_pylist()), np.uint64)
            _, blobs = thinned(keys, bucket_of(keys, buckets), buckets)
            yield batch.set_column(batch.schema.get_field_index("keys"), "keys", pa.array(blobs, pa.binary()))

    return run


def _looked_up(buckets: int):
    """Each bucket's segment comes first, then what the chunks ask of it: (chunk, n, q, levels) in the order of what was asked.

    What stands together in a batch is asked together, PROBED hashes at a time.
    """

    def run(batches):
        now, lbf = None, None
        for batch in trimmed(batches):
            own = longs(batch, "q")
            segment = longs(batch, "chunk") == _SEGMENT
            cuts = np.flatnonzero((own[1:] != own[:-1]) | segment[1:] | segment[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
                if a == b:
                    continue
                q, blobs = int(own[a]), column(batch, "keys").slice(a, b - a).to_pylist()
                if segment[a]:
                    bits = 64 * np.frombuffer(column(batch, "sizes")[a].as_py(), np.uint32).astype(np.int64)
                    now, lbf = q, Filter(bits, np.frombuffer(blobs[0], np.uint8), first=-(-q * CELLS // buckets))
                    continue
                keys, counts = thickened(blobs, q, buckets)
                levels = np.zeros(len(keys), np.uint8)  # a bucket without a segment holds nothing
                for i in range(0, len(keys) if q == now else 0, PROBED):
                    levels[i : i + PROBED] = lbf.levels(keys[i : i + PROBED])
                yield pa.RecordBatch.from_arrays(
                    [*(column(batch, c).slice(a, b - a) for c in ("chunk", "n", "q")), binaries(levels.tobytes(), np.append(0, np.cumsum(counts)))], ["chunk", "n", "q", "levels"])

    return run


def _score_dealt(model):
    """Scores chunk by chunk, by the levels that came back."""

    def run(batches):
        _, _, *known = model.value
        for _, held in grouped(batches, "chunk"):
            rows = pa.Table.from_batches(held).combine_chunks()
            here = pa.compute.equal(rows["q"], _TEXT)
            texts, answers = rows.filter(here).combine_chunks(), rows.filter(pa.compute.invert(here))
            n, starts = texts["n"].to_numpy(), answers["n"].to_numpy()
            firsts, sizes = runs(starts)
            bounds = np.append(np.searchsorted(n, starts[firsts]), len(n)).tolist()
            for a, b, first, size in zip(bounds, bounds[1:], firsts.tolist(), sizes.tolist()):
                batch = texts.slice(a, b - a).combine_chunks().to_batches()[0]
                keys = _asked(column(batch, "text"))
                levels = np.frombuffer(b"".join(answers["levels"].slice(first, size).to_pylist()), np.uint8).astype(np.int64)
                if len(keys) != len(levels):
                    raise ValueError("a chunk's n-grams and their levels do not agree")
                yield _scores(batch, lambda asked: levels[np.searchsorted(keys, asked)], *known)  # noqa: B023

    return run


def scored(docs: DataFrame, fitted: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text, held_out)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    kinds = "doc_id long, held_out boolean, n_tokens long, hot_known long, hot_base double, score double, cold array<long>, tf array<int>"
    if fitted["segments"] is None:
        rows = docs.mapInArrow(_score(fitted["model"]), kinds)
    else:
        spark = docs.sparkSession
        docs, docs_path = written_at(docs.mapInArrow(_chunks, "chunk long, n long, doc_id long, text string, held_out boolean"))
        asked = docs.select("chunk", "n", "text").mapInArrow(_sent(fitted["buckets"]), "q long, chunk long, n long, keys binary").withColumn("sizes", F.lit(None).cast("binary"))
        asked = asked.unionByName(fitted["segments"].select("q", F.lit(_SEGMENT).cast("long").alias("chunk"), F.lit(0).cast("long").alias("n"), F.col("segment").alias("keys"), "sizes"))
        # written, so that what was asked goes before the texts are dealt
        levels, levels_path = written_at(asked.repartition(parts(spark), "q").sortWithinPartitions("q", "chunk", "n").mapInArrow(
            _looked_up(fitted["buckets"]), "chunk long, n long, q long, levels binary"))
        both = docs.withColumn("q", F.lit(_TEXT).cast("long")).unionByName(levels, allowMissingColumns=True)
        both = both.repartition(parts(spark), "chunk").sortWithinPartitions("chunk", "n", "q")
        rows = both.mapInArrow(_score_dealt(fitted["model"]), kinds)
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    fitted["model"].unpersist()  # executors need it no more
    if fitted["segments"] is not None:
        dropped(spark, docs_path, levels_path)
    cold = rows.select("_row", F.explode(F.arrays_zip("cold", "tf")).alias("x")).select("_row", F.col("x.cold").alias("key"), F.col("x.tf").alias("tf"))
    cold = cold.join(fitted["cold"], "key").groupBy("_row").agg(
        F.sum(F.col("tf").cast("long")).alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("c") + F.lit(1.0))).alias("more_base"))
    n, v = fitted["N"], fitted["V"]
    return rows.drop("cold", "tf").join(cold, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", split_mod(7, 2).alias("held_out"))
    return scored(docs, train(docs.where("not held_out"), most_bits=0))  # one way at all sizes: what a small table costs tells what a large one does
