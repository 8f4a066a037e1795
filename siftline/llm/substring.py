"""Substring dedup by super-k-mer partitioning.

A window is WIDTH consecutive words of a document.  Consecutive windows that share
a minimiser (the least hash of their MINIMISER-word grams) travel as one packed
string of words to the bucket of that minimiser; there the windows are unpacked and
sorted, and equal neighbours, compared word for word, are occurrences of one window.
Every word under a window that also starts earlier (smaller doc_id, or earlier in
the same document) is removed.

What keeps the traffic bounded:
* a first pass counts minimisers; a bitmap of those seen twice (at most `map_bits`
  bits, whatever the input) lets windows that cannot repeat stay at home.  A full
  bitmap only sends more windows, it loses none; a super-k-mer has LONGEST windows at most;
* a packed string that a task has sent before, from an earlier position, does not
  travel again: its windows are repeats already, and it is marked at once;
* windows under a hot minimiser (HOT super-k-mers and more, whatever the input) travel
  one by one under their own hash, so that a common word sequence is spread, and a
  common passage is sent once per task.  These minimisers are a bitmap, too (HOT_BITS).

Null texts have no words.  Rows that share doc_id and text stand at the same
position: neither is earlier than the other, and both get the same answer.  Rows of
one doc_id with different texts are both answered; equal starts are not earlier, either.
A null doc_id sorts before all others.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, column, dropped, grouped, id_of, keyed, longs, parts, trimmed, written_at
from .textops import Words, dealt, mix, ngrams, runs, sliding_min

WIDTH = 20
MINIMISER = 4
BUCKETS = 1024
MAP_BITS = 1 << 28
HOT_BITS = 1 << 26
#: super-k-mers of a minimiser from which its windows travel one by one, whatever the input
HOT = 10_000
#: windows of a super-k-mer at most: with HOT, the bound of a bucket
LONGEST = 256
#: bytes of packed strings a task remembers
REMEMBERED = 16 << 20


def _super_kmers(words: Words, width: int, size: int):
    """(first window, last window + 1, minimiser) of each super-k-mer, and the window hashes and starts."""
    n = len(words.starts) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, np.uint64), none, np.zeros(0, np.uint64)
    least = sliding_min(ngrams(words.hash, size), width - size + 1)
    at = np.flatnonzero(words.row[:n] == words.row[width - 1 :])
    if not len(at):
        return none, none, np.zeros(0, np.uint64), none, np.zeros(0, np.uint64)
    mins = least[at]
    cut = np.flatnonzero((mins[1:] != mins[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first = np.concatenate([[0], cut])
    sizes = np.diff(np.append(first, len(at)))
    if (sizes > LONGEST).any():  # long runs of one minimiser are cut
        pieces = -(-sizes // LONGEST)
        first = np.repeat(first, pieces) + LONGEST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        cut = first[1:]
    last = np.append(cut, len(at)) - 1
    return at[first], at[last] + 1, mins[first], at, mins


def _minimisers(width: int, size: int, buckets: int):
    def run(batches):
        for batch in chunked(batches):
            words = Words(column(batch, "text"))
            first, last, found, at, mins = _super_kmers(words, width, size)
            if not len(found):
                continue
            # a window that recurs inside its own super-k-mer needs its minimiser counted again:
            # at 1 .. width - size words by the windows themselves, further off by the super-k-mer's length
            long = found[last - first > width - size + 1]  # and by its pieces, where it was cut
            whole = ngrams(words.hash, width)
            again = np.zeros(len(whole), bool)
            for step in range(1, width - size + 1):
                same = whole[:-step] == whole[step:]
                again[step:] |= same & (words.row[: len(same)] == words.row[step : step + len(same)]) if len(same) else False
            found = np.sort(np.concatenate([found, long, mins[again[at]]]))
            q = dealt(found, buckets)
            starts, sizes = runs(q)
            raw = found.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(q[starts], pa.int64()), pa.array([raw[8 * a : 8 * (a + n)] for a, n in zip(starts.tolist(), sizes.tolist())], pa.binary())],
                ["q", "blob"],
            )

    return run


def _counted(width: int, hot_least: int):
    """(q, n, hot, keys, counts): of each bucket the keys seen twice, with their counts, and how many of them are hot."""

    def run(batches):
        for q, held in grouped(batches, "q"):
            raw = b"".join(x for b in held for x in column(b, "blob").to_pylist())
            keys = np.sort(np.frombuffer(raw, np.uint64) if width == 8 else widened(raw))
            starts, sizes = runs(keys)
            twice = sizes > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([q], pa.int64()), pa.array([int(twice.sum())], pa.int64()), pa.array([int((sizes[twice] >= hot_least).sum())], pa.int64()),
                 pa.array([keys[starts[twice]].tobytes()], pa.binary()), pa.array([sizes[twice].astype(np.int64).tobytes()], pa.binary())],
                ["q", "n", "hot", "keys", "counts"],
            )

    return run


def _segments(bits: int, hot_bits: int, hot_least: int):
    """Each segment of the bitmap of repeated keys, and of that of hot keys."""

    def run(batches):
        for c, held in grouped(batches, "c"):
            maps = np.zeros(bits // BUCKETS, bool), np.zeros(hot_bits // BUCKETS, bool)
            for b in held:
                for keys, counts in zip(column(b, "keys"), column(b, "counts")):
                    keys, counts = np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64)
                    for flags, own in zip(maps, (keys, keys[counts >= hot_least])):
                        flags[(own % np.uint64(len(flags))).astype(np.int64)] = True
            packed = [pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary()) for x in maps]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), *packed], ["c", "segment", "hot"])

    return run


class Repeats:
    """Which hashes may occur twice, and which may occur very often: two bitmaps of bounded size, in one segment a bucket."""

    def __init__(self, bitmap: np.ndarray, hot: np.ndarray):
        self.map, self.hot = bitmap, hot

    @staticmethod
    def _in(bitmap, keys):
        own = 8 * len(bitmap) // BUCKETS
        at = dealt(keys, BUCKETS) * own + (keys % np.uint64(own)).astype(np.int64)
        return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def may(self, keys: np.ndarray) -> np.ndarray:
        return self._in(self.map, keys)

    def often(self, keys: np.ndarray) -> np.ndarray:
        return self._in(self.hot, keys)


def narrowed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the keys' upper 48 bits in order, those bits as rows of 6 bytes): less to send where only "seen twice" matters."""
    top = keys >> np.uint64(16)
    mixed = mix(top)
    order = np.argsort(mixed)
    return mixed[order], np.ascontiguousarray(top[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def widened(raw: bytes) -> np.ndarray:
    """The hashes of keys sent as 6 bytes each."""
    full = np.zeros((len(raw) // 6, 8), np.uint8)
    full[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return mix(full.view("<u8").ravel().astype(np.uint64))


def fineness(docs: DataFrame) -> int:
    """How many buckets of keys share a segment of the bitmaps: more for tables of many splits, so that a bucket stays small."""
    return -(-docs.rdd.getNumPartitions() // 4096)


def repeats_of(blobs: DataFrame, map_bits: int = MAP_BITS, hot_least: int = HOT, width: int = 8, fine: int = 1):
    """A broadcast Repeats of (q, blob of uint64, or of 6-byte keys) rows, q of BUCKETS * fine; hot are keys counted hot_least times and more.

    Both bitmaps have 16 bits a key, but map_bits and HOT_BITS at most, whatever the input.
    """
    spark = blobs.sparkSession
    found = blobs.repartition(parts(spark), "q").sortWithinPartitions("q").mapInArrow(_counted(width, hot_least), "q long, n long, hot long, keys binary, counts binary")
    found, path = written_at(found)
    n, hot = found.agg(F.sum("n"), F.sum("hot")).first()

    def size(keys, most):
        bits = BUCKETS * 64
        while bits < min(most, 16 * (keys or 0)):
            bits *= 2
        return bits

    bits, hot_bits = size(n, map_bits), size(hot, HOT_BITS)
    maps = np.zeros(bits // 8, np.uint8), np.zeros(hot_bits // 8, np.uint8)
    at = found.select(F.expr(f"q div {fine}").alias("c"), "keys", "counts").repartition(min(parts(spark), BUCKETS), "c").sortWithinPartitions("c")
    for r in at.mapInArrow(_segments(bits, hot_bits, hot_least), "c long, segment binary, hot binary").toLocalIterator():  # map_bits + HOT_BITS at most
        for to, segment in zip(maps, (r.segment, r.hot)):
            own = len(to) // BUCKETS
            to[r.c * own : (r.c + 1) * own] = np.frombuffer(segment, np.uint8)
    dropped(spark, path)
    return spark.sparkContext.broadcast(maps)


_ROW = "kind byte, key long, _k long, _fp long, at long, n long, packed binary"
_NAMES = ["kind", "key", "_k", "_fp", "at", "n", "packed"]
_TYPES = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
SEND, MARK = 0, 1


def _pack(repeats, width: int, size: int):
    def run(batches):
        rep, seen, held = Repeats(*repeats.value), {}, 0
        for batch in chunked(batches):
            words = Words(column(batch, "text"))
            first, last, mins, _, _ = _super_kmers(words, width, size)
            if not len(first):
                continue
            may = rep.may(mins)
            first, last, mins = first[may], last[may], mins[may]
            often = rep.often(mins)
            if often.any():  # one window each, under a hash of its own
                lone = np.concatenate([np.arange(a, b) for a, b in zip(first[often], last[often])])
                keys = mix(ngrams(words.hash, width)[lone] + np.uint64(1))
                first, last, mins = np.concatenate([first[~often], lone]), np.concatenate([last[~often], lone + 1]), np.concatenate([mins[~often], keys])
            text, starts, ends = words.normal()
            k, fp, row = longs(batch, "_k"), longs(batch, "_fp"), words.row[first]
            at = first - words.first[row]
            out = [[], [], [], [], [], [], []]
            for key, rk, rf, a, n, lo, hi in zip(mins.view(np.int64).tolist(), k[row].tolist(), fp[row].tolist(), at.tolist(),
                                                 (last - first).tolist(), starts[first].tolist(), ends[last + width - 2].tolist()):
                packed = text[lo:hi]
                before = seen.get(packed)
                here = (rk, a, rf)
                if here == before:
                    continue
                if before is None or here[:2] <= before[:2]:  # another text at the same position is not later
                    held += 0 if before else len(packed)
                    seen[packed] = here
                    kind = SEND
                else:
                    kind, key, packed = MARK, rk, None  # by its document: a hot bucket's marks are spread
                for to, x in zip(out, (kind, key, rk, rf, a, n, packed)):
                    to.append(x)
            if held > REMEMBERED:
                seen.clear()
                held = 0
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _TYPES)], _NAMES)

    return run


def _ranges(k, fp, at, width):
    """Rows for the windows at `at`, sorted by document and position: neighbours become one range of words."""
    if not len(k):
        return None
    cut = np.flatnonzero((k[1:] != k[:-1]) | (fp[1:] != fp[:-1]) | (at[1:] > at[:-1] + width)) + 1
    lo = np.concatenate([[0], cut])
    hi = np.append(cut, len(k)) - 1
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k[lo], fp[lo], at[lo], at[hi] + width)], ["_k", "_fp", "lo", "hi"])


def _count(width: int, most: int = 4 << 20):
    """Sorts the windows of whole buckets; yields the word ranges under windows that also start earlier."""

    def windows(held):
        data = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        words = Words(column(data, "packed"))
        n = longs(data, "n")
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = words.first[row] + step
        key = ngrams(words.hash, width)[start]
        k, fp, at = longs(data, "_k")[row], longs(data, "_fp")[row], longs(data, "at")[row] + step
        bucket = longs(data, "key")[row]
        order = np.lexsort((at, k, key, bucket))
        same = (key[order][1:] == key[order][:-1]) & (bucket[order][1:] == bucket[order][:-1])
        if not same.any():
            return None
        text, starts, ends = words.normal()
        lo, hi = starts[start[order]].tolist(), ends[start[order] + width - 1].tolist()
        place = np.arange(len(order))
        lead = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), place, 0))
        late = np.zeros(len(order), bool)
        late[1:] = same
        odd = [i for i, j in zip((np.flatnonzero(same) + 1).tolist(), lead[1:][same].tolist()) if text[lo[i] : hi[i]] != text[lo[j] : hi[j]]]
        late &= (k[order] != k[order][lead]) | (at[order] != at[order][lead])
        for j in {int(lead[i]) for i in odd}:  # unequal windows of one hash
            firsts = {}
            for i in np.flatnonzero(lead == j).tolist():
                at_first = firsts.setdefault(text[lo[i] : hi[i]], i)
                late[i] = (k[order[i]], at[order[i]]) != (k[order[at_first]], at[order[at_first]])
        late = order[late]
        late = late[np.lexsort((at[late], fp[late], k[late]))]
        return _ranges(k[late], fp[late], at[late], width)

    def run(batches):
        held, size = [], 0

        def emit(group):
            out = windows(group)
            return [out] if out is not None else []

        now = None
        for batch in trimmed(batches):
            if not batch.num_rows:
                continue
            kinds = column(batch, "kind").to_numpy()
            if (kinds == MARK).any():
                mark = batch.filter(pa.array(kinds == MARK))
                lo = longs(mark, "at")
                yield pa.RecordBatch.from_arrays([column(mark, "_k"), column(mark, "_fp"), pa.array(lo), pa.array(lo + longs(mark, "n") + width - 1)], ["_k", "_fp", "lo", "hi"])
                batch = batch.filter(pa.array(kinds != MARK))
                if not batch.num_rows:
                    continue
            keys = longs(batch, "key")
            if size > most:
                whole = int(np.searchsorted(keys != now, True)) if (keys != now).any() else len(keys)
                if whole < len(keys):  # the last bucket held ends here
                    if whole:
                        held.append(batch.slice(0, whole))
                    yield from emit(held)
                    held, size, batch = [], 0, batch.slice(whole)
            held.append(batch)
            size += batch.nbytes
            now = int(keys[-1])
        if held:
            yield from emit(held)

    return run


def repeated_ranges(docs: DataFrame, width: int = WIDTH, size: int = MINIMISER) -> DataFrame:
    """_k, _fp, lo, hi: word ranges of a document row that lie under windows which also start earlier."""
    spark = docs.sparkSession
    base = keyed(docs)
    fine = fineness(base)
    repeats = repeats_of(base.select("text").mapInArrow(_minimisers(width, size, BUCKETS * fine), "q long, blob binary"), fine=fine)
    sent = base.mapInArrow(_pack(repeats, width, size), _ROW)
    dealt_rows = sent.repartition(parts(spark), "key").sortWithinPartitions("key")
    return dealt_rows.mapInArrow(_count(width), "_k long, _fp long, lo long, hi long")


def _remove(digest: bool, names: list):
    def run(batches):
        for batch in trimmed(batches):
            n, gone, kept = [], [], []
            for text, spans in zip(column(batch, "text").cast(pa.binary()).to_pylist(), column(batch, "spans").to_pylist()):
                words = text.split() if text else []
                n.append(len(words))
                if spans:
                    left, done = [], 0
                    for s in spans:
                        if s["hi"] > done:
                            left += words[done : s["lo"]] if s["lo"] > done else []
                            done = max(done, s["hi"])
                    left += words[done:]
                else:
                    left = words
                gone.append(len(words) - len(left))
                out = b" ".join(left)
                kept.append(hashlib.sha256(out).hexdigest() if digest else out)
            kept = pa.array(kept, pa.string()) if digest else pa.array(kept, pa.binary()).cast(pa.string())
            rest = [batch.column(i) for i, x in enumerate(batch.schema.names) if x not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), kept], names)

    return run


def deduplicated(docs: DataFrame, digest: bool = False, width: int = WIDTH, more: tuple = ()) -> DataFrame:
    """doc_id, further columns, n_words, n_removed, kept (the kept words joined by a space, or its SHA-256)."""
    spans = repeated_ranges(docs, width).groupBy("_k", "_fp").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    rows = keyed(docs, *more).join(spans, ["_k", "_fp"], "left").select("_k", *more, "text", "spans")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    names = ["_k", *more, "n_words", "n_removed", "kept"]
    rows = rows.mapInArrow(_remove(digest, names), f"_k long, {kinds + ', ' if kinds else ''}n_words long, n_removed long, kept string")
    return rows.select(id_of().alias("doc_id"), *more, "n_words", "n_removed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return deduplicated(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late)),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
