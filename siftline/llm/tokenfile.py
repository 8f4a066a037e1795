"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A folder of token files holds three Parquet tables, which any store that Spark writes to can keep:

* blocks: one row per block of whole documents, in ascending doc_id order over the shards: shard, block, start (ids of
  the shard before it), doc_ids, sizes and crcs (of each document the number and the unsigned crc32 of its ids), control, data;
* ranks: rank, id, n; the most frequent id has rank 0, equal counts go by the id;
* shards: shard, start (ids of all shards before it), ids, docs.

An id is stored as its rank in 1 to 4 bytes (`data`, little-endian, no wasted zeros).  The byte counts stand apart in
`control`: two bits an id, four ids a byte, the first in the lowest bits; each document begins a new control byte.  A reader
looks the counts of each control byte up in a table, sums them to offsets, and gathers all ids of a block at once.

Encoding is the tokenizers library's on every distinct stretch between ASCII white space; neither the normaliser nor the
pre-tokeniser of such a file looks across white space (cutting() refuses files for which that is not known), so the ids of a
text are those of its stretches.  A worker remembers the ids of stretches, in bounded memory, by 64-bit hashes.  Stretches of ASCII and Latin-1 letters alone go to the library's model in lower case,
past the normaliser and the pattern, which then leave them as they are (plain() says for which files).

Null texts are empty and hold the end id alone.  Null ids come first.  Rows that share an id follow by the text's hash.  Extra
columns are ignored.  An empty table gives empty files.  Texts of any length are encoded in slices of 2 MB, cut at white space;
one stretch without white space goes to the library whole.  A block holds whole documents, so a document's ids are in memory at once.
"""
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import dropped
from .bpe import byte_letters
from .common import binaries, chunked, column, longs, scratch, table, text_buffers, trimmed
from .textops import Words, runs

#: bytes of data in a block (a longer document is a block by itself)
BLOCK_BYTES = 1 << 17
#: bytes of text that are cut into stretches at once
SLICE = 2 << 20
#: bytes of each of the two memories of a worker: the full one becomes the older one
REMEMBERED = 32 << 20
_GAP = re.compile(rb"[\t-\r ]")
#: ASCII letters and the letters from U+00C0 to U+00FF, in UTF-8
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: by byte: 1 for an ASCII letter, 2 for another ASCII sign but the apostrophe, 0 for the rest
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[39] = 0
_SHIFTS = np.array([0, 2, 4, 6], np.uint8)
#: the four byte counts that a control byte stands for
_COUNTS = ((np.arange(256, dtype=np.uint8)[:, None] >> _SHIFTS) & 3) + 1


def _slots(sizes: np.ndarray) -> np.ndarray:
    """The place of every number among control slots, of which each document has a multiple of four."""
    padded = -(-sizes // 4) * 4
    return np.arange(int(sizes.sum())) + np.repeat(np.cumsum(padded) - padded - (np.cumsum(sizes) - sizes), sizes)


def pack(ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, data bytes, data bytes of each document) of unsigned 32-bit numbers; sizes: how many each document has."""
    ranks = ranks.astype(np.uint32, copy=False)
    more = (ranks > 0xFF).astype(np.uint8)
    for most in (0xFFFF, 0xFFFFFF):
        if len(ranks) and ranks.max() > most:
            more += ranks > most
    slots = np.zeros(int((-(-sizes // 4) * 4).sum()), np.uint8)
    slots[_slots(sizes)] = more
    control = (slots.reshape(-1, 4) << _SHIFTS).sum(1, dtype=np.uint8)
    ends = np.cumsum(more, dtype=np.int64)
    ends += np.arange(1, len(more) + 1)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - more - 1
    data[starts] = ranks
    for j in range(1, int(more.max()) + 1 if len(more) else 0):
        there = np.flatnonzero(more >= j)
        data[starts[there] + j] = ranks[there] >> np.uint32(8 * j)
    return control, data, np.diff(np.append(0, ends)[np.append(0, np.cumsum(sizes))])


def unpack(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of pack()."""
    if len(control) != int((-(-sizes // 4)).sum()):
        raise ValueError("the control bytes and the documents of a block do not agree")
    counts = _COUNTS[control].ravel()[_slots(sizes)]
    starts = np.cumsum(counts, dtype=np.int64)
    if (int(starts[-1]) if len(starts) else 0) != len(data):
        raise ValueError("the control bytes and the data of a block do not agree")
    starts -= counts
    out = data[starts].astype(np.uint32)
    for j in range(1, int(counts.max()) if len(counts) else 0):
        there = np.flatnonzero(counts > j)
        out[there] |= data[starts[there] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


# Fixed value: the pattern of words of the known tokenizer files; letters, single digits, and other signs, which no word mixes but for 's and the like.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cutting(source: str) -> None:
    """An error for a tokenizer file whose ids may depend on what stands beyond white space, or beyond a letter and a sign."""
    spec = json.loads(source)
    kinds = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}
    steps = (spec.get("normalizer") or {"normalizers": []}).get("normalizers", [spec.get("normalizer")])
    calm = any(s["type"] == "Lowercase" for s in steps) and all(s["type"] in kinds or s["type"] == "Replace" and s["pattern"].get("Regex") == "\\s+" and s["content"] == " " for s in steps)
    pre = spec.get("pre_tokenizer") or {}
    first = pre.get("pretokenizers", [pre])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    outside = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and pattern == _PATTERN
    if not (calm and outside and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"])):
        raise ValueError("this tokenizer's words may depend on the white space around them")


def cut_apart(data: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes, offsets) of texts with a space between ASCII letters and ASCII signs, and with ASCII letters in lower case unless a
    combining mark could follow: both as the library would have it, so that fewer stretches are different."""
    kind = _KIND[data]
    at = np.flatnonzero((kind[1:] ^ kind[:-1]) == 3) + 1
    low = data.copy()
    capital = (data >= 65) & (data <= 90)
    capital[:-1] &= data[1:] < 128
    low[capital] += 32
    return np.insert(low, at, 32).tobytes(), offs + np.searchsorted(at, offs)


def plain(source: str) -> str | None:
    """The tokenizer file without the steps that pass _LETTERS in lower case between white space unchanged; None if the file has others,
    or if its ids do not tell where a word of letters ends."""
    spec = json.loads(source)
    model, mark = spec["model"], spec["model"].get("end_of_word_suffix")
    _, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [None])
    bytewise = len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0].get("add_prefix_space", True) and not rest[0].get("use_regex", True)
    whole = model.get("type") == "BPE" and mark and not model.get("dropout") and all(x in model["vocab"] and x + mark in model["vocab"] for x in byte_letters())
    if not (bytewise and whole) or spec.get("post_processor") or any(_LETTERS.fullmatch(t["content"].encode()) for t in spec["added_tokens"]):
        return None
    return json.dumps({**spec, "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}, "added_tokens": []})


def _taken(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The given pieces of pool, one behind the other."""
    ends = np.cumsum(sizes)
    return pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class Memory:
    """Ids of stretches, by hash."""

    def __init__(self, kind: str):
        self.hash, self.start, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def size(self) -> int:
        return self.hash.nbytes + self.start.nbytes + self.count.nbytes + self.pool.nbytes

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are known, where they stand) of sorted hashes."""
        if not len(self.hash):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return self.hash[at] == hashes, at

    def add(self, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Hashes that are not known yet, with the number of ids of each and all these ids."""
        order = np.argsort(hashes)
        at = np.searchsorted(self.hash, hashes[order])
        starts = len(self.pool) + np.cumsum(counts) - counts
        self.hash, self.start, self.count = (np.insert(old, at, x[order]) for old, x in ((self.hash, hashes), (self.start, starts), (self.count, counts)))
        self.pool = np.append(self.pool, ids)


class Encoder:
    """Texts to ids by the library, each distinct stretch once while it is remembered; new stretches go to the library as one text."""

    def __init__(self, source: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.model, self.kind = Tokenizer.from_str(source), kind
        self.model.no_padding()
        self.model.no_truncation()
        short = plain(source)
        self.letters = short and Tokenizer.from_str(short)
        if short:
            self.letters.no_padding()
            self.letters.no_truncation()
            model = json.loads(source)["model"]
            self.last = np.zeros(max(model["vocab"].values()) + 1, bool)  # ids of words' ends
            self.last[[i for x, i in model["vocab"].items() if x.endswith(model["end_of_word_suffix"])]] = True
        self.special = [t["content"].lower().encode() for t in json.loads(source)["added_tokens"]]
        self.known, self.older = Memory(kind), Memory(kind)

    def _learn(self, text: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Remembers stretches of text: from the older memory, or from the library, whose ids, or their places, tell whose they are."""
        again, at = self.older.find(hashes)
        if again.any():
            counts = self.older.count[at[again]]
            self.known.add(hashes[again], counts, _taken(self.older.pool, self.older.start[at[again]], counts))
        new = np.flatnonzero(~again)
        words = [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())]
        letters = np.array([self.letters is not None and (w.isalpha() or _LETTERS.fullmatch(w) is not None) for w in words], bool)  # isalpha() of bytes: ASCII letters
        if letters.any():
            row = self.letters.encode_batch_fast([b" ".join(w for w, there in zip(words, letters.tolist()) if there).decode().lower()], add_special_tokens=False)[0]
            ids = np.array(row.ids, self.kind)
            self._keep(hashes[new[letters]], ids, np.append(0, np.flatnonzero(self.last[ids]) + 1))
        if not letters.all():
            texts = [w.decode("utf-8", "replace") for w, there in zip(words, letters.tolist()) if not there]
            row = self.model.encode(" ".join(texts), add_special_tokens=False)
            places = np.fromiter((a for a, _ in row.offsets), np.int64, len(row.ids))
            self._keep(hashes[new[~letters]], np.array(row.ids, self.kind), np.searchsorted(places, np.cumsum([0, *(len(x) + 1 for x in texts)])))

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> None:
        """Remembers what the library has taken at once; cuts: where the ids of each stretch begin, and the end."""
        if len(cuts) != len(hashes) + 1:
            raise ValueError("the library's ids and the stretches do not agree")
        self.known.add(hashes, np.diff(cuts), ids)

    def _special(self, piece: bytes) -> bool:
        low = piece.lower()
        return any(x in low for x in self.special)

    def texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has) of texts that stand one behind the other in data."""
        whole = data.tobytes()
        text, cuts = cut_apart(data, offs)
        if self._special(whole):  # such texts stay as they are
            pieces = [whole[c:d] if self._special(whole[c:d]) else text[a:b] for a, b, c, d in zip(cuts.tolist(), cuts[1:].tolist(), offs.tolist(), offs[1:].tolist())]
            text, cuts = b"".join(pieces), np.cumsum([0, *map(len, pieces)])
        words = Words(binaries(text, cuts))
        order = np.argsort(words.hash)
        heads, sizes = runs(words.hash[order])
        first, own = order[heads], np.empty(len(order), np.int64)  # one of each hash, and whose every stretch is
        hashes, own[order] = words.hash[first], np.repeat(np.arange(len(first)), sizes)
        if self.known.size() > REMEMBERED:
            self.known, self.older = Memory(self.kind), self.known
        there, at = self.known.find(hashes)
        if not there.all():
            new = first[~there]
            self._learn(text, hashes[~there], words.starts[new], words.ends[new])
            _, at = self.known.find(hashes)
        starts, counts = self.known.start[at][own], self.known.count[at][own]
        return _taken(self.known.pool, starts, counts), np.diff(np.append(0, np.cumsum(counts))[words.first])

    def encode(self, text: bytes) -> bytes:
        """The ids of a text of any length, cut into slices at white space."""
        out, at = [], 0
        while at < len(text):
            gap = _GAP.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = gap.end() if gap else len(text)
            out.append(self.texts(np.frombuffer(text, np.uint8)[at:end], np.array([0, end - at]))[0].tobytes())
            at = end
        return b"".join(out)


#: the encoder of a worker process, which outlives a task
_HELD: dict = {}


def _encoder(source: str, kind: str) -> Encoder:
    if (source, kind) not in _HELD:
        _HELD.clear()
        _HELD[source, kind] = Encoder(source, kind)
    return _HELD[source, kind]


def _encoding(shared, end: int | None):
    def run(batches):
        source, kind = shared.value
        encoder = _encoder(source, kind)
        for batch in chunked(batches, most=SLICE):
            data, offs = text_buffers(column(batch, "text"))
            if len(data) <= SLICE:
                ids, sizes = encoder.texts(data, offs)
            else:  # one text
                ids = np.concatenate([np.frombuffer(encoder.encode(data[a:b].tobytes()), kind) for a, b in zip(offs, offs[1:])])
                sizes = np.array([len(ids)])
            ends = np.cumsum(sizes)
            if end is not None:
                ids, ends = np.insert(ids, ends, end), ends + np.arange(1, len(ends) + 1)
            ids = binaries(ids.tobytes(), ids.itemsize * np.append(0, ends))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("doc_id", "fp", "at")), ids], ["doc_id", "fp", "at", "ids"])

    return run


def _kind(source: str) -> str:
    """The type of staged ids: two bytes where the vocabulary allows it."""
    spec = json.loads(source)
    most = max([0, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return "<u2" if most < 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, end: int | None = None) -> tuple[DataFrame, str]:
    """(rows, type): doc_id, fp, at and ids (of that numpy type, with the end id behind) of every document."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    cutting(source)
    kind = _kind(source)
    if end is not None and end >= 1 << (8 * np.dtype(kind).itemsize):
        raise ValueError(f"the end id {end} does not fit the ids")
    shared = docs.sparkSession.sparkContext.broadcast((source, kind))  # a fixed public file of under 2 MB
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), F.monotonically_increasing_id().alias("at"), "text")
    return rows.mapInArrow(_encoding(shared, end), "doc_id long, fp long, at long, ids binary"), kind


def _counting(kind: str):
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in chunked(batches, "ids", BLOCK_BYTES * 8):
            n = np.bincount(text_buffers(column(batch, "ids"))[0].view(kind))
            if len(n) > len(total):
                n, total = total, n
            total[: len(n)] += n
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["id", "n"])

    return run


def ranked(staged: DataFrame, kind: str) -> DataFrame:
    """id, n, rank of the ids that occur, by falling count.  One row per id of the vocabulary at most."""
    counts = staged.select("ids").mapInArrow(_counting(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "id")).cast("long") - 1)


def _packing(shared, kind: str):
    width = np.dtype(kind).itemsize

    def run(batches):
        rank = shared.value
        for batch in chunked(batches, "ids", 4 * BLOCK_BYTES):
            data, offs = text_buffers(column(batch, "ids"))
            ids, cuts = data.view(kind), offs // width
            sizes = np.diff(cuts)
            control, packed, bytes_of = pack(rank[ids], sizes)
            plain = memoryview(ids.astype("<u4")).cast("B")
            crcs = [zlib.crc32(plain[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([
                *(column(batch, c) for c in ("doc_id", "fp", "at")), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()),
                binaries(control.tobytes(), np.append(0, np.cumsum(-(-sizes // 4)))), binaries(packed.tobytes(), np.append(0, np.cumsum(bytes_of))),
            ], ["doc_id", "fp", "at", "size", "crc", "control", "data"])

    return run


_BLOCK = "shard int, block int, start long, doc_ids array<long>, sizes array<long>, crcs array<long>, control binary, data binary"


def _blocks(batches):
    shard, block, start = TaskContext.get().partitionId(), 0, 0
    for batch in chunked(batches, "data", BLOCK_BYTES):
        one = lambda c: pa.array([column(batch, c).to_pylist()], pa.list_(pa.int64()))  # noqa: E731, B023
        joined = lambda c: pa.array([text_buffers(column(batch, c))[0].tobytes()], pa.binary())  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), one("doc_id"), one("size"), one("crc"), joined("control"), joined("data"),
        ], ["shard", "block", "start", "doc_ids", "sizes", "crcs", "control", "data"])
        block, start = block + 1, start + int(longs(batch, "size").sum())


def write(docs: DataFrame, tokenizer: str, path: str, end: int | None = None) -> None:
    """Encodes docs (doc_id, text) by a tokenizer file and writes token files below path.

    Ids are staged and counted, and staged again in coded form, which is what is shuffled: once, by ranges of (doc_id, text hash, row), so
    that a frequent id does not meet in one task.  The blocks are written where they arrive.
    """
    spark = docs.sparkSession
    rows, kind = encoded(docs, tokenizer, end)
    rows.write.option("compression", "zstd").parquet(f"{path}/staged")
    staged = spark.read.schema(rows.schema).parquet(f"{path}/staged")
    ranked(staged, kind).select("rank", "id", "n").coalesce(1).write.parquet(f"{path}/ranks")
    found = spark.read.parquet(f"{path}/ranks").toArrow()  # a row per id of the vocabulary at most
    ids = found["id"].to_numpy()
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank[ids] = found["rank"].to_numpy()
    coded = staged.mapInArrow(_packing(spark.sparkContext.broadcast(rank), kind), "doc_id long, fp long, at long, size long, crc long, control binary, data binary")
    coded.write.option("compression", "zstd").parquet(f"{path}/coded")
    dropped(spark, f"{path}/staged")
    coded = spark.read.schema(coded.schema).parquet(f"{path}/coded")
    order = [F.asc_nulls_first("doc_id"), F.col("fp"), F.col("at")]
    dealt = coded.repartitionByRange(*order).sortWithinPartitions(*order).drop("fp", "at")
    dealt.mapInArrow(_blocks, _BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    # a row per shard
    shards = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").groupBy("shard").agg(
        F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"), F.sum(F.size("doc_ids")).alias("docs"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards.withColumn("start", before.cast("long")).coalesce(1).write.parquet(f"{path}/shards")
    dropped(spark, f"{path}/coded")


def _reading(shared, digest: bool):
    def run(batches):
        ids_of = shared.value
        for batch in trimmed(batches):
            for i in range(batch.num_rows):
                one = {c: column(batch, c)[i] for c in ("start", "doc_ids", "sizes", "crcs", "control", "data")}
                sizes = one["sizes"].values.to_numpy()
                ends = np.cumsum(sizes)
                control, data = (np.frombuffer(one[c].as_buffer(), np.uint8) for c in ("control", "data"))
                ids, starts = ids_of[unpack(control, data, sizes)], ends - sizes
                plain = memoryview(ids).cast("B")
                crcs = [zlib.crc32(plain[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                if crcs != one["crcs"].as_py():
                    raise ValueError("a block of a token file is damaged")
                if digest:
                    last = pa.array(crcs, pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), pa.array(ids, pa.int64()))
                yield pa.RecordBatch.from_arrays([one["doc_ids"].values, pa.array(one["start"].as_py() + starts, pa.int64()), pa.array(sizes, pa.int64()), last],
                                                 ["doc_id", "start", "n_tokens", "ids"])

    return run


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document of the token files below path.

    With digest, ids is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.  A document that does not give its crc is an error.
    """
    found = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").toArrow()
    ids = np.zeros(max(1, found.num_rows), "<u4")
    ids[found["rank"].to_numpy()] = found["id"].to_numpy()
    first = spark.read.schema("shard int, start long").parquet(f"{path}/shards").withColumnRenamed("start", "_before")
    rows = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").join(F.broadcast(first), "shard")  # a row per shard
    rows = rows.select((F.col("start") + F.col("_before")).alias("start"), "doc_ids", "sizes", "crcs", "control", "data")
    kind = "long" if digest else "array<long>"
    return rows.mapInArrow(_reading(spark.sparkContext.broadcast(ids), digest), f"doc_id long, start long, n_tokens long, ids {kind}")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark)
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end=1)
    return read(spark, path, digest=True).withColumnRenamed("ids", "ids_crc32")
