"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are [0-9a-z and non-ASCII]+ of the lower-cased (A-Z) text.  A pattern is a
window of `width` consecutive words of an item, or the whole item if it is shorter.
Patterns of one length share a searcher: a shift table over blocks of two words
skips positions where no pattern can end, buckets keyed by the suffix block and the
prefix block select the patterns to test, and a direct comparison confirms them.

Patterns are spread over blocks of BLOCK_BYTES, which the tables take many times over;
each block is broadcast and runs against all documents.  A window of very many items is
several patterns of ITEMS items or so, in blocks of their own.  Long texts are searched
in slices that overlap by a window.  Null texts and texts without words have no words and no
hits; items without words have no pattern; items that share an id count as one;
document rows are answered one by one, repeated rows included; null ids stay null.
Items of a null id are left out unless `nameless`, which the query and the pipeline
set: then their windows are hits like any other, and they count together as one item
that the digest does not name.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, id_of, keyed, trimmed, written

#: bytes of patterns and ids of a block; items of a window that stay together
BLOCK_BYTES = 4 << 20
ITEMS = 1000
#: bytes of a text that are cut into words at once
SLICE = 1 << 20

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text) -> list:
    """Words of a text given as UTF-8 bytes or None."""
    return text.translate(_FOLD).split() if text else []


def slices(text, longest: int, size: int | None = None):
    """(number of the first word, words) of slices of a text: each begins with the longest - 1 words before it."""
    size, at, first, tail = size or SLICE, 0, 0, []
    text = text or b""
    while True:
        end = len(text)
        if end - at > size:
            folded = text[at : at + size].translate(_FOLD)
            space = folded.rfind(b" ")
            end = at + space if space > 0 else -1
            if end < 0:  # a word of more than a slice
                rest = text[at:].translate(_FOLD)
                space = rest.find(b" ", size)
                end = at + space if space > 0 else len(text)
        found = tail + words(text[at:end])
        yield first, found
        at = end
        if at >= len(text):
            return
        tail = found[len(found) - (longest - 1) :] if longest > 1 else []
        tail = tail if len(found) >= longest else found
        first += len(found) - len(tail)


class Searcher:
    """Wu-Manber tables for patterns (tuples of words) that all have the same length."""

    def __init__(self, patterns: dict):
        self.length = length = len(next(iter(patterns)))
        self.block = block = min(2, length)
        self.default = length - block + 1
        self.shift, self.buckets = {}, {}
        for pattern, value in patterns.items():
            for end in range(block, length + 1):
                key = pattern[end - block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            by_prefix = self.buckets.setdefault(pattern[-block:], {})
            by_prefix.setdefault(pattern[:block], []).append((list(pattern), value))

    def occurrences(self, text: list):
        """(start, value) of every occurrence, by start."""
        length, block, default = self.length, self.block, self.default
        shift, buckets, end, size = self.shift.get, self.buckets, self.length, len(text)
        two = block == 2
        while end <= size:
            key = (text[end - 2], text[end - 1]) if two else (text[end - 1],)
            skip = shift(key, default)
            if skip:
                end += skip
                continue
            start = end - length
            for pattern, value in buckets[key].get(tuple(text[start : start + block]), ()):
                if text[start:end] == pattern:
                    yield start, value
            end += 1


def searchers(patterns: dict) -> list:
    by_length = {}
    for pattern, value in patterns.items():
        by_length.setdefault(len(pattern), {})[pattern] = value
    return [Searcher(by_length[n]) for n in sorted(by_length)]


def _windows(width: int):
    def run(batches):
        for batch in batches:
            ids, keys, lengths = [], [], []
            for item, text in zip(column(batch, "item_id").to_pylist(), column(batch, "text").cast(pa.binary()).to_pylist()):
                found = words(text)
                n = min(width, len(found))
                for w in {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if n else ():
                    ids.append(item)
                    keys.append(b" ".join(w))
                    lengths.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.binary())], ["item_id", "pattern"])

    return run


def patterns_of(items: DataFrame, width: int = 10, nameless: bool = False) -> DataFrame:
    """pattern (words joined by a space), part, items: the sorted ids that hold it, null last, in parts of some ITEMS."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    rows = rows if nameless else rows.where("item_id is not null")
    rows = written(rows.mapInArrow(_windows(width), "item_id string, pattern binary"))
    # windows of many items are few: their ids are dealt to parts before they are collected
    many = rows.groupBy("pattern").count().where(F.col("count") > ITEMS).select("pattern", F.ceil(F.col("count") / ITEMS).alias("parts"))
    rows = rows.join(many, "pattern", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("item_id"), F.col("parts")), F.lit(0)).cast("long"))
    named, null = F.sort_array(F.collect_set("item_id")), F.array(F.lit(None).cast("string"))
    return rows.groupBy("pattern", "part").agg(F.when(F.count("item_id") < F.count("*"), F.concat(named, null)).otherwise(named).alias("items"))


def blocks_of(items: DataFrame, width: int, nameless: bool, block_bytes: int | None = None):
    """Broadcast blocks {pattern: item ids}, one after the other."""
    spark = items.sparkSession
    pats = written(patterns_of(items, width, nameless))
    total = pats.agg(F.sum(F.octet_length("pattern") + 64 + F.size("items") * 16)).first()[0] or 0
    blocks = int(total // (block_bytes or BLOCK_BYTES)) + 1
    for block in range(blocks):  # each block's bytes are bounded, up to the spread of the hash
        tables = {}
        for r in pats.where(F.pmod(F.xxhash64("pattern", "part"), F.lit(blocks)) == block).toLocalIterator():
            key = tuple(bytes(r.pattern).split())
            tables[key] = tables.get(key, ()) + tuple(r["items"])
        yield spark.sparkContext.broadcast(tables)


def _search(tables, out_names):
    def run(batches):
        found = searchers(tables.value)
        longest = max((s.length for s in found), default=1)
        for batch in trimmed(batches):
            n_words, n_hit, hit_items, spans = [], [], [], []
            for text in column(batch, "text").cast(pa.binary()).to_pylist():
                seen, covered, size = set(), [], 0
                for first, part in slices(text, longest):
                    size = first + len(part)
                    for s in found:
                        for start, value in s.occurrences(part):
                            seen.update(value)
                            covered.append((first + start, first + start + s.length))
                covered.sort()
                merged = []
                for a, b in covered:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                n_words.append(size)
                n_hit.append(sum(b - a for a, b in merged))
                hit_items.append(sorted(seen, key=lambda x: (x is None, x or "")))
                spans.append([{"lo": a, "hi": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
                + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hit_items, pa.list_(pa.string())),
                   pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                out_names,
            )

    return run


_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<lo:long,hi:long>>"


def find(docs: DataFrame, items: DataFrame, width: int = 10, block_bytes: int | None = None, nameless: bool = False) -> DataFrame:
    """_k, _fp, n_words, n_hit, items (sorted ids), spans (hit word ranges) of every document row."""
    base = keyed(docs)
    names = ["_k", "_fp", "n_words", "n_hit", "items", "spans"]
    results = [base.mapInArrow(_search(tables, names), f"_k long, _fp long, {_FOUND}") for tables in blocks_of(items, width, nameless, block_bytes)]
    if len(results) == 1:
        return results[0]
    return _merged(results)


def _merged(results: list) -> DataFrame:
    """One row per document row of the per-block results.

    Rows with the same key and text get the same answer, so their count is carried and unfolded.
    """
    counted = [r.groupBy("_k", "_fp").agg(
        F.count("*").alias("copies"), F.first("n_words").alias("n_words"),
        F.first("items").alias("items"), F.first("spans").alias("spans"),
    ) for r in results]
    rows = counted[0]
    for r in counted[1:]:
        rows = rows.unionByName(r)
    one = rows.groupBy("_k", "_fp").agg(
        F.max("copies").alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    cover = F.aggregate("spans", zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["hi"] - F.greatest(s["lo"], a["end"]))).alias("n"),
        F.greatest(a["end"], s["hi"]).alias("end")))
    one = one.withColumn("n_hit", cover["n"])
    return one.select("_k", "_fp", "n_words", "n_hit", "items", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_c")).drop("_c")


def decontaminated(docs: DataFrame, items: DataFrame, width: int = 10, nameless: bool = False) -> DataFrame:
    """One digest row per document: see the module's text."""
    return find(docs, items, width, nameless=nameless).select(
        id_of().alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = 10, nameless: bool = False) -> DataFrame:
    """The documents without a hit, unchanged.  A filter over one search pass a block: no join, no shuffle."""
    for tables in blocks_of(items, width, nameless):
        docs = docs.mapInArrow(_reject(tables), docs.schema)
    return docs


def _reject(tables):
    def run(batches):
        found = searchers(tables.value)
        longest = max((s.length for s in found), default=1)
        for batch in trimmed(batches):
            keep = []
            for text in column(batch, "text").cast(pa.binary()).to_pylist():
                keep.append(not any(next(s.occurrences(part), None) for _, part in slices(text, longest) for s in found))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True)


ORACLE = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pat AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
         array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), lens AS (SELECT DISTINCT n FROM pat),
grams AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, i, n FROM grams JOIN pat USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
