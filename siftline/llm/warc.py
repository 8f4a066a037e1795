"""WARC archives: writing captures and assembling transactions.

A capture is written as three records: a request, a response (or a revisit that refers
to the response with the same payload) and a metadata record.  Request and metadata
name their response in WARC-Concurrent-To; a revisit names the WARC-Record-ID of its
response in WARC-Refers-To.  Reading joins the three kinds through the former, resolves
revisits through the latter, and emits one nested row per capture.

Archives are *.warc.gz files in the shared folder, one gzip member a record, of at most
BLOCKS blocks.  A block is a row that Spark's text writer puts behind the last: a
warcinfo record and captures, closed at BLOCK_BYTES.  Its last record is small, so its
last byte is the high byte of a gzip length, a zero: the writer's line separator.

A payload of at least REVISIT_FROM bytes that several pages share is stored once, with
the smallest page_id; smaller payloads are always stored.  Digests are counted first; a
bitmap of those seen twice lets all other pages be written where they are read, and of
shared payloads one copy a task is shuffled.

Null html is an empty payload, null url an empty target; a null page_id sorts last.
Control characters and spaces of a url are percent-encoded in headers, and metadata
holds the url as it is.  Rows that share page_id and payload are separate captures, all
of them responses if their page_id is the smallest; the one of the least url is the one
that revisits refer to.
"""
import gzip
import hashlib
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, dropped, longs, scratch, table, trimmed, written, written_at
from .substring import BUCKETS, Repeats, fineness, repeats_of
from .textops import dealt, mix, runs

REVISIT_FROM = 100
#: compressed bytes of a block, and blocks of a file
BLOCK_BYTES = 1 << 20
BLOCKS = 32
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_ODD = re.compile("[\x00-\x20\x7f]")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(*names) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(json.dumps(names).encode()).digest())}>"


def _record(kind: str, uid: str, date: str, headers: list, content: str, block: bytes) -> bytes:
    """A record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {uid}", f"WARC-Date: {date}", *headers, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + _END + block + _END, 6, mtime=0)


def _capture(page, url: str, html, digest: str, size: int, number: int, first_page, first_url, date: str) -> bytes:
    """The records of one page; html is None for a revisit of first_page's response."""
    target = "WARC-Target-URI: " + _ODD.sub(lambda m: f"%{ord(m.group()):02X}", url)
    rest = re.sub("^[a-z]+://[^/]*", "", url)
    host = re.match("[a-z]+://([^/]*)", url)
    quoted = lambda x: _ODD.sub(lambda m: f"%{ord(m.group()):02X}", x)
    own = _urn("capture", page, url, digest, number)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if html is None:
        more = [f"WARC-Refers-To: {_urn('capture', first_page, first_url, digest, 1)}", f"WARC-Profile: {_PROFILE}"]
    else:
        head, more = head + html, []
    main = _record("revisit" if html is None else "response", own, date, [target, f"WARC-Payload-Digest: sha256:{digest}", *more], "application/http;msgtype=response", head)
    joined = [target, f"WARC-Concurrent-To: {own}"]
    request = f"GET {quoted(rest) or '/'} HTTP/1.1\r\nHost: {quoted(host.group(1)) if host else ''}\r\n\r\n".encode()
    fields = f"page-id: {'' if page is None else page}\r\npage-url: {json.dumps(url)}\r\npayload-bytes: {size}".encode()
    return (main + _record("request", _urn("request", own), date, joined, "application/http;msgtype=request", request)
            + _record("metadata", _urn("metadata", own), date, joined, "application/warc-fields", fields))


_PAGE = "page_id long, url string, html binary, digest string, size long"


def _archive(shared, date: str):
    """Blocks of captures.  shared: pages whose payload may be shared, or is small, are left out."""

    def run(batches):
        rep = Repeats(*shared.value) if shared is not None else None
        held, size = [], 0

        def info(uid):
            return _record("warcinfo", f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(uid).digest())}>", date, [], "application/warc-fields", b"format: WARC File Format 1.1")

        def block():
            if held[-1][-1]:  # a last record of 16 MB and more
                held.append(info(b"end" + held[-1]))
            return pa.RecordBatch.from_arrays([pa.array([(info(held[0]) + b"".join(held))[:-1]], pa.binary())], ["block"])

        for batch in trimmed(batches):
            rows = [column(batch, c).to_pylist() for c in ("page_id", "url", "digest", "size", "number", "first_page", "first_url")]
            keep = ~rep.may(_keys(rows[2])) & (longs(batch, "size") >= REVISIT_FROM) if rep is not None else np.ones(batch.num_rows, bool)
            html = column(batch, "html")
            for i in np.flatnonzero(keep).tolist():
                page, url, digest, length, number, first_page, first_url = (x[i] for x in rows)
                held.append(_capture(page, url, html[i].as_py(), digest, length, number, first_page, first_url, date))
                size += len(held[-1])
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return run


def _keys(digests: list) -> np.ndarray:
    return mix(np.array([int(x[:16], 16) for x in digests], np.uint64))


def _digest_blobs(buckets: int):
    def run(batches):
        for batch in batches:
            keys = np.sort(_keys(column(batch, "digest").to_pylist()))
            q = dealt(keys, buckets)
            starts, sizes = runs(q)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q[starts], pa.int64()), pa.array([keys[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist())], pa.binary())], ["q", "blob"])

    return run


def _maybe_shared(shared):
    def run(batches):
        rep = Repeats(*shared.value)
        for batch in trimmed(batches):
            if batch.num_rows:
                yield batch.filter(pa.array(rep.may(_keys(column(batch, "digest").to_pylist()))))

    return run


def write(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Writes the captures of pages (page_id, url, html) as WARC files below path."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.cast("binary").alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    large = rows.where(F.col("size") >= REVISIT_FROM)
    fine = fineness(rows)
    repeats = repeats_of(large.select("digest").mapInArrow(_digest_blobs(BUCKETS * fine), "q long, blob binary"), fine=fine)
    none = [F.lit(None).cast("long").alias("first_page"), F.lit(None).cast("string").alias("first_url")]
    # pages of a payload of their own
    alone = rows.select("*", F.lit(1).alias("number"), *none).mapInArrow(_archive(repeats, date), "block binary")
    # small payloads: equal rows are numbered
    small = rows.where(F.col("size") < REVISIT_FROM).groupBy("page_id", "url", "html", "digest", "size").count()
    number = F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("number")
    small = small.select("page_id", "url", "html", "digest", "size", number, *none)
    # payloads that may be shared: ids first, and one copy of the payload for the responses
    several = large.mapInArrow(_maybe_shared(repeats), _PAGE)
    ids, ids_path = written_at(several.groupBy("page_id", "url", "digest", "size").count())
    first = ids.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("null"), F.col("page_id").alias("page"), "url")).alias("f"))
    known = ids.join(first, "digest").select("page_id", "url", "digest", "size", number, F.col("f.page").alias("first_page"), F.col("f.url").alias("first_url"))
    response = F.col("page_id").eqNullSafe(F.col("first_page"))
    payload = several.groupBy("digest").agg(F.any_value("html").alias("html"))
    stored = known.where(response).join(payload, "digest")
    again = known.where(~response).withColumn("html", F.lit(None).cast("binary"))
    names = small.columns
    dealt_rows = small.unionByName(stored.select(names)).unionByName(again.select(names)).mapInArrow(_archive(None, date), "block binary")
    # bytes that are no UTF-8 pass through the text writer as they are
    blocks = alone.unionByName(dealt_rows).select(F.col("block").cast("string").alias("value"))
    blocks.write.option("lineSep", "\0").option("maxRecordsPerFile", BLOCKS).text(path)
    repeats.destroy()
    dropped(spark, ids_path)
    _named(spark, path)


def _named(spark, path: str) -> None:
    """Gives the writer's part files the name of what they are: renames, by the driver, in the file system's name space."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            fs.rename(f.getPath(), f.getPath().getParent().suffix("/" + name.removesuffix(".txt") + ".warc.gz"))


def members(data):
    """The unpacked gzip members of an archive, one after the other."""
    data, at, left = memoryview(data), 0, 4096
    while at < len(data):
        unpack, parts, step = zlib.decompressobj(31), [], left
        while not unpack.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a member")
            piece = data[at : at + step]
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
            step = min(step * 2, 1 << 20)
        yield b"".join(parts)


def records(data):
    """(headers, block) of every record of an archive."""
    for member in members(data):
        at = 0
        while at < len(member):
            end = member.index(_END, at)
            lines = member[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record at byte {at} of a member")
            headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            start, size = end + 4, int(headers["Content-Length"])
            yield headers, member[start : start + size]
            at = start + size + 4


_FIELDS = ["type", "id", "joined", "refers_to", "url", "http", "bytes", "digest", "declared", "fields", "payload"]
_SCHEMA = ("type string, id string, joined string, refers_to string, url string, http string, bytes long, "
           "digest string, declared string, fields map<string,string>, payload string")


def _parse(payloads: bool):
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), kinds)], _FIELDS)

    def run(batches):
        for batch in trimmed(batches):
            for raw in batch.column(0):
                rows, size = [], 0
                for h, block in records(raw.as_buffer()):
                    kind = h["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    head, _, body = block.partition(_END) if kind != "metadata" else (b"", b"", b"")
                    full = kind == "response"
                    fields = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if ": " in x] if kind == "metadata" else None
                    rows.append((
                        kind, h["WARC-Record-ID"], h.get("WARC-Concurrent-To", h["WARC-Record-ID"]), h.get("WARC-Refers-To"), h["WARC-Target-URI"],
                        head.decode() or None, len(body) if full else None, hashlib.sha256(body).hexdigest() if full else None,
                        h.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, fields, body.decode() if full and payloads else None))
                    size += len(body)
                    if size > 8 << 20 or len(rows) >= 4000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def parsed(spark, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives below path, but for warcinfo."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return files.mapInArrow(_parse(payloads), _SCHEMA)


def transactions(rows: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata, joined through concurrent-to.

    A capture without a request or metadata record keeps null there; a revisit whose
    response is missing keeps a null `resolved`.
    """
    main = rows.where("type in ('response', 'revisit')").select(
        F.col("id").alias("capture"), F.struct("type", "id", "url", "http", "bytes", "digest", "declared", "refers_to", "payload").alias("response"))
    request = rows.where("type = 'request'").select(F.col("joined").alias("capture"), F.struct("id", "url", "http").alias("request"))
    metadata = rows.where("type = 'metadata'").select(F.col("joined").alias("capture"), F.struct("id", "fields").alias("metadata"))
    nested = main.join(request, "capture", "left").join(metadata, "capture", "left")
    page = F.col("metadata.fields")["page-id"].try_cast("long")
    # of the responses only those that a revisit refers to are looked up
    seen = rows.where("refers_to is not null").select(F.col("refers_to").alias("capture")).distinct()
    stored = rows.where("type = 'response'").select(F.col("id").alias("capture"), "bytes", "digest").join(seen, "capture", "left_semi").join(metadata, "capture", "left")
    stored = stored.select(F.col("capture").alias("refers"), F.struct(page.alias("page_id"), "bytes", "digest").alias("resolved"))
    return (nested.withColumn("refers", F.col("response.refers_to")).join(stored, "refers", "left")
            .select("capture", page.alias("page_id"), "request", "response", "metadata", "resolved"))


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write(table(spark, sf_dir, "pages"), path)
    rows = transactions(written(parsed(spark, path)))  # parsed once; without payloads
    return rows.select(
        "page_id", F.coalesce("resolved.bytes", "response.bytes").alias("payload_bytes"),
        F.coalesce("resolved.digest", "response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("resolved.page_id").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
             min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to
FROM q
"""
