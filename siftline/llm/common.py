"""Shared plumbing: reading tables, the shared scratch folder, chunked Arrow input, row keys."""
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import dropped, scratch, spread, written, written_at  # noqa: F401

#: bytes of text that one numpy step holds at a time (a longer single text is one step by itself)
CHUNK_BYTES = 1 << 20
#: bytes of input after which a worker gives freed memory back
TRIM_BYTES = 32 << 20
NULL_KEY = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; small ones that come in few splits are spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "embeddings") else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """_k, _fp, text and more: a row key that holds for null ids and for rows that share an id."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("_k"),
        F.xxhash64("text").alias("_fp"), "text", *more,
    )


def id_of(key: str = "_k"):
    return F.when(F.col(key) != NULL_KEY, F.col(key))


def split_mod(n: int, held: int, column: str = "doc_id"):
    """True for the held-out rows: crc32 of the id as text, modulo n, is held; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n == held, F.lit(False))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def trim() -> None:
    """Gives memory that this process has freed back to the system: idle workers of an executor would else keep their peaks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def trimmed(batches):
    """The batches; freed memory goes back after every TRIM_BYTES of them, and at the end."""
    size = 0
    try:
        for batch in batches:
            yield batch
            size += batch.nbytes
            if size >= TRIM_BYTES:
                size = 0
                trim()
    finally:
        trim()


def chunked(batches, column: str = "text", most: int = CHUNK_BYTES):
    """Slices of the batches with about `most` bytes of text each."""
    for batch in trimmed(batches):
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        _, offs = text_buffers(col)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def column(batch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def longs(batch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def binaries(data: bytes, offsets: np.ndarray) -> pa.Array:
    """A binary column over consecutive slices of data."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def grouped(batches, key: str):
    """Whole groups of a stream that is sorted by an integer key: (key, record batches)."""
    held, now = [], None
    for batch in trimmed(batches):
        if not batch.num_rows:
            continue
        keys = longs(batch, key)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if now is not None and keys[a] != now:
                yield now, held
                held = []
            now = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held
