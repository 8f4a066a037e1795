"""Appends that are done whole or not at all, and once for each batch id.

A batch is written into a folder of its own by Spark's committer, which retries and aborts tasks as always; a record of one line then
names the folder.  Records are created, never replaced: of several writers of one batch the first counts, and what the others, or failed
ones, have written belongs to no record and is not read.  Readers go by the records alone.
"""
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .files import _fs, listed


def _record(path: str, batch: str) -> str:
    if not re.fullmatch(r"[\w.=-]+", batch) or batch.startswith((".", "_")):
        raise ValueError(f"a batch id of letters, digits, points and dashes, not {batch!r}")
    return f"{path}/records/{batch}.json"


def committed(spark: SparkSession, path: str) -> list:
    """The batch ids that are there, in order."""
    return [n.removesuffix(".json") for n in listed(spark, f"{path}/records", r"^[^._].*\.json$")]


def append(rows: DataFrame, path: str, batch: str, kind: str = "parquet", **options) -> bool:
    """Appends rows under a batch id; False if that batch is there already, in which case nothing is run.

    kind: any of Spark's file formats.  A failure leaves no record."""
    spark, record = rows.sparkSession, _record(path, batch)
    at, fs = _fs(spark, record)
    if fs.exists(at):
        return False
    folder = f"{batch}-{uuid.uuid4().hex}"
    rows.write.format(kind).options(**options).save(f"{path}/batches/{folder}")
    try:
        out = fs.create(at, False)  # an error where there is one: another writer was quicker
    except Exception as e:
        if not fs.exists(at):
            raise
        _delete(spark, f"{path}/batches/{folder}")
        if "exist" not in str(e):
            raise
        return False
    out.write(bytearray(json.dumps({"batch": batch, "folder": folder, "kind": kind}).encode() + b"\n"))
    out.close()
    return True


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def read(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The rows of all batches that have a record; a table without any is empty."""
    records = [json.loads(r.value) for r in spark.read.text(f"{path}/records/*.json").collect()] if committed(spark, path) else []  # a line a batch
    if any(r["kind"] != kind for r in records):
        raise ValueError(f"not all batches are {kind}")
    if not records:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(kind).load([f"{path}/batches/{r['folder']}" for r in records])


def swept(spark: SparkSession, path: str) -> int:
    """Deletes the folders of failed and doubled writes, when no writer is at work; how many there were."""
    kept = {json.loads(r.value)["folder"] for r in spark.read.text(f"{path}/records/*.json").collect()} if committed(spark, path) else set()
    at, fs = _fs(spark, f"{path}/batches")
    found = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName() not in kept] if fs.exists(at) else []
    for f in found:
        fs.delete(f, True)
    return len(found)
