"""Structured Streaming: a resumable filter, and event-time extensions (windows, late data, stateful counts)."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits
from ..sources.files import listed
from ..sources.scratch import scratch


def resumable(source: DataFrame, transform, out: str, checkpoint: str, files_per_batch: int = 1, partitions: int | None = None) -> None:
    """Runs a file-source stream to its end through transform into Parquet.  Started again with the same checkpoint, it reads
    only what has not been committed: the checkpoint and the sink's log make every input count once.  `partitions` caps the
    requests in flight in a batch."""
    rows = transform(source.coalesce(partitions) if partitions else source)
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def capped(source: DataFrame, transform, out: str, checkpoint: str, clock=None) -> None:
    """resumable() with the requests in flight capped anew for every batch, by the schedule of operators.results.concurrency.

    clock() is a UTC time as text; a batch's rows go through as many partitions as the cap of its start allows.
    """
    from datetime import datetime, timezone

    from ..operators.results import concurrency

    now = clock or (lambda: datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))

    def put(batch, number):
        spark = batch.sparkSession
        cap = spark.range(1).select(concurrency(F.lit(now()).cast("timestamp")).alias("cap")).first().cap
        # a batch that is run again after a failure replaces its own folder
        transform(batch.coalesce(cap)).withColumn("cap", F.lit(cap)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def append_new(rows: DataFrame, key: str, path: str) -> None:
    """Appends the rows whose key is not in the table at path; running it again adds nothing."""
    spark = rows.sparkSession
    try:
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").parquet(path)


def appended(source: DataFrame, path: str, checkpoint: str, name: str, transform=lambda rows: rows, kind: str = "parquet") -> None:
    """Runs a stream to its end into committed batches (sources.commits): a batch that is run again after a failure is there once."""
    q = source.writeStream.foreachBatch(lambda rows, number: commits.append(transform(rows), path, f"{name}-{number:012d}", kind) and None)
    q = q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The events table as a stream; ts becomes an instant, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def finished(df: DataFrame, keys: tuple, append: bool = False) -> DataFrame:
    """The result of a stream over the input there is.

    Batches hand on what changed, under their number, and the last version of each key counts; the watermark drops state.  append:
    batches hand on what is final only (session windows have no other way), and what the watermark has not closed is not there.
    """
    spark, out = df.sparkSession, scratch(df.sparkSession)

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # run again after a failure, it replaces itself

    q = df.writeStream.outputMode("append" if append else "update").foreachBatch(put).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if q.lastProgress is None or not listed(spark, out):  # no batch: an empty input
        return spark.createDataFrame([], df.schema)
    rows = spark.read.schema(df.schema.add("batch", "long")).parquet(out)
    if append:
        return rows.drop("batch")
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), "batch").alias("_last")
    return rows.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"_last.{c}") for c in df.columns])


def closed(spark: SparkSession, path: str) -> DataFrame:
    """The events at path with one of a day later, without a user: its watermark closes all windows before it."""
    table = spark.read.parquet(path)
    last, end = table.agg(F.max("ts").alias("ts")).where("ts is not null"), scratch(spark)
    last.select(*[(F.col("ts") + F.expr("interval 1 day")).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema]).write.parquet(end)
    behind = spark.readStream.schema(table.schema).parquet(end).withColumn("ts", F.col("ts").cast("timestamp"))
    return event_stream(spark, path).unionByName(behind)


def windows(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type over tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("w_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("s_start"), "n")
