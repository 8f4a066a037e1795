"""Registries of texts by id, written once in buckets, so that a join moves the asked ids to them and never the texts.

A registry is a table of the session's catalog, kept in the folder that all executors share.  Its buckets are joined where they lie: Spark
deals the other side into as many partitions.  Where the asked ids are few, a Bloom filter is not needed: adaptive execution broadcasts them.
"""
import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import scratch

#: rows of a bucket
BUCKET_ROWS = 1_000_000


def register(rows: DataFrame, key: str, buckets: int | None = None, name: str | None = None) -> DataFrame:
    """rows as a table of the catalog, bucketed and sorted by key; dropped with the session, as are all scratch tables.

    buckets: by default as many as a shuffle has, or more for BUCKET_ROWS rows each: fewer would be dealt anew for a wider shuffle.
    """
    spark = rows.sparkSession
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))
    table = name or f"siftline_{uuid.uuid4().hex}"
    # one file a bucket
    rows.repartition(n, key).write.mode("overwrite" if name else "error").option("path", scratch(spark)).bucketBy(n, key).sortBy(key).saveAsTable(table)
    atexit.register(_drop, spark, table)
    return spark.table(table)


def _drop(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"drop table if exists {table}")
    except Exception:  # the session has ended before
        pass


def looked_up(asked: DataFrame, registry: DataFrame, key: str, on: str, columns: dict) -> DataFrame:
    """asked with columns of the registry's row whose key is asked's `on`, under new names; rows without one go.

    The registry is told not to be broadcast: however few its buckets are, it is the side that stays.
    """
    side = registry.select(F.col(key).alias("_key"), *[F.col(c).alias(new) for c, new in columns.items()])
    return asked.join(side.hint("merge"), asked[on] == side["_key"]).drop("_key")
