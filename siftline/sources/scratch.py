"""Tables in the folder that driver and executors share."""
import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, or below a folder of this process in local mode (tests, the bench).

    On a cluster an unset folder is an error: every executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="siftline-"))
        root = f"file://{_OWN[0]}"
    path = f"{root.rstrip('/')}/siftline-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for path in paths:
        _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended before
        pass


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What runs inside deletes its shuffle files when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    return written_at(df)[0]


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The table and its path, for dropped()."""
    path = scratch(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its files give fewer (a small table in one row group).

    Tables with enough splits stay as they are: no shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
