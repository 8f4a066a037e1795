"""First and canonical rows, offsets, re-queueing."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import draw


def first_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def enrich_triples(triples: DataFrame, queries: DataFrame, collection: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """(qid, pos_id, neg_id, line) with texts: the first triple of a query wins, and is dropped if an id dangles.

    Ids are compared as they are; the joins are inner, so that validity is existence.
    """
    one = first_rows(triples, "qid", "line", "pos_id", "neg_id")
    negatives = collection if negatives is None else negatives
    return (one.join(queries.select("qid", "query"), "qid")
            .join(collection.select(F.col("docid").alias("pos_id"), F.col("text").alias("pos_text")), "pos_id")
            .join(negatives.select(F.col("docid").alias("neg_id"), F.col("text").alias("neg_text")), "neg_id")
            .select("qid", "query", "pos_id", "pos_text", "neg_id", "neg_text", "line"))


def enrich_registered(triples: DataFrame, queries: DataFrame, collection: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """enrich_triples() with registries (sources.registries) of queries (qid) and documents (docid): only the triples move."""
    from ..sources.registries import looked_up

    one = first_rows(triples, "qid", "line", "pos_id", "neg_id")
    one = looked_up(one, queries, "qid", "qid", {"query": "query"})
    one = looked_up(one, collection, "docid", "pos_id", {"text": "pos_text"})
    one = looked_up(one, collection if negatives is None else negatives, "docid", "neg_id", {"text": "neg_text"})
    return one.select("qid", "query", "pos_id", "pos_text", "neg_id", "neg_text", "line")


def window_of(enriched: DataFrame, offset: int, limit: int | None, *order: str) -> DataFrame:
    """Rows offset .. offset + limit - 1 in order, over unique and valid queries: windows are disjoint.

    Rows are numbered by ranges; no task sees offset + limit rows.
    """
    rows = numbered(enriched, *(order or ("line",))).where(F.col("rn") >= offset)
    return (rows if limit is None else rows.where(F.col("rn") < offset + limit)).drop("rn")


def flag_repeated(df: DataFrame, group: str, record: str, seed: int) -> DataFrame:
    """is_repeated: false for one record of each group, drawn by the keyed hash."""
    w = Window.partitionBy(group).orderBy(draw(seed, record), record)
    return df.withColumn("is_repeated", F.row_number().over(w) > 1)


def pool(records: DataFrame, roles: list) -> DataFrame:
    """The first text seen of each docid, by (record, role): roles are structs of docid, text, title in their fixed order."""
    rows = records.select("record", F.posexplode(F.array(*roles)).alias("role", "d")).where("d.docid is not null and d.text is not null and d.text <> ''")
    first = F.min(F.struct("record", "role", F.col("d.text").alias("text"), F.col("d.title").alias("title"))).alias("f")
    return rows.groupBy(F.col("d.docid").alias("docid")).agg(first).select("docid", "f.text", "f.title")


#: the roles of a filtered record whose documents make up a split's pool, and those that training searches for negatives
POOL_ROLES = ("rewritten_original_positive", "rewritten_original_negative", "final_positive", "valid_synthetic_negatives")
REGISTRY_ROLES = POOL_ROLES[:2]


def record_pool(records: DataFrame, roles=POOL_ROLES) -> DataFrame:
    """docid, text, title: the first text seen of each id over the roles of filtered records (record: their order)."""
    bare = lambda x: F.struct(x["id"].cast("string").alias("docid"), x["text"].alias("text"), F.coalesce(x["title"], F.lit("")).alias("title"))
    parts = [F.transform(F.coalesce(F.col(r), F.array()), bare) if r.endswith("negatives") else F.array(bare(F.col(r))) for r in roles]
    rows = records.select("record", F.posexplode(F.concat(*parts)).alias("role", "d")).where("d.docid is not null and d.text is not null and d.text <> ''")
    first = F.min(F.struct("record", "role", F.col("d.text").alias("text"), F.col("d.title").alias("title"))).alias("f")
    return rows.groupBy(F.col("d.docid").alias("docid")).agg(first).select("docid", "f.text", "f.title")


def last_wins(rows: DataFrame, key: str, value: str, line: str) -> DataFrame:
    """The value of the last line of each key; equal lines go by the value."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(line, value)).alias(value))


def requeue(deleted: DataFrame, succeeded: DataFrame, lines: DataFrame, key: str = "qid", order=("file", "line")) -> DataFrame:
    """The first line of every deleted key that has no success, over files in order."""
    missing = deleted.select(key).distinct().join(succeeded.select(key), key, "left_anti")
    return first_rows(lines, key, *order).join(missing, key, "left_semi")  # one row a key is joined, and the lines are sorted once


def numbered(df: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """Consecutive numbers from 0 in the given order, without one task that sees all rows.

    Rows are range-partitioned and sorted; the partitions' counts (one number each) give every
    partition its first number.  Ties must be broken by the order's last column.
    """
    from pyspark.sql import types as T

    from ..sources.scratch import written

    at = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = written(at.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    counts = at.groupBy("_p").agg(F.count("*").alias("c"), F.min("_m").alias("_m0")).orderBy("_p").collect()
    total, rows = 0, []
    for r in counts:
        rows.append((r["_p"], total, r["_m0"]))
        total += r["c"]
    kind = T.StructType([T.StructField("_p", T.IntegerType()), T.StructField("_o", T.LongType()), T.StructField("_m0", T.LongType())])
    offsets = df.sparkSession.createDataFrame(rows, kind)
    # one row per partition
    return at.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_m") - F.col("_m0")).drop("_p", "_m", "_o", "_m0")
