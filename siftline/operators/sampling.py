"""Training examples: negative mixing, collation, the contrastive loss."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import draw


def sampled(items: Column, n, seed: int, *keys) -> Column:
    """n elements of an array without replacement, by the keyed hash of their position."""
    order = F.array_sort(F.transform(items, lambda x, i: F.struct(draw(seed, *keys, i).alias("u"), i.alias("i"), x.alias("x"))))
    return F.transform(F.slice(order, 1, n), lambda s: s["x"])


def negative_mix(df: DataFrame, total: int = 7, instruction: int = 3, seed: int = 42) -> DataFrame:
    """negatives: up to `instruction` instruction negatives of an instructed row, hard negatives for the rest, then the unsampled in list order
    (hard first), then '' up to `total`.  Columns: query_id, has_instruction, hard, special (arrays of text)."""
    special = F.when(F.col("has_instruction"), F.coalesce("special", F.array())).otherwise(F.slice(F.coalesce("special", F.array()), 1, 0))
    df = df.withColumn("_s", sampled(special, instruction, seed, "query_id", F.lit("i")))
    df = df.withColumn("_h", sampled(F.coalesce("hard", F.array()), F.lit(total) - F.size("_s"), seed, "query_id", F.lit("h")))
    df = df.withColumn("_n", F.concat("_s", "_h"))
    # each kind's rest is what its own sample left, by text
    rest = F.concat(F.filter(F.coalesce("hard", F.array()), lambda x: ~F.array_contains("_h", x)), F.filter(special, lambda x: ~F.array_contains("_s", x)))
    df = df.withColumn("_n", F.concat("_n", F.slice(rest, 1, F.greatest(F.lit(total) - F.size("_n"), F.lit(0)))))
    pad = F.array_repeat(F.lit(""), F.greatest(F.lit(total) - F.size("_n"), F.lit(0)))
    return df.withColumn("negatives", F.concat("_n", pad)).drop("_s", "_h", "_n")


def example_query(df: DataFrame) -> Column:
    """The prebuilt query, or the bare query and the instruction."""
    built = F.trim(F.concat_ws(" ", F.col("only_query"), F.coalesce("only_instruction", F.lit(""))))
    return F.coalesce(F.col("query"), built) if "query" in df.columns else built


def collated(df: DataFrame) -> DataFrame:
    """One row per passage: (query_id, position, passage) of [positive, negatives...], positions from 0."""
    return df.select("query_id", F.posexplode(F.concat(F.array("positive"), F.col("negatives"))).alias("position", "passage"))


def infonce(queries: DataFrame, passages: DataFrame, temperature: float) -> DataFrame:
    """Loss of each batch: cross-entropy of every query's positive against all passages of its batch.

    queries: batch, i, v; passages: batch, i, position, v (position 0 is query i's positive).  A batch is small by construction.
    """
    from ..functions.vector import dot

    pairs = queries.select("batch", "i", F.col("v").alias("qv")).join(passages.select("batch", F.col("i").alias("j"), "position", F.col("v").alias("pv")), "batch")
    s = pairs.select("batch", "i", (dot(F.col("qv"), F.col("pv")) / temperature).alias("s"), ((F.col("i") == F.col("j")) & (F.col("position") == 0)).alias("own"))
    top = F.max("s").over(Window.partitionBy("batch", "i"))
    per = s.withColumn("m", top).groupBy("batch", "i").agg((F.log(F.sum(F.exp(F.col("s") - F.col("m")))) + F.first("m") - F.max(F.when(F.col("own"), F.col("s")))).alias("loss"))
    return per.groupBy("batch").agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))
