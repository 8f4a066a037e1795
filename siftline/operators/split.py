"""Seeded splits, stratified samples and mixtures."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import draw
from .selection import before, bits, equal, thresholds


def split_ids(ids: DataFrame, key: str, seed: int, validation: int, test: int) -> DataFrame:
    """(key, split): the first ids of a seeded shuffle are val, the next test, the rest train.

    Nothing is sorted: two thresholds of the draw are found by counts, and every id is compared with them.
    """
    rows = ids.select(key).distinct()
    at = thresholds(rows, seed, key, [(0, validation), (0, validation + test)])
    upto = lambda t: before(bits(seed, key), F.col(key), t) | equal(bits(seed, key), F.col(key), t)
    return rows.withColumn("split", F.when(upto(at[0]), "val").when(upto(at[1]), "test").otherwise("train"))


def stratified(df: DataFrame, stratum: str, key: str, seed: int, counts: dict, from_end: bool = False) -> DataFrame:
    """counts[stratum] rows of each stratum: the first, or the last, of its seeded shuffle; 0 selects nothing.

    Nothing is sorted, and no stratum meets in one task: see operators.selection.
    """
    own = [(s, n) for s, n in counts.items() if n > 0]
    value, sure, edges = bits(seed, key), F.lit(False), []
    for (s, _), at in zip(own, thresholds(df, seed, key, own, stratum, from_end)):
        here = F.col(stratum).eqNullSafe(F.lit(s))
        edge = equal(value, F.col(key), at)
        sure = sure | (here & (before(value, F.col(key), at, from_end) | (edge if at.take == at.held else F.lit(False))))
        if at.take < at.held:  # rows repeat the last one: as many as are missing
            edges.append(df.where(here & edge).limit(at.take))
    return reduce(lambda a, b: a.unionByName(b), edges, df.where(sure))


def mixture(sources: list, key: str, seed: int) -> DataFrame:
    """The bag union of the sources with a shuffle key; order by it where the order is written out."""
    rows = reduce(lambda a, b: a.unionByName(b), sources)
    return rows.withColumn("shuffle_key", draw(seed, "source_name", key))


def shard_numbers(df: DataFrame, rows_per_shard: int, *order: str) -> DataFrame:
    """shard and shards: row-count shards in order, ceil(n / rows_per_shard) of them; an empty table has none."""
    from .dedup import numbered

    rows = numbered(df, *order)
    total = rows.agg(F.count("*").alias("n"))
    return (rows.crossJoin(F.broadcast(total))  # one row
            .withColumn("shard", F.floor(F.col("rn") / rows_per_shard).cast("long"))
            .withColumn("shards", F.ceil(F.col("n") / rows_per_shard).cast("long")).drop("n", "rn"))
