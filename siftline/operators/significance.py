"""Paired bootstrap intervals and sign-flip tests over per-topic values.

A group's values (the topics of a benchmark) are one array, sent to every task; replicates are rows of a range, spread over the
tasks, and draw from the arrays as matrices.  Nothing is exploded, shuffled or joined by topic.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: replicates of a published analysis
REPLICATES = 100_000
#: a prime; draws are permutations of 0 .. PRIME - 1
PRIME = (1 << 31) - 1
#: draws that a task makes at once
CELLS = 1 << 20


def scrambled(x: np.ndarray) -> np.ndarray:
    """Two rounds of x^5 + c modulo PRIME: whole numbers only, so any engine draws the same.  5 does not divide PRIME - 1."""
    x = x % PRIME
    for c in (1013904223, 1664525):
        square = x * x % PRIME
        x = (square * square % PRIME * x + c) % PRIME
    return x


def draws(seed: int, reps: np.ndarray, n: int) -> np.ndarray:
    """Whole numbers of 0 .. PRIME - 1: a row a replicate, a column a draw."""
    return scrambled(seed * 104_729 + reps.astype(np.int64)[:, None] * 1_000_003 + np.arange(n, dtype=np.int64) * 7_919 + 12_345)


def drawn(x: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """As many values as there are, with replacement."""
    return x[draws(seed, reps, len(x)) * len(x) // PRIME]


def flipped(x: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """The values (of each replicate) under signs of its own."""
    return np.where(2 * draws(seed, reps, x.shape[-1]) < PRIME, -x, x)


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, topic, a, b, diff) of topics that both models have for that metric: rows (metric, topic, value)."""
    return (a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), ["metric", "topic"])
            .withColumn("diff", F.col("a") - F.col("b")))


def _means(values: DataFrame, replicates: int, group: str, value: str, **ways) -> DataFrame:
    """group, rep and a mean by each way (array, replicates) -> matrix: one row a group and replicate."""
    spark = values.sparkSession
    rows = values.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("topic", F.col(value).alias("x")))), lambda s: s["x"]).alias("x"))
    # a benchmark's topics, by metric: a number for each, which every replicate draws from
    shared = spark.sparkContext.broadcast({r[group]: np.array(r["x"], np.float64) for r in rows.collect()})

    def run(batches):
        for batch in batches:
            reps = batch.column(0).to_numpy()
            for name, x in shared.value.items():
                step = max(1, CELLS // len(x))
                for i in range(0, len(reps), step):
                    part = reps[i : i + step]
                    means = [pa.array(way(x, part).mean(axis=1)) for way in ways.values()]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part), *means], [group, "rep", *ways])

    return spark.range(replicates).mapInArrow(run, f"{group} string, rep long, " + ", ".join(f"{w} double" for w in ways))


def bootstrap_means(values: DataFrame, replicates: int, seed: int, group: str = "metric", value: str = "diff") -> DataFrame:
    """(group, rep, mean): each replicate draws as many topics as there are, with replacement."""
    return _means(values, replicates, group, value, mean=lambda x, reps: drawn(x, reps, seed))


def interval(means: DataFrame, group: str = "metric") -> DataFrame:
    q = means.groupBy(group).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select(group, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def flip_means(values: DataFrame, replicates: int, seed: int, group: str = "metric", value: str = "diff") -> DataFrame:
    return _means(values, replicates, group, value, mean=lambda x, reps: flipped(np.broadcast_to(x, (len(reps), len(x))), reps, seed))


def p_values(observed: DataFrame, null: DataFrame, replicates: int, group: str = "metric", slack: float = 1e-15) -> DataFrame:
    """p = (1 + #{|null| >= |observed| - slack}) / (replicates + 1); slack 0 is the plain comparison."""
    # one row a group is broadcast
    hits = null.join(F.broadcast(observed.select(group, F.col("mean").alias("obs"))), group).groupBy(group).agg(F.count_if(F.abs("mean") >= F.abs("obs") - slack).alias("extreme"))
    return hits.select(group, "extreme", ((1 + F.col("extreme")) / F.lit(replicates + 1.0)).alias("p"))


def report(values: DataFrame, replicates: int = REPLICATES, seed: int = 20260715, slack: float = 1e-15) -> DataFrame:
    """metric, n, mean_a, mean_b, mean (of the differences), low, high, extreme, p, topics of paired rows."""
    base = values.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("diff").alias("mean"), F.sort_array(F.collect_list("topic")).alias("topics"))
    low = interval(bootstrap_means(values, replicates, seed))
    p = p_values(base, flip_means(values, replicates, seed + 1), replicates, slack=slack)
    return base.join(low, "metric").join(p, "metric")


def scaled(stats: DataFrame, columns=("mean_a", "mean_b", "mean", "low", "high"), factor: float = 100.0) -> DataFrame:
    """p_mrr's figures times 100, as they are reported."""
    by = F.when(F.col("metric") == "p_mrr", F.lit(factor)).otherwise(F.lit(1.0))
    return stats.withColumns({c: F.col(c) * by for c in columns if c in stats.columns})


def single(values: DataFrame, replicates: int = REPLICATES, seed: int = 20260715) -> DataFrame:
    """One model's interval against zero: metric, n, mean, low, high, extreme, p of rows (metric, topic, value)."""
    rows = values.withColumns({"a": F.col("value"), "b": F.lit(0.0), "diff": F.col("value")}).drop("value")
    return report(rows, replicates, seed).drop("mean_a", "mean_b", "topics")


def macro(values: DataFrame, replicates: int, seed: int, slack: float = 0.0) -> DataFrame:
    """The mean over tasks of per-task means (rows task, topic, diff): interval, and a sign-flip p over the resampled differences.

    The signs are applied to an already resampled difference, as an option of its own.
    """
    both = _means(values, replicates, "task", "diff", mean=lambda x, reps: drawn(x, reps, seed), null=lambda x, reps: flipped(drawn(x, reps, seed + 1), reps, seed + 2))
    both = both.groupBy("rep").agg(F.avg("mean").alias("mean"), F.avg("null").alias("null"))
    obs = values.groupBy("task").agg(F.avg("diff").alias("m")).agg(F.avg("m").alias("observed"), F.count("*").alias("n_tasks"))
    # one row is broadcast
    out = both.crossJoin(F.broadcast(obs)).groupBy("n_tasks", "observed").agg(
        F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count_if(F.abs("null") >= F.abs("observed") - slack).alias("extreme"))
    return out.select("n_tasks", "observed", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), ((1 + F.col("extreme")) / F.lit(replicates + 1.0)).alias("p"))
