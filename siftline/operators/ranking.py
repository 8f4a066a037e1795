"""Ranking metrics, rank shifts, candidate validation, qrels."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(run: DataFrame, descending_ties: bool = False) -> DataFrame:
    """rank within each query by score, ties by docid, and n, the query's size."""
    tie = F.desc("docid") if descending_ties else F.asc("docid")
    w = Window.partitionBy("qid")
    return run.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), tie)), "n": F.count("*").over(w)})


def _hits(hit: Column, gain: Column, cuts) -> Column:
    """An aggregate of a query's rows: (rank, gain) of its hits within the deepest cut.

    Tasks hand on what they have seen of a query, a cut's length at most, so that a run is neither sorted nor dealt by query for it.
    """
    return F.sort_array(F.collect_list(F.when(hit & (F.col("rank") <= max(cuts)), F.struct("rank", gain.alias("gain"))))).alias("_hits")


def _found(k: int) -> tuple:
    """(number of hits, sum of the precisions at each hit, discounted gain) within the first k, from _hits."""
    within = lambda x, value: F.when(x["rank"] <= k, value).otherwise(F.lit(0.0))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return (add(F.transform("_hits", lambda x: within(x, F.lit(1.0)))), add(F.transform("_hits", lambda x, i: within(x, (i + 1) / x["rank"]))),
            add(F.transform("_hits", lambda x: within(x, x["gain"] / F.log2(x["rank"] + 1.0)))))


def per_query(run: DataFrame, qrels: DataFrame, cuts=(10, 20, 100)) -> DataFrame:
    """qid and ndcg, map, recall, precision at each cut, for the queries that are in both; run has ranks, qrels rel.

    Relevance is rel >= 1, gains are rel, documents without a judgement count 0.
    """
    judged = run.join(qrels.select("qid", "docid", "rel"), ["qid", "docid"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    got = judged.groupBy("qid").agg(_hits(F.col("rel") >= 1, F.col("rel"), cuts))
    w = Window.partitionBy("qid").orderBy(F.desc("rel"), "docid")
    ideal = qrels.withColumn("_r", F.row_number().over(w)).groupBy("qid").agg(
        F.sum((F.col("rel") >= 1).cast("int")).alias("R"),
        *[F.sum(F.when(F.col("_r") <= k, F.greatest("rel", F.lit(0)) / F.log2(F.col("_r") + 1.0)).otherwise(0.0)).alias(f"i{k}") for k in cuts])
    rows = got.join(ideal, "qid")
    zero = lambda num, den: F.when(den > 0, num / den).otherwise(F.lit(0.0))
    out = []
    for k in cuts:
        hits, precisions, gain = _found(k)
        out += [zero(gain, F.col(f"i{k}")).alias(f"ndcg_cut_{k}"), zero(precisions, F.col("R")).alias(f"map_cut_{k}"), zero(hits, F.col("R")).alias(f"recall_{k}"), (hits / F.lit(float(k))).alias(f"P_{k}")]
    return rows.select("qid", *out)


def per_query_by_class(run: DataFrame, classes: DataFrame, cuts=(10, 20, 100)) -> DataFrame:
    """per_query's metrics where the documents of a query's class (id, label) are relevant, but not the query itself.

    The judgements are never written out: a run's row is judged by two labels, and what is ideal follows from the class's size.
    """
    sizes = classes.groupBy("label").agg(F.count("*").alias("_size"))
    of = classes.join(sizes, "label")
    judged = run.join(of.select(F.col("id").alias("qid"), F.col("label").alias("_l"), (F.col("_size") - 1).alias("R")), "qid")
    judged = judged.join(classes.select(F.col("id").alias("docid"), "label"), "docid", "left")
    hit = F.coalesce((F.col("_l") == F.col("label")) & (F.col("docid") != F.col("qid")), F.lit(False))
    rows = judged.groupBy("qid", "R").agg(_hits(hit, F.lit(1.0), cuts)).where("R > 0")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least("R", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    out = []
    for k in cuts:
        hits, precisions, gain = _found(k)
        out += [(gain / ideal(k)).alias(f"ndcg_cut_{k}"), (precisions / F.col("R")).alias(f"map_cut_{k}"), (hits / F.col("R")).alias(f"recall_{k}"), (hits / F.lit(float(k))).alias(f"P_{k}")]
    return rows.select("qid", *out)


def rank_score(old: Column, new: Column) -> Column:
    """Positive where a document fell, negative where it rose, 0 where it stayed."""
    return F.when(old >= new, new / old - 1).otherwise(1 - old / new)


def rank_shift(original: DataFrame, changed: DataFrame, diff: DataFrame) -> DataFrame:
    """qid, docid, old, new, shift of every changed document (qid, docid) of queries in both runs; a missing document ranks n + 1."""
    o, c = ranked(original), ranked(changed)
    size = lambda r, name: r.groupBy("qid").agg(F.count("*").alias(name))
    rows = diff.select("qid", "docid").distinct().join(size(o, "n_old"), "qid").join(size(c, "n_new"), "qid")
    rows = rows.join(o.select("qid", "docid", F.col("rank").alias("old")), ["qid", "docid"], "left").join(c.select("qid", "docid", F.col("rank").alias("new")), ["qid", "docid"], "left")
    rows = rows.withColumns({"old": F.coalesce("old", F.col("n_old") + 1), "new": F.coalesce("new", F.col("n_new") + 1)})
    return rows.select("qid", "docid", "old", "new", rank_score(F.col("old").cast("double"), F.col("new").cast("double")).alias("shift"))


def pmrr(shifts: DataFrame) -> DataFrame:
    """The mean shift of each query's changed documents."""
    return shifts.groupBy("qid").agg(F.avg("shift").alias("p_mrr"))


def pmrr_macro(per: DataFrame) -> DataFrame:
    """The mean over queries; 0 without any."""
    return per.agg(F.coalesce(F.avg("p_mrr"), F.lit(0.0)).alias("p_mrr"), F.count("*").alias("n_queries"))


def topic_table(metrics: DataFrame, shifts: DataFrame, both: bool = True) -> DataFrame:
    """qid, metric columns and p_mrr: topics with both, or all topics with what they have."""
    return metrics.join(shifts, "qid", "inner" if both else "full_outer")


def validate_candidates(run: DataFrame, candidates: DataFrame) -> DataFrame:
    """qid, n_run, n_official, missing, extra, valid: the run's documents against the official set, per query."""
    a = run.select("qid", "docid").distinct().withColumn("r", F.lit(1))
    b = candidates.select("qid", "docid").distinct().withColumn("c", F.lit(1))
    rows = a.join(b, ["qid", "docid"], "full_outer").groupBy("qid").agg(
        F.count("r").alias("n_run"), F.count("c").alias("n_official"), F.count_if(F.col("r").isNull()).alias("missing"), F.count_if(F.col("c").isNull()).alias("extra"))
    return rows.withColumn("valid", (F.col("missing") == 0) & (F.col("extra") == 0))


def merge_qrels(rows: DataFrame) -> DataFrame:
    """One judgement per (qid, docid): the greatest."""
    return rows.groupBy("qid", "docid").agg(F.max("rel").cast("int").alias("rel"))


def derive_qrels(rows: DataFrame) -> DataFrame:
    """Judgements of paired rows (query_id, only_instruction, positives, negatives, new_negatives as arrays of ids).

    Positives are relevant.  A row is instructed if its id ends with -instruct and its instruction is not empty; its
    instruction negatives are judged 0 for it, and 1 for the standard query where that exists and has not judged them.
    """
    instructed = F.col("query_id").endswith("-instruct") & (F.coalesce(F.trim("only_instruction"), F.lit("")) != "")
    pos = rows.select(F.col("query_id").alias("qid"), F.explode("positives").alias("docid"), F.lit(1).alias("rel"))
    neg = rows.where(instructed).select(F.col("query_id").alias("qid"), F.explode("new_negatives").alias("docid"), F.lit(0).alias("rel"))
    base = neg.withColumn("qid", F.regexp_replace("qid", "-instruct$", "")).withColumn("rel", F.lit(1))
    base = base.join(rows.select(F.col("query_id").alias("qid")).distinct(), "qid", "left_semi")
    return merge_qrels(pos.unionByName(neg).unionByName(base))


def should_decrease(qrels: DataFrame) -> DataFrame:
    """(qid, docid): relevant to the standard query, and not to its instructed one, for pairs that exist."""
    on = qrels.where("rel > 0")
    std = on.where(~F.col("qid").endswith("-instruct"))
    ins = on.where(F.col("qid").endswith("-instruct")).withColumn("qid", F.regexp_replace("qid", "-instruct$", ""))
    pairs = qrels.where(F.col("qid").endswith("-instruct")).select(F.regexp_replace("qid", "-instruct$", "").alias("qid")).distinct()
    return std.join(pairs, "qid", "left_semi").select("qid", "docid").join(ins.select("qid", "docid"), ["qid", "docid"], "left_anti")


def trim_corpus(corpus: DataFrame, judged: DataFrame, noise: int, seed: int) -> DataFrame:
    """All judged documents, and at most `noise` of the others by the keyed hash."""
    from ..functions.rng import draw

    ids = judged.select("docid").distinct()
    others = corpus.join(ids, "docid", "left_anti").orderBy(draw(seed, "docid"), "docid").limit(noise)
    return corpus.join(ids, "docid", "left_semi").withColumn("judged", F.lit(True)).unionByName(others.withColumn("judged", F.lit(False)))


def first_queries(queries: DataFrame, qrels: DataFrame, most: int) -> tuple:
    """The first queries by id, and their judgements."""
    kept = queries.orderBy("qid").limit(most)
    return kept, qrels.join(kept.select("qid"), "qid", "left_semi")


def pair_counts(rows: DataFrame) -> DataFrame:
    """n_pairs, n_instructed, n_negatives of paired rows (query_id, only_instruction, new_negatives); see checked_pairs."""
    instructed = F.col("query_id").endswith("-instruct") & (F.coalesce(F.trim("only_instruction"), F.lit("")) != "")
    base = F.regexp_replace("query_id", "-instruct$", "")
    sides = rows.groupBy(base.alias("base")).agg(F.max((~F.col("query_id").endswith("-instruct")).cast("int")).alias("std"), F.max(instructed.cast("int")).alias("ins"),
                                                 F.sum(F.when(instructed, F.size(F.coalesce("new_negatives", F.array()))).otherwise(0)).alias("neg"))
    return sides.agg(F.count_if((F.col("std") == 1) & (F.col("ins") == 1)).alias("n_pairs"), F.count_if(F.col("ins") == 1).alias("n_instructed"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_negatives"))


def checked_pairs(rows: DataFrame) -> DataFrame:
    """rows, or an error if they hold no pair or no instruction negative."""
    counts = pair_counts(rows).first()
    if not counts.n_pairs or not counts.n_negatives:
        raise ValueError(f"{counts.n_pairs} pairs and {counts.n_negatives} instruction negatives")
    return rows
