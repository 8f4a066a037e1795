"""BM25 over an inverted index with the greatest weight of every term, and of common terms in every block of documents.

A corpus is cut into tokens once; counts, vocabulary and postings come from that table.  A search for the k best reads the postings
of each query's strongest terms first and completes the scores of the documents that lead by these; the k-th of them is a floor under the
k-th score.  Terms that together cannot lift a document over the floor find no documents: only those that the other terms have found, and
that the greatest weights of their block still let reach the floor, get those terms' weights.
"""
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stemmed
from ..functions.text import tokens
from ..sources.scratch import written

K1, B = 1.5, 0.75
#: documents of a block
BLOCK = 128
#: a search's first terms have up to so many postings for each of the k results, and so many documents for each are completed
FIRST = 50
LEADING = 4
#: the terms that find no documents may add up to this share of the floor: more leaves fewer postings to read, and more documents to look up
SHARE = 0.6
#: postings of all queries from which the bounded search is worth its passes; below, all scores are summed.  The rows are the same.
BOUNDED = 50_000_000
#: what sums in another order may differ by, and rounding to six digits
SLACK = 1e-5


def _words(texts: DataFrame, key: str, stopwords) -> DataFrame:
    """key, term: one row per token of (key, text)."""
    return texts.select(key, F.explode(tokens(F.col("text"), stopwords)).alias("term"))


def _stemmed(rows: DataFrame, stems: DataFrame | None) -> DataFrame:
    """rows with their term replaced by its stem, by a join with the vocabulary."""
    return rows if stems is None else rows.join(stems, "term").drop("term").withColumnRenamed("stem", "term")


@dataclass
class Index:
    """Written tables.  weights: term, docid, block, w; blocks: term, block, df (in the block), most; n and avgdl of all documents."""

    weights: DataFrame
    blocks: DataFrame
    n: int
    avgdl: float
    stopwords: tuple
    stems: DataFrame | None

    def asked(self, queries: DataFrame) -> DataFrame:
        """qid, term, qtf of queries (qid, text) under the index's analyzer."""
        return _stemmed(_words(queries, "qid", self.stopwords), self.stems).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def tokenised(corpus: DataFrame, stopwords=()) -> DataFrame:
    """docid, terms of a corpus (docid, text)."""
    return corpus.select("docid", tokens(F.col("text"), stopwords).alias("terms"))  # no filter on the tokens: it would compute them again below the projection


def postings(corpus: DataFrame, stopwords=()) -> DataFrame:
    """docid, term, tf, dl of a corpus (docid, text)."""
    rows = tokenised(corpus, stopwords).select("docid", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return rows.groupBy("docid", "term", "dl").agg(F.count("*").alias("tf"))


def stats(corpus: DataFrame, stopwords=()) -> DataFrame:
    """One row: the number of documents, and their average length."""
    return corpus.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col("text"), stopwords))).alias("avgdl"))


def index(corpus: DataFrame, queries: list = (), stopwords=(), stem: bool = False, k1: float = K1, b: float = B) -> Index:
    """The index of a corpus.  queries: tables (qid, text) whose terms are all that it needs to hold; none: every term.

    A stemmed index knows the stems of the corpus's and these queries' words only; every word is stemmed once.
    """
    cut = written(tokenised(corpus, stopwords))
    one = cut.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl")).first()
    words = cut.select("docid", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    asked = None
    for q in queries:
        rows = _words(q, "qid", stopwords).select("term")
        asked = rows if asked is None else asked.unionByName(rows)
    asked = None if asked is None else asked.distinct()
    stems = None
    if stem:
        every = words.select("term") if asked is None else words.select("term").unionByName(asked)
        stems = written(stemmed(every.distinct().withColumn("stem", F.col("term")), "stem"))
        held = stems if asked is None else stems.join(stems.join(asked, "term").select("stem").distinct(), "stem", "left_semi")
        words = _stemmed(words, held)  # words of asked stems alone go on
    elif asked is not None:
        words = words.join(asked, "term", "left_semi")
    rows = written(words.groupBy("docid", "term", "dl").agg(F.count("*").alias("tf")))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(one.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(one.avgdl or 1.0)))
    blocks = -(-one.n // BLOCK) or 1
    block = F.pmod(F.xxhash64("docid"), F.lit(blocks))
    weights = written(rows.join(df, "term").select("term", "docid", block.alias("block"), weight.alias("w")).sortWithinPartitions("term"))
    greatest = written(weights.groupBy("term", "block").agg(F.count("*").alias("df"), F.max("w").alias("most")))
    return Index(weights, greatest, one.n, one.avgdl or 0.0, tuple(stopwords), stems)


def term_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def score(queries: DataFrame, at: Index) -> DataFrame:
    """qid, docid, score for all pairs that share a term; repeated query terms count repeatedly.

    Terms are joined by a shuffle unless adaptive execution finds one side small; a very common term is split by its skew handling.
    """
    return at.asked(queries).join(at.weights, "term").groupBy("qid", "docid").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))


def scores(queries: DataFrame, corpus: DataFrame, k1: float = K1, b: float = B, stopwords=(), stem: bool = False) -> DataFrame:
    """score() against an index of the corpus that holds the queries' terms."""
    return score(queries, index(corpus, [queries], stopwords, stem, k1, b))


def best(queries: DataFrame, at: Index, k: int, digits: int = 6, report: dict | None = None, bounded: int = BOUNDED) -> DataFrame:
    """topk(score(queries, at), k), from `bounded` postings on without the scores that cannot be among the k best.

    report, if given, gets `postings` (of all terms of all queries) and `joined` (those that were read, and single lookups at most).
    """
    by_query, before = Window.partitionBy("qid"), Window.unboundedPreceding
    strong, weak, leading = by_query.orderBy(F.desc("most"), "term"), by_query.orderBy("most", F.desc("term")), by_query.orderBy(F.desc("s"))
    terms = at.blocks.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    asked = at.asked(queries).join(terms, "term").withColumn("most", F.col("qtf") * F.col("most"))
    asked = written(asked.withColumn("first", F.coalesce(F.sum("df").over(strong.rowsBetween(before, -1)), F.lit(0)) < FIRST * k))

    if (asked.agg(F.sum("df").alias("n")).first().n or 0) < bounded:
        whole = asked.join(at.weights, "term").groupBy("qid", "docid").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))
        return topk(whole, k, digits)

    def hits(rows, *on):
        """The weights of rows' terms, in all documents or in the rows' own."""
        return rows.join(at.weights.drop(*(c for c in ("block",) if c in rows.columns)), ["term", *on]).select("qid", "docid", "block", (F.col("qtf") * F.col("w")).alias("s"))

    def summed(rows):
        return rows.groupBy("qid", "docid", "block").agg(F.sum("s").alias("s"))

    rest = asked.where("not first").select("qid", "term", "qtf")
    begun = written(summed(hits(asked.where("first").select("qid", "term", "qtf"))))
    leaders = begun.withColumn("n", F.row_number().over(leading)).where(F.col("n") <= LEADING * k).drop("n")
    leaders = summed(leaders.unionByName(hits(leaders.select("qid", "docid", "block").join(rest, "qid"), "docid")))
    kth = leaders.withColumn("n", F.row_number().over(leading)).where(F.col("n") <= k)
    floors = kth.groupBy("qid").agg(F.count("*").alias("n"), F.min("s").alias("floor")).where(F.col("n") == k).select("qid", (F.col("floor") - SLACK).alias("floor"))
    needed = F.col("first") | F.coalesce(F.sum("most").over(weak.rowsBetween(before, 0)) >= SHARE * F.col("floor"), F.lit(True))
    judged = written(asked.join(floors, "qid", "left").withColumn("needed", needed))
    left = judged.where("not needed").select("qid", "term", "qtf")
    bounds = judged.groupBy("qid").agg(F.first("floor").alias("floor"), F.sum(F.when(~F.col("needed"), F.col("most")).otherwise(0.0)).alias("can"))
    found = summed(begun.unionByName(hits(judged.where("needed and not first").select("qid", "term", "qtf"))))
    found = found.join(bounds, "qid").where("floor is null or s + can >= floor").drop("can")
    # what the terms that are left can add in a document's block: nothing, where a term is not in it
    more = found.join(left, "qid", "left").join(at.blocks.select("term", "block", "most"), ["term", "block"], "left")
    can = F.sum(F.coalesce(F.col("qtf") * F.col("most"), F.lit(0.0))).alias("can")
    over = more.groupBy("qid", "docid", "block").agg(F.first("s").alias("s"), F.first("floor").alias("floor"), can).where("floor is null or s + can >= floor").select("qid", "docid", "block", "s")
    over = written(over)
    if report is not None:
        n = judged.agg(F.sum("df").alias("all"), F.sum(F.when(F.col("needed"), F.col("df"))).alias("read")).first()
        lookups = over.join(left, "qid").count() + LEADING * k * rest.count()
        report.update(postings=n["all"] or 0, joined=(n["read"] or 0) + lookups)
    whole = summed(over.unionByName(hits(over.select("qid", "docid", "block").join(left, "qid"), "docid")))
    return topk(whole.select("qid", "docid", F.col("s").alias("score")), k, digits)


def topk(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query by the rounded score, ties by docid; ids only, texts join later."""
    rows = scored.withColumn("score", F.round("score", digits))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "docid")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(best: DataFrame, positives: DataFrame, depth: int = 35, most: int = 30) -> DataFrame:
    """Up to `most` of the best `depth` (topk's rows) of each query without its positive (qid, positive_id), ranked anew."""
    rows = best.where(F.col("rank") <= depth).join(positives, "qid").where("docid <> positive_id")
    w = Window.partitionBy("qid").orderBy("rank")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("qid", "docid", "rank", "score")
