"""A corpus pipeline: five operators over the documents table, each stage written and read again.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame.  All stages but the last return the columns of documents, for the rows
that they keep:

* language_id: rejects texts without a letter, and texts of no clear language
  (posterior of the predicted language under LEAST_SCORE); the model is learned from
  the stage's own rows, by the same split as its query;
* jaccard_join: keeps one document of each group of near copies, the row of the least
  id (of several such rows, that of the least row hash);
* substring_dedup: replaces a text by the words it keeps; documents of which nothing
  is left go;
* decontamination: rejects documents that hold a benchmark window;
* bpe: returns one row per document with its token count and the digests of its ids
  and of the decoded text.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe, decontamination, jaccard, langid, substring
from siftline.llm.common import dropped, split_mod, table, written_at

LEAST_SCORE = 0.5

#: no SQL: language identification and BPE are not expressible; tests hold run() against a plain version
ORACLE_SQL = None


def _aside(docs: DataFrame) -> DataFrame:
    """docs with every column but text under a name that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"d_{c}") for c in docs.columns])


def _back(rows: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of docs again, of which new gives some anew."""
    return rows.select(*[new.get(c, F.col(f"`{c}`" if c == "text" else f"`d_{c}`")).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(~split_mod(4, 2)), langid.vocabulary_path())
    rows = langid.predicted(_aside(docs), model)
    return _back(rows.where(f"lang_pred <> 'und' and score >= {LEAST_SCORE}"), docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _aside(docs)
    more = tuple(c for c in rows.columns if c != "text")
    rows = substring.deduplicated(rows.withColumn("doc_id", F.col("d_doc_id")), more=more).where("kept <> ''")
    return _back(rows, docs, text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", benchmark_decontamination),
    ("bpe", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is a Parquet table in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, path = written_at(docs)
            if before:
                dropped(spark, before)  # the stage behind has read it
            before = path
    return docs
