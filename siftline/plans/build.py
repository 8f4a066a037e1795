"""Queries of the dataset construction: enrichment, dedup, splits, records, negatives, files."""
from pyspark.sql import functions as F

from ..functions.rng import draw
from ..functions.schemas import FILTERED, GENERATED
from ..functions.stem import stem_ctes, stemmed
from ..functions.text import (ENGLISH_STOPWORDS, LENGTHS, LONG_STYLES, RUSSIAN_STOPWORDS, SHORT_STYLES, appended_instruction, chosen_template, filled, generation_params, instructed_query,
                              parse_answer, passage, plain_prefix, prefixed, remapped_role, role_of, tokens)
from ..operators import bm25, dedup, records, sampling, split
from ..sources import commits, external, files, registries
from ..sources.scratch import scratch, spread, written
from .registry import Registry, table, u

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


def _triples(spark, d):
    """lineitem as triples: order, part, supplier; the line number is the order within a query."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("pos_id"), F.col("l_suppkey").alias("neg_id"), F.col("l_linenumber").alias("line"))


def _enriched(spark, d):
    queries = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("query"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("docid"), F.col("p_name").alias("text"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("docid"), F.col("s_name").alias("text"))
    return dedup.enrich_triples(_triples(spark, d), queries, parts, suppliers)


_ENRICHED = """
SELECT t.l_orderkey AS qid, o_orderpriority AS query, t.l_partkey AS pos_id, p_name AS pos_text, t.l_suppkey AS neg_id, s_name AS neg_text, t.l_linenumber AS line
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) t
JOIN orders ON o_orderkey = t.l_orderkey JOIN part ON p_partkey = t.l_partkey JOIN supplier ON s_suppkey = t.l_suppkey WHERE rn = 1
"""


@_R.add("triple_enrich", _ENRICHED)
def triple_enrich(spark, d):
    return _enriched(spark, d)


@_R.add("triple_enrich_registered", _ENRICHED)
def triple_enrich_registered(spark, d):
    """The same rows from registries that lie in buckets by id."""
    queries = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("query"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("docid"), F.col("p_name").alias("text"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("docid"), F.col("s_name").alias("text"))
    return dedup.enrich_registered(_triples(spark, d), *(registries.register(r, k) for r, k in ((queries, "qid"), (parts, "docid"), (suppliers, "docid"))))


@_R.add("dedup_offset_limit", f"SELECT * FROM ({_ENRICHED}) ORDER BY qid LIMIT 500 OFFSET 250")
def dedup_offset_limit(spark, d):
    return dedup.window_of(_enriched(spark, d), 250, 500, "qid")


@_R.add("doc_pool_first_seen", """
WITH r AS (SELECT doc_id AS record, doc_id, text, lang, source, n_chars FROM documents),
roles AS (
  SELECT record, 0 AS role, 'd' || CAST(doc_id AS VARCHAR) AS docid, text, lang AS title FROM r
  UNION ALL SELECT record, 1, 'd' || CAST(doc_id // 2 AS VARCHAR), text, source FROM r
  UNION ALL SELECT record, 2, 's-' || source, text, source FROM r
  UNION ALL SELECT record, 3, 'l-' || lang || CAST(n_chars % 50 AS VARCHAR), text, lang FROM r
)
SELECT docid, md5(text) AS text_md5, title FROM (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY record, role) AS rn FROM roles WHERE text <> '' AND docid IS NOT NULL) WHERE rn = 1
""")
def doc_pool_first_seen(spark, d):
    r = table(spark, d, "documents").withColumn("record", F.col("doc_id"))
    role = lambda docid, title: F.struct(docid.alias("docid"), F.col("text").alias("text"), F.col(title).alias("title"))
    roles = [
        role(F.concat(F.lit("d"), F.col("doc_id").cast("string")), "lang"), role(F.concat(F.lit("d"), F.expr("doc_id div 2").cast("string")), "source"),
        role(F.concat(F.lit("s-"), F.col("source")), "source"), role(F.concat(F.lit("l-"), F.col("lang"), (F.col("n_chars") % 50).cast("string")), "lang"),
    ]
    return dedup.pool(r, roles).select("docid", F.md5("text").alias("text_md5"), "title")


@_R.add("last_wins_load", "SELECT l_orderkey AS id, max_by(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS part FROM lineitem GROUP BY 1")
def last_wins_load(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), "l_linenumber")
    return dedup.last_wins(rows, "id", "part", "l_linenumber")


@_R.add("repeated_flag", f"""
SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY {u(42, 'doc_id')}, doc_id) > 1 AS is_repeated FROM documents
""")
def repeated_flag(spark, d):
    rows = table(spark, d, "documents").withColumn("_key", F.sha2("text", 256))  # groups by a digest, so that texts are not shuffled
    return dedup.flag_repeated(rows.select("doc_id", "_key"), "_key", "doc_id", 42).select("doc_id", "is_repeated")


@_R.add("seeded_split", f"""
SELECT doc_id, CASE WHEN rn <= 50 THEN 'val' WHEN rn <= 150 THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY {u(42, 'doc_id')}, doc_id) AS rn FROM documents)
""")
def seeded_split(spark, d):
    return split.split_ids(table(spark, d, "documents"), "doc_id", 42, 50, 100)


@_R.add("split_sizes", f"""
SELECT split, count(*) AS n, sum(n_chars) AS chars FROM (
  SELECT n_chars, CASE WHEN rn <= 50 THEN 'val' WHEN rn <= 150 THEN 'test' ELSE 'train' END AS split
  FROM (SELECT n_chars, row_number() OVER (ORDER BY {u(42, 'doc_id')}, doc_id) AS rn FROM documents)) GROUP BY 1
""")
def split_sizes(spark, d):
    docs = table(spark, d, "documents")
    at = split.split_ids(docs, "doc_id", 42, 50, 100)
    return docs.select("doc_id", "n_chars").join(at, "doc_id").groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


_MIX = {"en": 60, "de": 30, "fr": 20, "es": 0}


@_R.add("mixture_sample", f"""
WITH d AS (SELECT doc_id, lang, {u(7, 'doc_id')} AS x FROM documents),
a AS (SELECT doc_id, lang, 'first' AS source_name FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY x, doc_id) AS rn FROM d)
      WHERE rn <= CASE lang WHEN 'en' THEN 60 WHEN 'de' THEN 30 WHEN 'fr' THEN 20 ELSE 0 END),
b AS (SELECT doc_id, lang, 'last' AS source_name FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY x DESC, doc_id DESC) AS rn FROM d)
      WHERE rn <= CASE lang WHEN 'en' THEN 10 WHEN 'es' THEN 15 ELSE 0 END)
SELECT doc_id, lang, source_name, {u(9, 'source_name', 'doc_id')} AS shuffle_key FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
""")
def mixture_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    first = split.stratified(docs, "lang", "doc_id", 7, _MIX).withColumn("source_name", F.lit("first"))
    last = split.stratified(docs, "lang", "doc_id", 7, {"en": 10, "es": 15}, from_end=True).withColumn("source_name", F.lit("last"))
    return split.mixture([first, last], "doc_id", 9)


@_R.add("mixture_composition", """
SELECT l.quality, d.lang, count(*) AS n, count_if(l.toxic = 1) AS n_toxic FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2
""")
def mixture_composition(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("quality", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


@_R.add("requeue_missing", """
WITH missing AS (SELECT DISTINCT l_orderkey AS qid FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
SELECT qid, l_suppkey AS file, l_linenumber AS line, l_partkey AS pos_id FROM (
  SELECT l_orderkey AS qid, l_suppkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber, l_partkey) AS rn
  FROM lineitem WHERE l_orderkey IN (SELECT qid FROM missing)) WHERE rn = 1
""")
def requeue_missing(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("pos_id"), "l_returnflag")
    return dedup.requeue(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), rows.drop("l_returnflag"), order=("file", "line", "pos_id"))


@_R.add("std_instruct_rows", f"""
WITH q AS (SELECT CAST(item_id AS VARCHAR) AS qid, CASE WHEN {u(42, 'item_id', '0')} < 0.5 THEN text ELSE 'about ' || text END AS query,
                  CASE WHEN item_id % 5 = 0 THEN '' ELSE 'Only documents in tier ' || CAST(item_id % 5 AS VARCHAR) || '.' END AS instr FROM benchmark)
SELECT qid AS query_id, query, '' AS only_instruction, query AS only_query, false AS has_instruction FROM q
UNION ALL SELECT qid || '-instruct', trim(query || ' ' || instr), instr, query, true FROM q
""")
def std_instruct_rows(spark, d):
    tier = (F.col("item_id") % 5)
    rows = table(spark, d, "benchmark").select(
        F.col("item_id").alias("qid"), F.lit(0).alias("occurrence"), F.col("text").alias("original"), F.concat(F.lit("about "), F.col("text")).alias("rewritten"),
        F.when(tier == 0, "").otherwise(F.concat(F.lit("Only documents in tier "), tier.cast("string"), F.lit("."))).alias("instruction"))
    return records.two_rows(rows, 42)


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@_R.add("generation_parameters", f"""
WITH q AS (SELECT item_id AS query_id, CAST(floor({u(1, 'item_id')} * 4) AS INT) AS t, CAST(floor({u(2, 'item_id')} * 4) AS INT) + 1 AS s FROM benchmark)
SELECT query_id, {_LIST(LENGTHS)}[t + 1] AS length, CASE WHEN t < 2 THEN {_LIST(SHORT_STYLES)}[s] ELSE {_LIST(LONG_STYLES)}[s] END AS style FROM q
""")
def generation_parameters(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), generation_params(draw(1, "item_id"), draw(2, "item_id")).alias("p"))
    return rows.select("query_id", "p.length", "p.style")


def _passages(spark, d):
    """Conversations as passage lists: turns in order, a system turn as a null element, no docid on tool turns."""
    t = table(spark, d, "conversations")
    item = F.struct(F.when(F.col("turn") == 0, F.lit(None)).otherwise(F.col("turn").cast("string")).alias("docid"), "text", F.col("role").alias("title"), F.lit(None).cast("string").alias("explanation"))
    element = F.when(F.col("role") != "system", item)
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", element.alias("p")))).alias("l"))
    return rows.select("conv_id", F.transform("l", lambda x: x["p"]).alias("p"))


_TURNS = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations"


@_R.add("normalize_passages", f"""
WITH t AS ({_TURNS}),
a AS (SELECT conv_id, 'dropping' AS variant, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS pos, CASE WHEN turn = 0 THEN '' ELSE CAST(turn AS VARCHAR) END AS docid, coalesce(text, '') AS text, role AS title FROM t WHERE role <> 'system'),
b AS (SELECT conv_id, 'keeping' AS variant, i - 1 AS pos, CASE WHEN role = 'system' OR turn = 0 THEN '' ELSE CAST(turn AS VARCHAR) END AS docid, CASE WHEN role = 'system' THEN '' ELSE coalesce(text, '') END AS text, CASE WHEN role = 'system' THEN '' ELSE role END AS title FROM t)
SELECT conv_id, variant, CAST(pos AS INT) AS pos, docid, md5(text) AS text_md5, title FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
""")
def normalize_passages(spark, d):
    rows = _passages(spark, d)
    both = rows.select("conv_id", F.inline(F.array(
        F.struct(F.lit("dropping").alias("variant"), records.passages_dropping(F.col("p")).alias("l")), F.struct(F.lit("keeping").alias("variant"), records.passages_keeping(F.col("p")).alias("l")))))
    return both.select("conv_id", "variant", F.posexplode("l").alias("pos", "x")).select("conv_id", "variant", "pos", "x.docid", F.md5("x.text").alias("text_md5"), "x.title")


@_R.add("normalize_raw_records", """
WITH r AS (SELECT * FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
n AS (SELECT doc_id, unnest([0, 1, 2]) AS i FROM r)
SELECT r.doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS rewritten_query, CAST(doc_id + 1 AS VARCHAR) AS positive_id, CAST(r.doc_id AS VARCHAR) || '_' || CAST(i AS VARCHAR) AS negative_id, 'p' || CAST(i AS VARCHAR) AS negative_text
FROM r JOIN n USING (doc_id) WHERE NOT (i = 1 AND toxic = 0)
""")
def normalize_raw_records(spark, d):
    r = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    item = lambda i: F.struct(((F.lit(i) == 1) & (F.col("toxic") == 0)).alias("matches_both"), F.lit("e").alias("error_type"), F.lit("x").alias("explanation"), F.lit("t").alias("title"), F.lit(f"p{i}").alias("passage"))
    schema = spark.createDataFrame([], GENERATED).schema
    empty = lambda f: F.lit(None).cast(schema["instruction_data"].dataType[f].dataType.simpleString()).alias(f)
    names = schema["instruction_data"].dataType.names
    fields = [F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias(f) if f == "rewritten_query" else empty(f) for f in names]
    generated = r.select(
        F.col("doc_id").alias("query_id"), F.col("lang").alias("original_query"), (F.col("doc_id") + 1).alias("original_positive_id"), (F.col("doc_id") + 2).alias("original_negative_id"),
        F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"), F.struct(*fields).alias("instruction_data"), F.struct(F.lit("r").alias("reasoning"), F.array(item(0), item(1), item(2)).alias("documents")).alias("mining_data"))
    out = records.normalised_raw(generated).select("query_id", "rewritten_query", F.col("final_positive.id").alias("positive_id"), F.explode("valid_synthetic_negatives").alias("n"))
    return out.select("query_id", "rewritten_query", "positive_id", F.col("n.id").alias("negative_id"), F.col("n.text").alias("negative_text"))


@_R.add("filter_decision", """
WITH r AS (SELECT d.doc_id, d.n_chars, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
x AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'failed' WHEN quality = 1 OR toxic = 0 THEN 'kept' ELSE 'discarded' END AS decision, quality, n_chars FROM r)
SELECT doc_id AS qid, decision, CASE WHEN decision = 'kept' THEN CASE WHEN quality = 1 THEN 'rewritten_original' ELSE 'synthetic' END END AS source,
  CASE WHEN decision = 'kept' THEN CASE WHEN quality = 1 THEN CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) || '_synth' END END AS positive_id,
  CASE WHEN decision = 'kept' THEN CAST(n_chars % 2 = 0 AS INT) + CAST(n_chars % 3 = 0 AS INT) + CAST(n_chars % 5 = 0 AS INT) ELSE 0 END AS n_kept,
  CASE WHEN decision = 'kept' THEN 3 - CAST(n_chars % 2 = 0 AS INT) - CAST(n_chars % 3 = 0 AS INT) - CAST(n_chars % 5 = 0 AS INT) ELSE 0 END AS n_deleted FROM x
""")
def filter_decision(spark, d):
    r = table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    negative = lambda k: F.struct((F.col("n_chars") % k == 0).alias("violates"), F.lit(k).alias("index"))
    rows = r.select(F.col("doc_id").alias("qid"), (F.col("lang") == "es").alias("failed"), (F.col("quality") == 1).alias("pos_relevant"), (F.col("toxic") == 0).alias("synth_relevant"), F.array(negative(2), negative(3), negative(5)).alias("negatives"))
    return records.decide(rows).select("qid", "decision", "source", "positive_id", F.size("kept_negatives").alias("n_kept"), F.size("deleted_negatives").alias("n_deleted"))


@_R.add("filter_counters", """
SELECT CASE WHEN d.lang = 'es' THEN 'failed' WHEN quality = 1 OR toxic = 0 THEN 'kept' ELSE 'discarded' END AS decision, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1
""")
def filter_counters(spark, d):
    return filter_decision(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


_ANSWER = """CASE doc_id % 6 WHEN 0 THEN text || chr(10) || 'ДА' WHEN 1 THEN 'нет' WHEN 2 THEN 'ДА или НЕТ' WHEN 3 THEN 'возможно'
 WHEN 4 THEN 'Нет, но' || chr(10) || '  да  ' || chr(10) || '   ' ELSE 'да потому что' || chr(10) || text END"""
_BARE = r"regexp_replace(regexp_replace(x, '^[\s\x85\xa0]+', ''), '[\s\x85\xa0]+$', '')"


@_R.add("parse_answers", f"""
WITH a AS (SELECT doc_id, coalesce({_ANSWER}, '') AS t FROM documents),
l AS (SELECT doc_id, t, list_filter(list_transform(string_split_regex(t, '\\r\\n|\\n|\\r'), lambda x: {_BARE}), lambda x: x <> '') AS ls FROM a),
v AS (SELECT doc_id, ls, upper(coalesce(ls[len(ls)], '')) AS last, upper(t) AS whole FROM l),
w AS (SELECT doc_id, ls, CASE WHEN contains(last, 'НЕТ') THEN false WHEN contains(last, 'ДА') THEN true WHEN contains(whole, 'НЕТ') THEN false WHEN contains(whole, 'ДА') THEN true END AS answer FROM v)
SELECT doc_id, answer, md5(array_to_string(ls[1:len(ls) - 1], chr(10))) AS reasoning_md5, CASE WHEN answer IS NULL THEN 'error' ELSE 'ok' END AS status FROM w
""")
def parse_answers(spark, d):
    """Replies of all lengths: whole texts with a verdict behind them or before them, and short ones."""
    t = F.expr("CASE doc_id % 6 WHEN 0 THEN concat(text, '\\n', 'ДА') WHEN 1 THEN 'нет' WHEN 2 THEN 'ДА или НЕТ' WHEN 3 THEN 'возможно' "
               "WHEN 4 THEN concat('Нет, но', '\\n', '  да  ', '\\n', '   ') ELSE concat('да потому что', '\\n', text) END")
    return table(spark, d, "documents").select("doc_id", parse_answer(t).alias("a")).select("doc_id", "a.answer", F.md5("a.reasoning").alias("reasoning_md5"), "a.status")


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')"
_INDEX = f"""
toks AS (SELECT doc_id AS docid, {_TOK} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS (SELECT docid, term, dl, count(*) AS tf FROM (SELECT docid, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL)
"""
_SCORES = f"""
{_INDEX},
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
sc AS (SELECT qid, docid, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
       FROM q JOIN post USING (term) JOIN dfs USING (term), st GROUP BY 1, 2)
"""


def _corpus(spark, d):
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("docid"), "text"))


def _best(spark, d, k=35):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return bm25.best(q, bm25.index(_corpus(spark, d), [q]), k)


@_R.add("bm25_stats", f"WITH {_INDEX} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, round(avg(dl), 6) AS mean_dl FROM post GROUP BY 1")
def bm25_stats(spark, d):
    return bm25.postings(_corpus(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.round(F.avg("dl"), 6).alias("mean_dl"))


@_R.add("bm25_corpus_stats", f"WITH {_INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def bm25_corpus_stats(spark, d):
    return bm25.stats(_corpus(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


@_R.add("bm25_topk", f"WITH {_SCORES} SELECT * FROM (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM sc) WHERE rank <= 35")
def bm25_topk(spark, d):
    return _best(spark, d)


@_R.add("bm25_bounded_topk", ORACLES["bm25_topk"])
def bm25_bounded_topk(spark, d):
    """The same rows by the search that bounds scores by blocks, which small inputs do not need."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return bm25.best(q, bm25.index(_corpus(spark, d), [q]), 35, bounded=0)


@_R.add("bm25_hard_negatives", f"""
WITH {_SCORES}, best AS (SELECT * FROM (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM sc) WHERE rank <= 35),
pos AS (SELECT qid, min(docid) AS positive_id FROM best WHERE rank = 3 GROUP BY 1)
SELECT qid, docid, rank, score FROM (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM best JOIN pos USING (qid) WHERE docid <> positive_id) WHERE rank <= 30
""")
def bm25_hard_negatives(spark, d):
    best = written(_best(spark, d))  # scored and ranked once
    return bm25.hard_negatives(best, best.where("rank = 3").select("qid", F.col("docid").alias("positive_id")))


@_R.add("train_rows_nested", f"""
WITH {_SCORES}, best AS (SELECT * FROM (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM sc) WHERE rank <= 35),
pos AS (SELECT qid, docid AS positive_id FROM best WHERE rank = 1),
neg AS (SELECT * FROM (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM best JOIN pos USING (qid) WHERE docid <> positive_id) WHERE rank <= 30)
SELECT CAST(qid AS VARCHAR) AS query_id, CAST(positive_id AS VARCHAR) AS positive_id, coalesce(count(docid), 0) AS n_negatives, md5(coalesce(string_agg(CAST(docid AS VARCHAR), ',' ORDER BY rank), '')) AS negatives_md5
FROM pos LEFT JOIN neg USING (qid) GROUP BY 1, 2
""")
def train_rows_nested(spark, d):
    best = written(_best(spark, d).withColumns({"qid": F.col("qid").cast("string"), "docid": F.col("docid").cast("string")}))
    rows = best.where("rank = 1").select(F.col("qid").alias("query_id"), F.col("docid").alias("positive_id"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("docid"), "text", F.col("lang").alias("title"))
    out = records.with_hard_negatives(rows, best.select("qid", "docid", "rank"), docs)
    ids = F.transform(F.coalesce("negative_passages", F.array()), lambda p: p["docid"])
    return out.select("query_id", "positive_id", F.size(ids).cast("long").alias("n_negatives"), F.md5(F.array_join(ids, ",")).alias("negatives_md5"))


@_R.add("negative_mix", f"""
WITH e AS (SELECT item_id, item_id % 2 = 0 AS ins, list_transform(range(item_id % 12), lambda i: 'h' || CAST(i AS VARCHAR)) AS hard, list_transform(range(item_id % 6), lambda i: 's' || CAST(i AS VARCHAR)) AS special FROM benchmark),
s AS (SELECT item_id, list(x ORDER BY y, i) AS l FROM (SELECT item_id, x, i, {u(42, 'item_id', "'i'", 'i')} AS y FROM (SELECT item_id, unnest(special) AS x, unnest(range(len(special))) AS i FROM e WHERE ins)) GROUP BY 1),
s3 AS (SELECT item_id, coalesce(l[1:3], []) AS sp FROM e LEFT JOIN s USING (item_id)),
h AS (SELECT item_id, list(x ORDER BY y, i) AS l FROM (SELECT item_id, x, i, {u(42, 'item_id', "'h'", 'i')} AS y FROM (SELECT item_id, unnest(hard) AS x, unnest(range(len(hard))) AS i FROM e)) GROUP BY 1),
m AS (SELECT e.item_id, hard, CASE WHEN ins THEN special ELSE [] END AS special, list_concat(sp, coalesce(l[1:7 - len(sp)], [])) AS n FROM e JOIN s3 USING (item_id) LEFT JOIN h USING (item_id)),
f AS (SELECT item_id, list_concat(n, list_filter(list_concat(hard, special), lambda x: NOT list_contains(n, x))[1:greatest(7 - len(n), 0)]) AS n FROM m)
SELECT CAST(item_id AS VARCHAR) AS query_id, array_to_string(list_concat(n, list_transform(range(greatest(7 - len(n), 0)), lambda i: '')), '|') AS negatives FROM f
""")
def negative_mix(spark, d):
    names = lambda p, k: F.transform(F.slice(F.sequence(F.lit(0), F.lit(20)), 1, k.cast("int")), lambda i: F.concat(F.lit(p), i.cast("string")))
    rows = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), (F.col("item_id") % 2 == 0).alias("has_instruction"), names("h", F.col("item_id") % 12).alias("hard"), names("s", F.col("item_id") % 6).alias("special"))
    return sampling.negative_mix(rows).select("query_id", F.array_join("negatives", "|").alias("negatives"))


@_R.add("collate_groups", """
WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations)
SELECT conv_id AS query_id, CAST(i - 1 AS INT) AS position, md5(text) AS passage_md5 FROM t
""")
def collate_groups(spark, d):
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("l"))
    rows = rows.select("query_id", F.element_at("l", 1).alias("positive"), F.slice("l", 2, F.size("l")).alias("negatives"))
    return sampling.collated(rows).select("query_id", "position", F.md5("passage").alias("passage_md5"))


@_R.add("prefix_format", r"""
WITH p AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url FROM pages),
q AS (SELECT page_id, title, url, CASE page_id % 4 WHEN 0 THEN 'query' WHEN 1 THEN 'document' WHEN 2 THEN 'passage' ELSE 'other' END AS kind FROM p),
r AS (SELECT *, CASE WHEN page_id % 10 = 0 THEN 'passage' ELSE CASE kind WHEN 'query' THEN 'query' WHEN 'document' THEN 'passage' WHEN 'passage' THEN 'passage' END END AS role,
  CASE WHEN title <> '' THEN title || '. ' || url ELSE url END AS t, CASE WHEN title <> '' THEN title || ' ' || url ELSE url END AS bm FROM q)
SELECT page_id, role, bm, CASE role WHEN 'query' THEN trim('query:  ' || trim(t)) WHEN 'passage' THEN trim('passage: ' || trim(t)) ELSE t END AS prefixed FROM r
""")
def prefix_format(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    kind = F.element_at(F.array(*map(F.lit, ("query", "document", "passage", "other"))), (F.col("page_id") % 4).cast("int") + 1)
    role = role_of(F.when(F.col("page_id") % 10 == 0, "passage"), kind)
    return p.select("page_id", role.alias("role"), passage(F.col("title"), F.col("url"), " ").alias("bm"), prefixed(passage(F.col("title"), F.col("url")), role, "query:  ", "passage: ").alias("prefixed"))


@_R.add("sharded_write", """
WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS query_id, lang, md5(coalesce(text, '')) AS text_md5, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS rn, count(*) OVER () AS total FROM documents)
SELECT 'train-' || lpad(CAST(rn // 300 AS VARCHAR), 5, '0') || '-of-' || lpad(CAST(CAST(ceil(total / 300.0) AS INT) AS VARCHAR), 5, '0') || '.parquet' AS file, query_id, lang AS query, text_md5, text_md5 AS negative_md5 FROM n
""")
def sharded_write(spark, d):
    """Training rows in shards of 300, written and read back by the training reader, with the name of each row's file."""
    rows = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("query_id"), F.col("lang").alias("query"), F.array(F.struct(F.lit("1").alias("docid"), "text", F.lit("t").alias("title"))).alias("positive_passages"),
        F.array(F.struct(F.lit("2").alias("docid"), "text", F.lit("t").alias("title"), F.lit("").alias("explanation"))).alias("negative_passages"))
    path = scratch(spark)
    files.write_sharded(records.as_training(rows), path, "train", 300)
    text = lambda c: F.md5(F.coalesce(F.col(c)[0]["text"], F.lit("")))
    return files.training_split(spark, path, "train").select(F.col("_metadata.file_name").alias("file"), "query_id", "query", text("positive_passages").alias("text_md5"), text("negative_passages").alias("negative_md5"))


@_R.add("split_view", "SELECT 'l-' || lang AS split, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1")
def split_view(spark, d):
    """Splits as one table: of the shards of all languages, those of two are opened."""
    path, docs = scratch(spark), table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    for lang in ("de", "en", "es", "fr"):
        files.write_sharded(docs.where(F.col("lang") == lang), path, f"l-{lang}", 100, ("doc_id",))
    rows = files.splits(spark, path, "doc_id bigint, lang string, n_chars bigint").where("split IN ('l-en', 'l-fr')")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@_R.add("parquet_roundtrip", "SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents")
def parquet_roundtrip(spark, d):
    path = scratch(spark)
    files.write_sharded(table(spark, d, "documents"), path, "train", 250, ("doc_id",))
    return spark.read.schema("doc_id bigint, text string, lang string, n_chars bigint").parquet(f"{path}/data/train-*.parquet").select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"))


@_R.add("tsv_roundtrip", r"""
SELECT item_id AS id, trim(regexp_replace(text, '\s+', ' ', 'g')) || ' v2' AS text FROM benchmark WHERE item_id % 2 = 0
UNION ALL SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) FROM benchmark WHERE item_id % 2 = 1
""")
def tsv_roundtrip(spark, d):
    """Ids and texts by way of a TSV file that holds malformed lines and a second line for every even id."""
    path = scratch(spark)
    flat = F.trim(F.regexp_replace("text", "\\s+", " "))
    line = lambda *c: F.concat_ws("\t", *c)
    b = table(spark, d, "benchmark")
    many = F.explode(F.filter(F.array(line(F.col("item_id"), flat), F.lit("no tab"), line(F.lit("x"), flat), F.when(F.col("item_id") % 2 == 0, line(F.col("item_id"), F.concat(flat, F.lit(" v2"))))), lambda x: x.isNotNull())).alias("value")
    files.write_lines(b.orderBy("item_id").select(many), path)
    return files.id_texts(spark, path)


@_R.add("jsonl_roundtrip", """
SELECT doc_id AS query_id, lang AS original_query, source AS rewritten_query, CAST(n_chars AS VARCHAR) AS positive_id FROM documents
""")
def jsonl_roundtrip(spark, d):
    path = f"{scratch(spark)}/records.jsonl"
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("lang").alias("original_query"), F.col("source").alias("rewritten_query"), F.lit("").alias("instruction"),
        F.struct(F.col("n_chars").cast("string").alias("id"), F.lit("").alias("text"), F.lit("").alias("title"), F.lit("rewritten_original").alias("source")).alias("final_positive"))
    files.write_jsonl(rows, path)
    return files.jsonl(spark, path, FILTERED, glob="*.json").select("query_id", "original_query", "rewritten_query", F.col("final_positive.id").alias("positive_id"))


@_R.add("routed_write", """
SELECT CASE WHEN d.lang = 'es' THEN 'failed' WHEN quality = 1 OR toxic = 0 THEN 'kept' ELSE 'discarded' END AS decision, doc_id AS qid FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def routed_write(spark, d):
    path = scratch(spark)
    files.write_routed(filter_decision(spark, d), path)
    return spark.read.schema("qid bigint, decision string").json(path).select("decision", "qid")


@_R.add("real_rows", """
WITH t AS (SELECT conv_id, role, count(*) AS c FROM conversations GROUP BY 1, 2), p AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN c END) AS pos, coalesce(max(CASE WHEN role = 'user' THEN c END), 0) AS neg FROM t GROUP BY 1)
SELECT 'real-' || CAST(conv_id AS VARCHAR) AS query_id, 1 AS n_pos, CAST(neg AS INT) AS n_neg, '' AS only_instruction, false AS is_repeated FROM p WHERE pos > 0
""")
def real_rows(spark, d):
    t = table(spark, d, "conversations").withColumn("p", F.struct(F.col("turn").cast("string").alias("docid"), "text", F.lit("").alias("title")))
    rows = t.groupBy(F.col("conv_id").alias("query_id")).agg(
        F.min("text").alias("query"), F.filter(F.collect_list(F.when(F.col("role") == "assistant", F.col("p"))), lambda x: x.isNotNull()).alias("positive_passages"),
        F.filter(F.collect_list(F.when(F.col("role") == "user", F.col("p"))), lambda x: x.isNotNull()).alias("negative_passages"))
    out = records.as_training(records.real_row(rows, "real"))
    return records.training_feed(out).select("query_id", F.size("positive_passages").alias("n_pos"), F.size("negative_passages").alias("n_neg"), "only_instruction", "is_repeated")


@_R.add("analyzer_tokens", f"""
SELECT doc_id, CAST(len({_TOK}) AS INT) AS n_tokens, CAST(len(list_filter({_TOK}, lambda t: t NOT IN ('the', 'of', 'and'))) AS INT) AS n_content, md5(array_to_string({_TOK}, ' ')) AS tokens_md5 FROM documents
""")
def analyzer_tokens(spark, d):
    t = tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(tokens(F.col("text"), ("the", "of", "and"))).alias("n_content"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@_R.add("prompt_fill", """
SELECT item_id, 'Query: ' || text || chr(10) || 'Tier {x}: ' || CAST(item_id % 5 AS VARCHAR) || '.' AS prompt FROM benchmark
""")
def prompt_fill(spark, d):
    return table(spark, d, "benchmark").select("item_id", filled("Query: {text}\nTier {open}x}: {tier}.", text=F.col("text"), tier=F.col("item_id") % 5, open=F.lit("{")).alias("prompt"))


@_R.add("prepared_queries", """
SELECT item_id, text || ' Find it.' AS causal, text AS encoder, rtrim(text) || ' Find it.' AS appended, 'q: ' || text AS plain, 'document' AS remapped FROM benchmark
""")
def prepared_queries(spark, d):
    q, t = F.lit("query"), F.col("text")
    return table(spark, d, "benchmark").select(
        "item_id", instructed_query(t, "causal_lm", "rumteb", "Find it.").alias("causal"), instructed_query(t, "encoder", "rumteb", "Find it.").alias("encoder"),
        appended_instruction(t, q, "Find it.").alias("appended"), plain_prefix(t, q, "q: ", "p: ").alias("plain"), remapped_role(F.lit("passage"), ["query", "document"]).alias("remapped"))


_STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOPWORDS)
_EVAL_SCORES = _SCORES.replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN lang <> '' THEN lang || ' ' || text ELSE text END AS text FROM documents))").replace(_TOK, f"list_filter({_TOK}, lambda t: t NOT IN ({_STOP}))")


@_R.add("bm25_eval_topk", f"WITH {_EVAL_SCORES} SELECT * FROM (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM sc) WHERE rank <= 100")
def bm25_eval_topk(spark, d):
    """The evaluation's analyzer: title and text, English stop words."""
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("docid"), passage(F.col("lang"), F.col("text"), " ").alias("text"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return bm25.best(q, bm25.index(docs, [q], ENGLISH_STOPWORDS), 100)


@_R.add("limit_per_file", """
SELECT l_suppkey AS file, l_orderkey AS qid FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 100 + l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn > 3 AND rn <= 10
""")
def limit_per_file(spark, d):
    """A resume slice: the rows after the first three of every file, seven of them."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("qid"), F.struct((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("a"), F.col("l_partkey").alias("b")).alias("line"))
    return files.first_of_files(rows, 7, 3).select("file", "qid")


@_R.add("run_export", f"WITH {_SCORES} SELECT 'bm25' AS model, 'bench' AS task, CAST(qid AS VARCHAR) AS qid, CAST(docid AS VARCHAR) AS docid, score FROM (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM sc) WHERE rank <= 35")
def run_export(spark, d):
    path = scratch(spark)
    best = _best(spark, d)
    files.write_run(best.select(F.lit("bm25").alias("model"), F.lit("bench").alias("task"), F.col("qid").cast("string").alias("qid"), F.col("docid").cast("string").alias("docid"), "score"), path)
    return files.read_run(spark, path).select("model", "task", "qid", "docid", "score")


# ---- Russian analysis: texts in Cyrillic letters, stop words, stems

_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувщыуз"
_RU = f"translate(lower(text), '{_LATIN}', '{_CYRILLIC}')"
_RU_STOP = ", ".join(f"'{w}'" for w in RUSSIAN_STOPWORDS)


def _scores_sql(docs: str, queries: str, stop: str = "", stem: bool = False) -> str:
    """Tables sc (qid, docid, score) over docs (docid, text) and queries (qid, text)."""
    tok = _TOK if not stop else f"list_filter({_TOK}, lambda t: t NOT IN ({stop}))"
    stems = f"{stem_ctes('(SELECT unnest(t) AS word FROM toks UNION SELECT unnest(t) FROM asked)')}," if stem else ""
    term, join = ("stem", "JOIN stems USING (word)") if stem else ("word", "")
    return f"""
toks AS MATERIALIZED (SELECT docid, {tok} AS t FROM {docs}), asked AS MATERIALIZED (SELECT qid, {tok} AS t FROM {queries}),
{stems}
st AS MATERIALIZED (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS MATERIALIZED (SELECT docid, {term} AS term, dl, count(*) AS tf FROM (SELECT docid, len(t) AS dl, unnest(t) AS word FROM toks) {join} GROUP BY ALL),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY 1),
q AS MATERIALIZED (SELECT qid, {term} AS term, count(*) AS qtf FROM (SELECT qid, unnest(t) AS word FROM asked) {join} GROUP BY ALL),
sc AS MATERIALIZED (SELECT qid, docid, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN post USING (term) JOIN dfs USING (term), st GROUP BY 1, 2),
best AS MATERIALIZED (SELECT * FROM (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM sc) WHERE rank <= 35)
"""


def _russian(spark, d):
    text = F.expr(_RU).alias("text")
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("docid"), text)
    return docs, table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), text)


_RU_TABLES = f"ru_docs AS (SELECT doc_id AS docid, {_RU} AS text FROM documents), ru_queries AS (SELECT item_id AS qid, {_RU} AS text FROM benchmark)"
_RU_SCORES = f"{_RU_TABLES}, {_scores_sql('ru_docs', 'ru_queries', _RU_STOP, True)}"


@_R.add("stemmed_terms", f"""
WITH words AS (SELECT DISTINCT unnest(regexp_extract_all({_RU}, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM documents), {stem_ctes('words')} SELECT word, stem FROM stems
""")
def stemmed_terms(spark, d):
    """The stem of every word of the texts in Cyrillic letters."""
    words = _russian(spark, d)[0].select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return stemmed(words.withColumn("stem", F.col("word")).withColumnRenamed("word", "own"), "stem").withColumnRenamed("own", "word")


@_R.add("bm25_topk_ru", f"WITH {_RU_SCORES} SELECT * FROM best")
def bm25_topk_ru(spark, d):
    """The mining analyzer: Russian stop words, then stems."""
    docs, q = _russian(spark, d)
    return bm25.best(q, bm25.index(docs, [q], RUSSIAN_STOPWORDS, stem=True), 35)


@_R.add("bm25_hard_negatives_ru", f"""
WITH {_RU_SCORES}, pos AS (SELECT qid, docid AS positive_id FROM best WHERE rank = 1)
SELECT qid, docid, rank, score FROM (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM best JOIN pos USING (qid) WHERE docid <> positive_id) WHERE rank <= 30
""")
def bm25_hard_negatives_ru(spark, d):
    best = written(bm25_topk_ru(spark, d))
    return bm25.hard_negatives(best, best.where("rank = 1").select("qid", F.col("docid").alias("positive_id")))


# ---- filtered records and the rows made of them

_PASSAGE = "STRUCT<docid:STRING, text:STRING, title:STRING>"
_RECORDS = f"""
rec AS (SELECT doc_id, doc_id // 2 AS query_id, lang || ' ' || source AS original_query, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source || ' re' END AS rewritten_query, 'only ' || lang AS instruction,
  'p' || CAST(doc_id % 97 AS VARCHAR) AS pid, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS ptext, lang AS ptitle, 'n' || CAST(doc_id % 31 AS VARCHAR) AS nid, source AS ntext,
  'f' || CAST(doc_id AS VARCHAR) AS fid, text AS ftext, source AS ftitle, lang, source, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY {u(42, 'doc_id')}, doc_id) > 1 AS is_repeated FROM documents),
roles AS (SELECT doc_id AS record, 0 AS role, pid AS docid, ptext AS text, ptitle AS title FROM rec UNION ALL SELECT doc_id, 1, nid, ntext, '' FROM rec
  UNION ALL SELECT doc_id, 2, fid, ftext, ftitle FROM rec UNION ALL SELECT doc_id, 3, CAST(doc_id AS VARCHAR) || '_0', source, lang FROM rec WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 4, CAST(doc_id AS VARCHAR) || '_1', lang, '' FROM rec WHERE doc_id % 3 > 1),
pool AS (SELECT docid, text, title FROM (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY record, role) AS rn FROM roles WHERE text <> '') WHERE rn = 1),
reg AS (SELECT docid, text, title FROM (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY record, role) AS rn FROM roles WHERE text <> '' AND role < 2) WHERE rn = 1)
"""


def _records(spark, d):
    """Filtered records: two of a query, ids that several records share, texts that are empty."""
    doc = lambda i, t, title: F.struct(i.alias("id"), t.alias("text"), title.alias("title"))
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    negatives = F.array(doc(F.concat(i.cast("string"), F.lit("_0")), F.col("source"), F.col("lang")), doc(F.concat(i.cast("string"), F.lit("_1")), F.col("lang"), none))
    rows = table(spark, d, "documents").select(
        F.expr("doc_id div 2").alias("query_id"), i.alias("record"), i.alias("occurrence"), F.concat_ws(" ", "lang", "source").alias("original_query"),
        F.when(i % 4 != 0, F.concat(F.col("source"), F.lit(" re"))).alias("rewritten_query"), F.concat(F.lit("only "), F.col("lang")).alias("instruction"),
        F.struct(name("f", i).alias("id"), F.col("text").alias("text"), F.col("source").alias("title"), F.lit("synthetic").alias("source")).alias("final_positive"),
        F.slice(negatives, 1, (i % 3).cast("int")).alias("valid_synthetic_negatives"),
        doc(name("p", i % 97), F.when(i % 5 == 0, "").otherwise(F.col("text")), F.col("lang")).alias("rewritten_original_positive"),
        doc(name("n", i % 31), F.col("source"), none).alias("rewritten_original_negative"))
    return dedup.flag_repeated(rows, "query_id", "record", 42)


_ROW = """query_id, occurrence, query, pos_id, pos_md5, pos_title, only_instruction, only_query, has_instruction, new_negatives, is_repeated"""
_ROWS = f"""
b AS (SELECT r.*, CASE WHEN {u(42, 'query_id', 'doc_id')} < 0.5 THEN original_query ELSE coalesce(rewritten_query, original_query) END AS q FROM rec r),
rows AS (
  SELECT CAST(query_id AS VARCHAR) AS query_id, doc_id AS occurrence, q AS query, b.pid AS pos_id, md5(coalesce(k.text, ptext)) AS pos_md5, coalesce(k.title, ptitle) AS pos_title, '' AS only_instruction, q AS only_query,
    false AS has_instruction, '' AS new_negatives, is_repeated FROM b LEFT JOIN {{known}} k ON k.docid = b.pid
  UNION ALL SELECT CAST(query_id AS VARCHAR) || '-instruct', doc_id, trim(q || ' ' || instruction), fid, md5(ftext), ftitle, instruction, q, true,
    CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN doc_id || '_0/' || source || '/' || lang ELSE doc_id || '_0/' || source || '/' || lang || '|' || doc_id || '_1/' || lang || '/' END, is_repeated FROM b)
"""


def _flat(rows):
    one = lambda p: F.concat_ws("/", p["docid"], p["text"], p["title"])
    p = F.col("positive_passages")[0]
    return rows.select("query_id", "query", p["docid"].alias("pos_id"), F.md5(p["text"]).alias("pos_md5"), p["title"].alias("pos_title"), "only_instruction", "only_query", "has_instruction",
                       F.array_join(F.transform("new_negatives", one), "|").alias("new_negatives"), "is_repeated", F.size("positive_passages").cast("long").alias("n_pos"),
                       F.array_join(F.transform("negative_passages", lambda x: x["docid"]), ",").alias("negatives"), F.md5(F.array_join(F.transform("negative_passages", one), "|")).alias("negatives_md5"),
                       F.array_join(F.array_distinct(F.transform("new_negatives", lambda x: x["explanation"])), ",").alias("explanations"))


_REST = "1 AS n_pos, {negatives} AS negatives, {md5} AS negatives_md5, CASE WHEN new_negatives = '' THEN '' ELSE 'instruction_negative' END AS explanations"


@_R.add("eval_rows_full", f"WITH {_RECORDS}, {_ROWS.format(known='pool')} SELECT {_ROW.replace('occurrence, ', '')}, {_REST.format(negatives=chr(39) * 2, md5='md5(' + chr(39) * 2 + ')')} FROM rows")
def eval_rows_full(spark, d):
    """Evaluation rows: the pool's text first, the record's own where the pool has none; every column of the training schema."""
    rec = _records(spark, d)
    return _flat(records.training_rows(rec, dedup.record_pool(rec), 42))


@_R.add("train_rows_full", f"""
WITH {_RECORDS}, {_ROWS.format(known='reg')},
asks AS (SELECT rows.query_id || '#' || occurrence AS qid, CASE WHEN has_instruction THEN trim(coalesce(rewritten_query, original_query) || ' ' || instruction) ELSE original_query END AS text FROM rows JOIN rec ON rec.doc_id = rows.occurrence),
{_scores_sql('reg', 'asks')},
neg AS (SELECT * FROM (SELECT r.query_id, r.occurrence, x.docid, row_number() OVER (PARTITION BY r.query_id, r.occurrence ORDER BY x.rank) AS rank FROM best x JOIN rows r ON x.qid = r.query_id || '#' || r.occurrence WHERE x.docid <> r.pos_id) WHERE rank <= 30),
lists AS (SELECT query_id, occurrence, string_agg(docid, ',' ORDER BY rank) AS ids, md5(string_agg(docid || '/' || reg.text || '/' || reg.title, '|' ORDER BY rank)) AS m FROM neg JOIN reg USING (docid) GROUP BY 1, 2)
SELECT {_ROW.replace('occurrence, ', '')}, {_REST.format(negatives="coalesce(ids, '')", md5="coalesce(m, md5(''))")} FROM rows LEFT JOIN lists USING (query_id, occurrence)
""")
def train_rows_full(spark, d):
    """Training rows with hard negatives mined from the two-role registry, one index for both kinds of queries."""
    rec = written(_records(spark, d))
    registry = written(dedup.record_pool(rec, dedup.REGISTRY_ROLES))
    qid, std, ins = F.col("query_id").cast("string"), F.col("original_query"), F.trim(F.concat_ws(" ", F.coalesce("rewritten_query", "original_query"), "instruction"))
    side = lambda q, text, positive: F.struct(q.alias("query_id"), text.alias("text"), positive.alias("positive_id"))
    asked = rec.select("occurrence", F.inline(F.array(side(qid, std, F.col("rewritten_original_positive.id")), side(F.concat(qid, F.lit("-instruct")), ins, F.col("final_positive.id")))))
    asked = written(asked.withColumn("qid", F.concat_ws("#", "query_id", "occurrence")))
    # a text is searched once, however many rows ask it
    texts = written(asked.groupBy("text").agg(F.min("qid").alias("qid")))
    best = written(bm25.best(texts, bm25.index(registry, [texts]), 35))
    asked = asked.join(texts.withColumnRenamed("qid", "first"), "text")
    negatives = records.mined_lists(best, asked.select("first", "query_id", "occurrence", "positive_id"), registry)
    return _flat(records.training_rows(rec, registry, 42, negatives))


@_R.add("split_pools", f"""
WITH {_RECORDS}, dealt AS (SELECT query_id, CASE WHEN rn <= 30 THEN 'val' WHEN rn <= 90 THEN 'test' END AS split FROM (SELECT query_id, row_number() OVER (ORDER BY {u(42, 'query_id')}, query_id) AS rn FROM (SELECT DISTINCT query_id FROM rec))),
x AS (SELECT split, docid, text, title, row_number() OVER (PARTITION BY split, docid ORDER BY record, role) AS rn FROM roles JOIN rec ON doc_id = record JOIN dealt USING (query_id) WHERE split IS NOT NULL AND roles.text <> '')
SELECT split, docid, md5(text) AS text_md5, title FROM x WHERE rn = 1
""")
def split_pools(spark, d):
    """The documents of the validation and the test records, each written as its split's pool and read back."""
    rec, path = _records(spark, d), scratch(spark)
    at = written(split.split_ids(rec, "query_id", 42, 30, 60))
    out = []
    for name in ("val", "test"):
        files.write_pool(dedup.record_pool(rec.join(at.where(F.col("split") == name).select("query_id"), "query_id")), path, name)
        out.append(spark.read.schema("docid string, text string, title string").parquet(f"{path}/{name}_corpus").select(F.lit(name).alias("split"), "docid", F.md5("text").alias("text_md5"), "title"))
    return out[0].unionByName(out[1])


_OUTCOME = """
r AS (SELECT doc_id, lang, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
v AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 3 <> 0 END AS vp, doc_id % 4 < 3 AS has_synth, CASE WHEN doc_id % 4 < 3 THEN 2 ELSE 3 END AS n_neg FROM r),
s AS (SELECT *, CASE WHEN vp THEN 'rewritten' WHEN NOT vp AND has_synth AND doc_id % 2 = 0 THEN 'synthetic' END AS found FROM v),
o AS (SELECT *, CASE WHEN vp IS NULL THEN 'Positive check: no answer' WHEN found IS NOT NULL AND doc_id % 13 = 0 THEN 'Negative check: no answer' END AS error FROM s),
out AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'failed' WHEN found IS NOT NULL THEN 'kept' ELSE 'discarded' END AS status FROM o),
k AS (SELECT *, list_filter(range(n_neg), lambda k: (doc_id + k) % 3 <> 0) AS good, list_filter(range(n_neg), lambda k: (doc_id + k) % 3 = 0) AS bad FROM out)
"""


def _outcome(spark, d):
    """Generated records under a verdict table, some of whose answers are missing."""
    r = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    i = F.col("doc_id")
    item = lambda k: F.struct((i % 4 == k).alias("matches_both"), F.lit("omission").alias("error_type"), F.lit("x").alias("explanation"), F.lit(f"t{k}").alias("title"), F.lit(f"p{k}").alias("passage"))
    given = {"rewritten_query": F.col("source"), "rewritten_pos_doc": F.concat(F.lit("pos "), F.col("lang")), "rewritten_pos_title": F.lit("pt"), "rewritten_neg_doc": F.lit("neg"), "instruction": F.concat(F.lit("only "), F.col("lang"))}
    kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], GENERATED).schema["instruction_data"].dataType}
    fields = [given.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in kinds.items()]
    rows = r.select(i.alias("query_id"), F.col("lang").alias("original_query"), (i + 1).alias("original_positive_id"), (i + 2).alias("original_negative_id"), F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"),
                    F.struct(*fields).alias("instruction_data"), F.struct(F.lit("r").alias("reasoning"), F.array(item(0), item(1), item(2)).alias("documents")).alias("mining_data"))
    verdict = lambda kind, place, answer: F.struct(F.lit(kind).alias("kind"), F.lit(place).alias("place"), answer.alias("answer"), F.lit("why").alias("reasoning"))
    said = F.array(verdict("positive", 0, F.when(i % 11 != 0, i % 3 != 0)), verdict("synthetic", 0, i % 2 == 0),
                   *[verdict("negative", k, F.when((i % 13 != 0) | (F.lit(k) != 1), (i + k) % 3 != 0)) for k in range(3)])
    return records.filtered_records(rows, r.select(i.alias("query_id"), F.inline(said)))


@_R.add("filter_records", f"""
WITH {_OUTCOME}
SELECT doc_id AS query_id, status, error, CASE WHEN status = 'kept' THEN found END AS source, CASE WHEN status = 'kept' THEN CASE WHEN found = 'rewritten' THEN CAST(doc_id + 1 AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) || '_synth' END END AS positive_id,
  CASE WHEN status = 'kept' THEN CASE WHEN found = 'rewritten' THEN 'pos ' || lang ELSE 'p' || CAST(doc_id % 4 AS VARCHAR) END END AS positive_text,
  CASE WHEN status = 'kept' THEN array_to_string(list_transform(good, lambda k: doc_id || '_' || k || ':p' || CASE WHEN doc_id % 4 <= k THEN k + 1 ELSE k END), ',') END AS negatives,
  CASE WHEN status = 'kept' THEN array_to_string(list_transform(bad, lambda k: k || ':omission:p' || CASE WHEN doc_id % 4 <= k THEN k + 1 ELSE k END), ',') ELSE '' END AS deleted,
  CASE WHEN status = 'discarded' THEN CASE WHEN NOT vp AND has_synth THEN 'rewritten,synthetic' ELSE 'rewritten' END END AS checked FROM k
""")
def filter_records(spark, d):
    out = _outcome(spark, d)
    join = lambda c, f: F.array_join(F.transform(c, f), ",")
    return out.select("query_id", "status", "error", "record.final_positive.source", F.col("record.final_positive.id").alias("positive_id"), F.col("record.final_positive.text").alias("positive_text"),
                      join(F.col("record.valid_synthetic_negatives"), lambda x: F.concat_ws(":", x["id"], x["text"])).alias("negatives"),
                      join(F.col("deleted"), lambda x: F.concat_ws(":", x["neg_index"].cast("string"), x["error_type"], x["text"])).alias("deleted"), join(F.col("discarded.checked_positives"), lambda x: x["source"]).alias("checked"))


@_R.add("filter_logs", f"""
WITH {_OUTCOME}
SELECT 'kept' AS log, doc_id AS query_id, source AS rewritten_query, found AS detail FROM k WHERE status = 'kept' UNION ALL SELECT 'deleted_queries', doc_id, source, CAST(vp AS VARCHAR) FROM k WHERE status = 'discarded'
UNION ALL SELECT 'deleted_negatives', doc_id, source, CAST(unnest(bad) AS VARCHAR) FROM k WHERE status = 'kept'
""")
def filter_logs(spark, d):
    """The three logs of a filter run, written and read back."""
    path = scratch(spark)
    files.write_filtered(_outcome(spark, d), path)
    base = "query_id bigint, rewritten_query string"
    kept = files.jsonl(spark, f"{path}/kept", FILTERED, glob="*.json").select(F.lit("kept").alias("log"), "query_id", "rewritten_query", F.col("final_positive.source").alias("detail"))
    gone = files.jsonl(spark, f"{path}/deleted_queries", f"{base}, checked_positives ARRAY<STRUCT<llm_answer:BOOLEAN>>", glob="*.json")
    negs = files.jsonl(spark, f"{path}/deleted_negatives", f"{base}, neg_index INT", glob="*.json")
    return kept.unionByName(gone.select(F.lit("deleted_queries").alias("log"), "query_id", "rewritten_query", F.col("checked_positives")[0]["llm_answer"].cast("string").alias("detail"))).unionByName(
        negs.select(F.lit("deleted_negatives").alias("log"), "query_id", "rewritten_query", F.col("neg_index").cast("string").alias("detail")))


# ---- files of triples, re-queueing, generation

def _triple_files(spark, d):
    """lineitem as files of triples, with malformed lines; the order of lines is that of the keys."""
    path = scratch(spark)
    rows = table(spark, d, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    line = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    files.write_lines(rows.select(F.explode(F.filter(F.array(F.when(F.col("l_linenumber") == 2, F.lit("short\tline")), F.when(F.col("l_linenumber") == 3, F.lit("x\t1\t2")), line), lambda x: x.isNotNull())).alias("value")), path)
    return path


_LINES = "SELECT l_orderkey AS qid, l_partkey AS pos_id, l_suppkey AS neg_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem"


@_R.add("triples_file", f"SELECT qid, pos_id, neg_id FROM ({_LINES}) WHERE rn = 1")
def triples_file(spark, d):
    """The first valid triple of each query, by the order of the lines in the files."""
    return dedup.first_rows(files.triples(spark, _triple_files(spark, d)), "qid", "line").select("qid", "pos_id", "neg_id")


@_R.add("requeued_lines", f"""
WITH missing AS (SELECT DISTINCT l_orderkey AS qid FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
SELECT qid || chr(9) || pos_id || chr(9) || neg_id AS value FROM ({_LINES}) WHERE rn = 1 AND qid IN (SELECT qid FROM missing)
""")
def requeued_lines(spark, d):
    """Raw lines of the queries that were deleted and never succeeded, written to be run again."""
    rows, path = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), "l_returnflag"), scratch(spark)
    files.write_requeued(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), spark, _triple_files(spark, d), path)
    return spark.read.text(path)


def _stub():
    """A client for the registered query: replies that follow from the prompt; a prompt that asks about EXTRA LARGE fails."""
    import json

    def call(prompt):
        kind, _, rest = prompt.partition("|")
        if kind == "one":
            query, pos, neg = rest.split("|")
            if "URGENT" in query:
                raise ValueError("no reply")
            return json.dumps({"rewritten_query": f"r {query}", "rewritten_pos_doc": pos.upper(), "rewritten_pos_title": "pt", "rewritten_neg_doc": neg, "rewritten_neg_title": "nt", "reasoning": "", "instruction": f"only {query}", "relevant_docs": [1], "non_relevant_docs": [2]})
        return json.dumps({"reasoning": "m", "documents": [{"matches_both": i == 0, "error_type": "omission", "explanation": "", "title": f"t{i}", "passage": f"{rest} {i}"} for i in range(2)]})

    return call


@_R.add("generated_records", f"""
SELECT qid AS query_id, query AS original_query, CASE WHEN contains(query, 'URGENT') THEN 'failed' ELSE 'success' END AS status, CASE WHEN contains(query, 'URGENT') THEN 'no reply' END AS error,
  CASE WHEN NOT contains(query, 'URGENT') THEN 'r ' || query END AS rewritten_query, CASE WHEN NOT contains(query, 'URGENT') THEN upper(pos_text) END AS pos_doc,
  CASE WHEN NOT contains(query, 'URGENT') THEN 'r ' || query || '/only ' || query || ' 1' END AS second_passage FROM ({_ENRICHED})
""")
def generated_records(spark, d):
    """Two chained calls a triple, by a stub of the service; failures keep their ids."""
    rows = external.generated_records(_enriched(spark, d), _stub, lambda r: f"one|{r['query']}|{r['pos_text']}|{r['neg_text']}", lambda q, i: f"two|{q}/{i}", attempts=2, least=0.0, most=0.0)
    return rows.select("query_id", "original_query", "status", "error", "instruction_data.rewritten_query", F.col("instruction_data.rewritten_pos_doc").alias("pos_doc"), F.col("mining_data.documents")[1]["passage"].alias("second_passage"))


def _judge():
    def call(prompt):
        return "потому что\n" + ("ДА" if prompt.endswith("en") else "НЕТ" if prompt.endswith("de") else "не знаю")

    return call


@_R.add("relevance_verdicts", """
SELECT doc_id AS record_id, CASE lang WHEN 'en' THEN true WHEN 'de' THEN false END AS answer, CASE WHEN lang IN ('en', 'de') THEN 'ok' ELSE 'error' END AS status FROM documents
""")
def relevance_verdicts(spark, d):
    """A prompt by the kind of passage, a reply of a stub, and the parsed verdict."""
    docs = table(spark, d, "documents")
    prompt = chosen_template({"positive": "Is it relevant? {lang}", "negative": "Does it violate? {lang}"}, F.when(F.col("doc_id") % 2 == 0, "positive").otherwise("negative"), lang=F.col("lang"))
    out = external.verdicts(docs.select(F.col("doc_id").alias("record_id"), prompt.alias("prompt")), _judge)
    return out.select(F.col("record_id").cast("long").alias("record_id"), "answer", "status")


# ---- what training reads

@_R.add("training_examples", """
WITH b AS (SELECT item_id, text, item_id % 3 = 0 AS rep, item_id % 2 = 0 AS ins FROM benchmark)
SELECT CAST(item_id AS VARCHAR) AS query_id, CASE WHEN item_id % 5 = 0 THEN text ELSE trim(text || ' ' || CASE WHEN ins THEN 'only x' ELSE '' END) END AS query, CASE WHEN item_id % 4 = 0 THEN '' ELSE 'T. ' || text END AS positive, ins AS has_instruction FROM b WHERE NOT rep
""")
def training_examples(spark, d):
    """Rows that are not repeated, their query (prebuilt, or the bare query and the instruction) and their first positive."""
    b, i = table(spark, d, "benchmark"), F.col("item_id")
    p = F.struct(i.cast("string").alias("docid"), F.col("text").alias("text"), F.lit("T").alias("title"))
    rows = b.select(i.cast("string").alias("query_id"), F.when(i % 5 == 0, F.col("text")).alias("query"), F.col("text").alias("only_query"), F.when(i % 2 == 0, "only x").otherwise("").alias("only_instruction"),
                    F.when(i % 4 != 0, F.array(p)).alias("positive_passages"), (i % 2 == 0).alias("has_instruction"), (i % 3 == 0).alias("is_repeated"))
    rows = records.training_feed(rows)
    first = F.try_element_at(F.coalesce("positive_passages", F.array()), F.lit(1))
    return rows.select("query_id", sampling.example_query(rows).alias("query"), F.coalesce(passage(first["title"], first["text"]), F.lit("")).alias("positive"), "has_instruction")


@_R.add("instructed_feed", "SELECT CAST(item_id AS VARCHAR) AS query_id FROM benchmark WHERE item_id % 2 = 0")
def instructed_feed(spark, d):
    """Only instructed rows, repeated ones included."""
    i = F.col("item_id")
    rows = table(spark, d, "benchmark").select(i.cast("string").alias("query_id"), (i % 2 == 0).alias("has_instruction"), (i % 3 == 0).alias("is_repeated"))
    return records.training_feed(rows, repeated=True, instructed_only=True).select("query_id")


@_R.add("appended_lines", "SELECT item_id AS query_id, 'é ' || text AS original_query, 2 AS n FROM benchmark")
def appended_lines(spark, d):
    """JSON lines appended in two runs, letters beyond ASCII kept."""
    path = scratch(spark)
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("é "), "text").alias("original_query"))
    for _ in range(2):
        files.write_jsonl(rows, path, mode="append")
    return files.jsonl(spark, path, GENERATED, glob="*.json").groupBy("query_id", "original_query").agg(F.count("*").cast("int").alias("n"))


@_R.add("committed_appends", "SELECT event_id, event_type, 'b' || CAST(event_id % 2 AS VARCHAR) AS batch, 2 AS n_batches, 1 AS n_swept FROM events")
def committed_appends(spark, d):
    """Two batches, the first of which fails in a task and is then appended twice: every row is there once, and nothing of the failure."""
    path, events = scratch(spark), table(spark, d, "events").select("event_id", "event_type")
    of = lambda i: events.where(F.col("event_id") % 2 == i).withColumn("batch", F.lit(f"b{i}"))
    fails = F.when(F.col("event_id") >= 0, F.raise_error(F.lit("a task that fails"))).otherwise(F.col("event_type"))
    try:
        commits.append(of(0).withColumn("event_type", fails), path, "b0")
    except Exception as e:
        if "a task that fails" not in str(e):
            raise
    for i in (0, 0, 1):
        commits.append(of(i), path, f"b{i}")
    n, gone = len(commits.committed(spark, path)), commits.swept(spark, path)
    return commits.read(spark, path, "event_id bigint, event_type string, batch string").withColumns({"n_batches": F.lit(n), "n_swept": F.lit(gone)})
