"""Queries of the evaluation: dense runs, metrics, rank shifts, candidates, qrels, significance."""
from pyspark.sql import functions as F

from ..functions.rng import draw
from ..functions.vector import dot, last_token, norm, normalised, with_end
from ..operators import dense, ranking, records, sampling, significance
from ..sources import files, retrieval
from ..sources.scratch import scratch, written
from .registry import Registry, table, u

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("docid"), F.col("embedding").alias("v"), "label")


def _run(spark, d, k, dims=None):
    v = _vectors(spark, d)
    return dense.topk(v.select("qid", "v"), v.select("docid", "v"), k, dims)


def _classes(spark, d):
    """Vectors of the same label are relevant to each other."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")


def _run_sql(name: str, k: int, dims: int = 64) -> str:
    return f"""
e{name} AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE))[1:{dims}] AS v FROM embeddings),
{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM (
  SELECT a.vec_id AS qid, b.vec_id AS docid, round(list_dot_product(a.v, b.v), 6) AS score FROM e{name} a, e{name} b WHERE a.vec_id <> b.vec_id)) WHERE rank <= {k})
"""


_CUTS = (10, 20, 100)


def _metrics_sql(run: str, name: str, cuts=_CUTS) -> str:
    got = ", ".join(
        f"sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) AS h{k}, sum(CASE WHEN rank <= {k} AND rel = 1 THEN hits / rank ELSE 0.0 END) AS a{k}, sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1.0) ELSE 0.0 END) AS d{k}" for k in cuts)
    ideal = ", ".join(f"(SELECT coalesce(sum(1 / log2(i + 1.0)), 0.0) FROM range(1, least(R, {k}) + 1) t(i)) AS i{k}" for k in cuts)
    out = ", ".join(f"CASE WHEN i{k} > 0 THEN d{k} / i{k} ELSE 0.0 END AS ndcg_cut_{k}, CASE WHEN R > 0 THEN a{k} / R ELSE 0.0 END AS map_cut_{k}, CASE WHEN R > 0 THEN h{k} / R ELSE 0.0 END AS recall_{k}, h{k} / {k}.0 AS P_{k}" for k in cuts)
    return f"""
{name}j AS (SELECT r.qid, r.rank, CASE WHEN x.label = y.label THEN 1 ELSE 0 END AS rel FROM {run} r JOIN embeddings x ON x.vec_id = r.qid JOIN embeddings y ON y.vec_id = r.docid),
{name}h AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM {name}j),
{name}g AS (SELECT qid, {got} FROM {name}h GROUP BY 1),
{name}r AS (SELECT a.vec_id AS qid, count(*) AS R FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1),
{name}i AS (SELECT qid, R, {ideal} FROM {name}r),
{name} AS MATERIALIZED (SELECT qid, {out} FROM {name}g JOIN {name}i USING (qid))
"""


@_R.add("dense_topk", f"WITH {_run_sql('run', 10)} SELECT * FROM run")
def dense_topk(spark, d):
    return _run(spark, d, 10)


@_R.add("dense_topk_indexed", ORACLES["dense_topk"])
def dense_topk_indexed(spark, d):
    """The same rows from groups around pivots, of which those are passed over that cannot hold a query's best."""
    v = _vectors(spark, d)
    return dense.search(v.select("qid", "v"), dense.index(v.select("docid", "v")), 10)


def _mean(spark, d, metric, k):
    per = ranking.per_query_by_class(_run(spark, d, k), _classes(spark, d), (k,))
    return per.agg(F.round(F.avg(metric), 6).alias(metric), F.count("*").alias("n_queries"))


@_R.add("ndcg_at_k", f"WITH {_run_sql('run', 10)}, {_metrics_sql('run', 'm', (10,))} SELECT round(avg(ndcg_cut_10), 6) AS ndcg_cut_10, count(*) AS n_queries FROM m")
def ndcg_at_k(spark, d):
    return _mean(spark, d, "ndcg_cut_10", 10)


@_R.add("map_at_k", f"WITH {_run_sql('run', 100)}, {_metrics_sql('run', 'm', (100,))} SELECT round(avg(map_cut_100), 6) AS map_cut_100, count(*) AS n_queries FROM m")
def map_at_k(spark, d):
    return _mean(spark, d, "map_cut_100", 100)


@_R.add("recall_precision", f"WITH {_run_sql('run', 100)}, {_metrics_sql('run', 'm')} SELECT qid, " + ", ".join(f"round({m}_{k}, 6) AS {m}_{k}" for k in _CUTS for m in ("recall", "P", "ndcg_cut", "map_cut")) + " FROM m")
def recall_precision(spark, d):
    per = ranking.per_query_by_class(_run(spark, d, 100), _classes(spark, d), _CUTS)
    return per.select("qid", *[F.round(f"{m}_{k}", 6).alias(f"{m}_{k}") for k in _CUTS for m in ("recall", "P", "ndcg_cut", "map_cut")])


_RANKED = f"""{_run_sql('og', 50)}, {_run_sql('ch', 50, 32)},
diff AS (SELECT qid, docid FROM og WHERE rank <= 5)"""
_SHIFTS = f"""{_RANKED},
sh AS (SELECT d.qid, d.docid, coalesce(o.rank, 51) AS old, coalesce(c.rank, 51) AS new FROM diff d LEFT JOIN og o USING (qid, docid) LEFT JOIN ch c USING (qid, docid)),
sc AS (SELECT qid, docid, old, new, CASE WHEN old >= new THEN new / old - 1 ELSE 1 - old / new END AS shift FROM (SELECT qid, docid, CAST(old AS DOUBLE) AS old, CAST(new AS DOUBLE) AS new FROM sh))
"""


def _original(spark, d):
    """The run over all dimensions, searched once and read several times."""
    return written(_run(spark, d, 50).select("qid", "docid", "score", "rank"))


def _shifts(spark, d, og=None):
    """The run over all dimensions against the run over the first half; the best five of the former have changed."""
    og = _original(spark, d) if og is None else og
    ch = written(_run(spark, d, 50, 32).select("qid", "docid", "score"))
    return ranking.rank_shift(og.drop("rank"), ch, og.where("rank <= 5").select("qid", "docid"))


@_R.add("rank_in_run", f"WITH {_run_sql('ch', 50, 32)} SELECT qid, docid, score, rank, count(*) OVER (PARTITION BY qid) AS n FROM ch")
def rank_in_run(spark, d):
    return ranking.ranked(_run(spark, d, 50, 32).select("qid", "docid", "score"))


@_R.add("rank_shifts", f"WITH {_SHIFTS} SELECT qid, docid, CAST(old AS BIGINT) AS old, CAST(new AS BIGINT) AS new, round(shift, 6) AS shift FROM sc")
def rank_shifts(spark, d):
    return _shifts(spark, d).select("qid", "docid", F.col("old").cast("long").alias("old"), F.col("new").cast("long").alias("new"), F.round("shift", 6).alias("shift"))


@_R.add("pmrr_per_query", f"WITH {_SHIFTS} SELECT qid, round(avg(shift), 6) AS p_mrr FROM sc GROUP BY 1")
def pmrr_per_query(spark, d):
    return ranking.pmrr(_shifts(spark, d)).select("qid", F.round("p_mrr", 6).alias("p_mrr"))


@_R.add("pmrr_macro", f"WITH {_SHIFTS} SELECT round(avg(p), 6) AS p_mrr, count(*) AS n_queries FROM (SELECT qid, avg(shift) AS p FROM sc GROUP BY 1)")
def pmrr_macro(spark, d):
    return ranking.pmrr_macro(ranking.pmrr(_shifts(spark, d))).select(F.round("p_mrr", 6).alias("p_mrr"), "n_queries")


@_R.add("topic_table", f"WITH {_SHIFTS}, {_metrics_sql('og', 'm', (20,))}, p AS (SELECT qid, avg(shift) AS p_mrr FROM sc WHERE old <> new GROUP BY 1) SELECT qid, round(ndcg_cut_20, 6) AS ndcg_cut_20, round(p_mrr, 6) AS p_mrr FROM m LEFT JOIN p USING (qid)")
def topic_table(spark, d):
    """All topics with the mean shift of the documents that moved, for those that have any."""
    og = _original(spark, d)
    per = ranking.per_query_by_class(og, _classes(spark, d), (20,)).select("qid", "ndcg_cut_20")
    shifts = ranking.pmrr(_shifts(spark, d, og).where("old <> new"))
    return ranking.topic_table(per, shifts, both=False).select("qid", F.round("ndcg_cut_20", 6).alias("ndcg_cut_20"), F.round("p_mrr", 6).alias("p_mrr"))


@_R.add("candidate_validation", f"""
WITH {_run_sql('og', 20)}, r AS (SELECT qid, docid FROM og WHERE {u(5, 'qid', 'docid')} >= 0.02 UNION SELECT DISTINCT qid, qid FROM og WHERE {u(6, 'qid')} < 0.1),
x AS (SELECT coalesce(r.qid, o.qid) AS qid, r.docid AS a, o.docid AS b FROM r FULL JOIN og o ON r.qid = o.qid AND r.docid = o.docid)
SELECT qid, count(a) AS n_run, count(b) AS n_official, count_if(a IS NULL) AS missing, count_if(b IS NULL) AS extra, count_if(a IS NULL) = 0 AND count_if(b IS NULL) = 0 AS valid FROM x GROUP BY 1
""")
def candidate_validation(spark, d):
    og = written(_run(spark, d, 20).select("qid", "docid"))
    run = og.where(draw(5, "qid", "docid") >= 0.02).unionByName(og.select("qid").distinct().where(draw(6, "qid") < 0.1).withColumn("docid", F.col("qid")))
    return ranking.validate_candidates(run, og)


@_R.add("qrels_merge", """
SELECT CAST(doc_id % 37 AS VARCHAR) AS qid, CAST(doc_id // 3 AS VARCHAR) AS docid, max(quality) AS rel FROM labels GROUP BY 1, 2
""")
def qrels_merge(spark, d):
    rows = table(spark, d, "labels").select((F.col("doc_id") % 37).cast("string").alias("qid"), F.expr("doc_id div 3").cast("string").alias("docid"), F.col("quality").alias("rel"))
    return ranking.merge_qrels(rows)


_PAIRED = """
rows AS (SELECT CAST(item_id AS VARCHAR) AS query_id, '' AS ins, [item_id, item_id + 1, item_id + 2] AS pos, [] AS neg FROM benchmark
  UNION ALL SELECT CAST(item_id AS VARCHAR) || '-instruct', CASE WHEN item_id % 4 = 0 THEN ' ' ELSE 'only x' END, [item_id, item_id + 1], [item_id + 5, item_id + 2] FROM benchmark),
pos AS (SELECT query_id AS qid, unnest(pos) AS docid, 1 AS rel FROM rows), neg AS (SELECT query_id AS qid, unnest(neg) AS docid, 0 AS rel FROM rows WHERE query_id LIKE '%-instruct' AND trim(ins) <> ''),
base AS (SELECT replace(qid, '-instruct', '') AS qid, docid, 1 AS rel FROM neg),
qr AS (SELECT qid, CAST(docid AS VARCHAR) AS docid, max(rel) AS rel FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg UNION ALL SELECT * FROM base) GROUP BY 1, 2)
"""


def _derived(spark, d):
    b = table(spark, d, "benchmark")
    i = F.col("item_id")
    ids = lambda *ks: F.array(*[(i + k).cast("string") for k in ks])
    none = F.slice(ids(0), 1, 0)
    rows = b.select(F.inline(F.array(
        F.struct(i.cast("string").alias("query_id"), F.lit("").alias("only_instruction"), ids(0, 1, 2).alias("positives"), none.alias("new_negatives")),
        F.struct(F.concat(i.cast("string"), F.lit("-instruct")).alias("query_id"), F.when(i % 4 == 0, " ").otherwise("only x").alias("only_instruction"), ids(0, 1).alias("positives"), ids(5, 2).alias("new_negatives")))))
    return ranking.derive_qrels(rows)


@_R.add("paired_qrels", f"WITH {_PAIRED} SELECT * FROM qr")
def paired_qrels(spark, d):
    return _derived(spark, d)


@_R.add("should_decrease", f"""
WITH {_PAIRED}, s AS (SELECT qid, docid FROM qr WHERE rel > 0 AND qid NOT LIKE '%-instruct') SELECT * FROM s EXCEPT SELECT replace(qid, '-instruct', ''), docid FROM qr WHERE rel > 0 AND qid LIKE '%-instruct'
""")
def should_decrease(spark, d):
    return ranking.should_decrease(_derived(spark, d))


@_R.add("corpus_trim", f"""
WITH j AS (SELECT DISTINCT doc_id FROM labels), o AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM j) ORDER BY {u(3, 'doc_id')}, doc_id LIMIT 500)
SELECT doc_id AS docid, true AS judged FROM documents WHERE doc_id IN (SELECT doc_id FROM j) UNION ALL SELECT doc_id, false FROM o
""")
def corpus_trim(spark, d):
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("docid"))
    return ranking.trim_corpus(corpus, table(spark, d, "labels").select(F.col("doc_id").alias("docid")), 500, 3)


_B = significance.REPLICATES
# topics are the labels: a topic's value is the mean over its queries
_VALUES = f"""{_run_sql('og', 20)}, {_run_sql('ch', 20, 32)}, {_metrics_sql('og', 'ma', (20,))}, {_metrics_sql('ch', 'mb', (20,))},
diff5 AS MATERIALIZED (SELECT qid, docid FROM og WHERE rank <= 5),
shifts AS MATERIALIZED (SELECT label AS topic, avg(CASE WHEN old >= new THEN new / old - 1 ELSE 1 - old / new END) AS p FROM (
  SELECT label, CAST(coalesce(o.rank, 21) AS DOUBLE) AS old, CAST(coalesce(c.rank, 21) AS DOUBLE) AS new FROM diff5 f LEFT JOIN og o USING (qid, docid) LEFT JOIN ch c USING (qid, docid) JOIN embeddings e ON e.vec_id = f.qid) GROUP BY 1),
v AS MATERIALIZED (SELECT metric, topic, avg(a) AS a, avg(b) AS b, avg(a) - avg(b) AS diff FROM (
  SELECT 'ndcg' AS metric, label AS topic, ma.ndcg_cut_20 AS a, mb.ndcg_cut_20 AS b FROM ma JOIN mb USING (qid) JOIN embeddings ON vec_id = qid
  UNION ALL SELECT 'map', label, ma.map_cut_20, mb.map_cut_20 FROM ma JOIN mb USING (qid) JOIN embeddings ON vec_id = qid WHERE ma.map_cut_20 > 0 AND mb.map_cut_20 > 0) GROUP BY 1, 2),
arr AS MATERIALIZED (SELECT metric, list(diff ORDER BY topic) AS x, count(*) AS n FROM v GROUP BY 1),
rep AS MATERIALIZED (SELECT unnest(range({_B})) AS rep)
"""


def _sql_draw(seed: int, i: str) -> str:
    """The keyed draw of operators.significance in SQL."""
    p = significance.PRIME
    v = f"((CAST({seed} AS BIGINT) * 104729 + rep * 1000003 + {i} * 7919 + 12345) % {p})"
    for c in (1013904223, 1664525):
        v = f"list_transform([list_transform([{v}], lambda v: [v, v * v % {p}])[1]], lambda w: (w[2] * w[2] % {p} * w[1] + {c}) % {p})[1]"
    return v


def _sql_means(seed: int, value: str) -> str:
    """metric, rep, mean of drawn values; {u} in value is the draw, {i} the place."""
    return f"SELECT metric, rep, list_sum(list_transform(range(n), lambda i: {value})) / n AS mean FROM arr, rep".replace("{u}", _sql_draw(seed, "i"))


_BOOT = lambda seed: _sql_means(seed, f"x[CAST({{u}} * n // {significance.PRIME} AS BIGINT) + 1]")
_FLIP = lambda seed: _sql_means(seed, f"CASE WHEN 2 * {{u}} < {significance.PRIME} THEN -x[i + 1] ELSE x[i + 1] END")


def _topics(spark, d, run):
    """metric, topic, qid, value of a run."""
    per = ranking.per_query_by_class(run, _classes(spark, d), (20,)).join(_classes(spark, d).withColumnRenamed("id", "qid"), "qid")
    return per.select(F.col("label").alias("topic"), "qid", F.inline(F.array(F.struct(F.lit("ndcg").alias("metric"), F.col("ndcg_cut_20").alias("value")), F.struct(F.lit("map").alias("metric"), F.col("map_cut_20").alias("value")))))


def _queries(spark, d, how="inner"):
    """metric, topic, qid and the values of the runs over all components (a) and over the first half (b)."""
    a, b = (_topics(spark, d, _run(spark, d, 20, dims)).withColumnRenamed("value", n) for dims, n in ((None, "a"), (32, "b")))
    return a.join(b, ["metric", "topic", "qid"], how)


def _topic_means(rows, *models):
    """metric, topic and the models' means over the queries that all of them have: for MAP those for which each found something."""
    for n in models:
        rows = rows.where(F.col(n).isNotNull() & ((F.col("metric") == "ndcg") | (F.col(n) > 0)))
    return rows.groupBy("metric", "topic").agg(*[F.avg(n).alias(n) for n in models])


def _paired(rows):
    return written(_topic_means(rows, "a", "b").withColumn("diff", F.col("a") - F.col("b")))


def _values(spark, d):
    """The mean values of the topics that both runs have: a topic's MAP counts the queries for which both found something."""
    return _paired(_queries(spark, d))


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.select(*names).dtypes])


@_R.add("paired_bootstrap", f"""
WITH {_VALUES}, m AS ({_BOOT(11)}),
o AS (SELECT metric, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(diff) AS difference FROM v GROUP BY 1)
SELECT metric, n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(difference, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high
FROM o JOIN (SELECT metric, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m GROUP BY 1) USING (metric)
""")
def paired_bootstrap(spark, d):
    v = _values(spark, d)
    base = v.groupBy("metric").agg(F.count("*").alias("n"), *[F.avg(c).alias(n) for c, n in (("a", "mean_a"), ("b", "mean_b"), ("diff", "difference"))])
    return _rounded(base.join(significance.interval(significance.bootstrap_means(v, _B, 11)), "metric"), "metric", "n", "mean_a", "mean_b", "difference", "low", "high")


@_R.add("sign_flip", f"""
WITH {_VALUES}, m AS ({_FLIP(12)}), o AS (SELECT metric, avg(diff) AS obs FROM v GROUP BY 1)
SELECT metric, count_if(abs(mean) >= abs(obs) - 1e-15) AS extreme, round((1 + count_if(abs(mean) >= abs(obs) - 1e-15)) / {_B + 1}.0, 6) AS p FROM m JOIN o USING (metric) GROUP BY 1
""")
def sign_flip(spark, d):
    v = _values(spark, d)
    obs = v.groupBy("metric").agg(F.avg("diff").alias("mean"))
    return _rounded(significance.p_values(obs, significance.flip_means(v, _B, 12), _B), "metric", "extreme", "p")


_DRAWN = f"x[CAST({_sql_draw(22, 'i')} * n // {significance.PRIME} AS BIGINT) + 1]"


@_R.add("macro_bootstrap", f"""
WITH {_VALUES}, m AS (SELECT rep, avg(mean) AS mean FROM ({_BOOT(21)}) GROUP BY 1),
nul AS (SELECT rep, avg(mean) AS mean FROM ({_sql_means(23, f"CASE WHEN 2 * {{u}} < {significance.PRIME} THEN -{_DRAWN} ELSE {_DRAWN} END")}) GROUP BY 1),
o AS (SELECT avg(m) AS observed, count(*) AS n_tasks FROM (SELECT metric, avg(diff) AS m FROM v GROUP BY 1))
SELECT n_tasks, round(observed, 6) AS observed, round((SELECT quantile_cont(mean, 0.025) FROM m), 6) AS low, round((SELECT quantile_cont(mean, 0.975) FROM m), 6) AS high,
  round((1 + (SELECT count(*) FROM nul WHERE abs(mean) >= abs(observed))) / {_B + 1}.0, 6) AS p FROM o
""")
def macro_bootstrap(spark, d):
    v = _values(spark, d).withColumnRenamed("metric", "task")
    return _rounded(significance.macro(v, _B, 21), "n_tasks", "observed", "low", "high", "p")


_REPORT = f"""
fl AS ({_FLIP(32)}), bo AS ({_BOOT(31)}), o AS (SELECT metric, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(diff) AS mean, md5(string_agg(CAST(topic AS VARCHAR), ',' ORDER BY topic)) AS topics_md5 FROM v GROUP BY 1),
q AS (SELECT metric, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM bo GROUP BY 1),
e AS (SELECT metric, count_if(abs(fl.mean) >= abs(o.mean) - 1e-15) AS extreme FROM fl JOIN o USING (metric) GROUP BY 1)
"""


@_R.add("significance_report", f"""
WITH {_VALUES}, {_REPORT} SELECT metric, n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round((1 + extreme) / {_B + 1}.0, 6) AS p, topics_md5
FROM o JOIN q USING (metric) JOIN e USING (metric)
""")
def significance_report(spark, d):
    r = significance.report(_values(spark, d), _B, 31)
    r = r.withColumn("topics_md5", F.md5(F.array_join(F.transform("topics", lambda t: t.cast("string")), ",")))
    return _rounded(r, "metric", "n", "mean_a", "mean_b", "mean", "low", "high", "p", "topics_md5")


@_R.add("single_model", f"""
WITH {_VALUES.replace("avg(a) - avg(b) AS diff", "avg(a) AS diff")}, {_REPORT} SELECT metric, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round((1 + extreme) / {_B + 1}.0, 6) AS p FROM o JOIN q USING (metric) JOIN e USING (metric)
""")
def single_model(spark, d):
    """One model's values against zero."""
    rows = _values(spark, d).select("metric", "topic", F.col("a").alias("value"))
    return _rounded(significance.single(rows, _B, 31), "metric", "n", "mean", "low", "high", "p")


@_R.add("statistics_json", f"""
WITH {_VALUES}, {_REPORT} SELECT metric, n AS n_topics, round(mean, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, round((1 + extreme) / {_B + 1}.0, 6) AS p FROM o JOIN q USING (metric) JOIN e USING (metric)
""")
def statistics_json(spark, d):
    """The record of a run as one JSON document, written and read back: the paired figures, and each model's own over all topics that it has."""
    q, path = written(_queries(spark, d, "full")), scratch(spark)
    own = {f"model_{n}": written(_topic_means(q, n).withColumnRenamed(n, "value")) for n in "ab"}
    settings = {"protocol": "dense, best 20, the same label is relevant", "model_a": "all components", "model_b": "first 32 components", "seed": 31, "repetitions": _B}
    body = files.statistics_json(significance.report(_paired(q), _B, 31), {name: significance.single(x, _B, 31) for name, x in own.items()}, settings, own)
    files.write_lines(spark.createDataFrame([(body,)], "value string"), path)
    stats = "struct<n_topics:bigint,difference_a_minus_b:double,bootstrap_95_ci:array<double>,paired_sign_flip_p_two_sided:double>"
    rows = spark.read.text(path).select(F.explode(F.from_json(F.get_json_object("value", "$.metrics"), f"map<string,{stats}>")).alias("metric", "s"))
    return _rounded(rows.select("metric", "s.n_topics", F.col("s.difference_a_minus_b").alias("difference"), F.col("s.bootstrap_95_ci")[0].alias("low"), F.col("s.bootstrap_95_ci")[1].alias("high"),
                                F.col("s.paired_sign_flip_p_two_sided").alias("p")), "metric", "n_topics", "difference", "low", "high", "p")


@_R.add("both_metrics", f"""
WITH {_SHIFTS}, {_metrics_sql('og', 'm', (20,))}, p AS (SELECT qid, avg(shift) AS p_mrr FROM sc WHERE old <> new GROUP BY 1) SELECT qid, round(ndcg_cut_20, 6) AS ndcg_cut_20, round(p_mrr, 6) AS p_mrr FROM m JOIN p USING (qid)
""")
def both_metrics(spark, d):
    """The topics that have both metrics."""
    og = _original(spark, d)
    per = ranking.per_query_by_class(og, _classes(spark, d), (20,)).select("qid", "ndcg_cut_20")
    return _rounded(ranking.topic_table(per, ranking.pmrr(_shifts(spark, d, og).where("old <> new"))), "qid", "ndcg_cut_20", "p_mrr")


@_R.add("first_queries", """
WITH q AS (SELECT item_id AS qid FROM benchmark ORDER BY item_id LIMIT 25) SELECT item_id AS qid, item_id + 1 AS docid, 1 AS rel FROM benchmark WHERE item_id IN (SELECT qid FROM q)
""")
def first_queries(spark, d):
    """The judgements of the first 25 queries, as a smoke run takes them."""
    b = table(spark, d, "benchmark")
    q, j = ranking.first_queries(b.select(F.col("item_id").alias("qid"), "text"), b.select(F.col("item_id").alias("qid"), (F.col("item_id") + 1).alias("docid"), F.lit(1).alias("rel")), 25)
    return j.join(q.select("qid"), "qid")


@_R.add("judged_metrics", """
WITH run AS (SELECT CAST(doc_id % 37 AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS docid, CAST(n_chars AS DOUBLE) AS score FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM run),
q AS (SELECT CAST(doc_id % 37 AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS docid, quality + toxic AS rel FROM labels),
j AS (SELECT r.qid, rank, coalesce(rel, 0) AS rel FROM r LEFT JOIN q USING (qid, docid)), h AS (SELECT *, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM j),
g AS (SELECT qid, sum(CASE WHEN rank <= 10 AND rel >= 1 THEN 1 ELSE 0 END) AS h, sum(CASE WHEN rank <= 10 AND rel >= 1 THEN hits / rank ELSE 0.0 END) AS a, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1.0) ELSE 0.0 END) AS d FROM h GROUP BY 1),
i AS (SELECT qid, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) AS R, sum(CASE WHEN n <= 10 THEN rel / log2(n + 1.0) ELSE 0.0 END) AS i FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS n FROM q) GROUP BY 1)
SELECT qid, round(CASE WHEN i > 0 THEN d / i ELSE 0.0 END, 6) AS ndcg_cut_10, round(CASE WHEN R > 0 THEN a / R ELSE 0.0 END, 6) AS map_cut_10, round(CASE WHEN R > 0 THEN h / R ELSE 0.0 END, 6) AS recall_10, round(h / 10.0, 6) AS P_10 FROM g JOIN i USING (qid)
""")
def judged_metrics(spark, d):
    """Graded judgements read from nested files, against a run."""
    path, q = scratch(spark), (F.col("doc_id") % 37).cast("string")
    one = table(spark, d, "labels").groupBy(q.alias("qid"), F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.col("quality") + F.col("toxic")))).alias("m"))
    files.write_lines(one.select(F.to_json(F.create_map("qid", "m")).alias("value")), path)
    run = ranking.ranked(table(spark, d, "documents").select(q.alias("qid"), F.col("doc_id").cast("string").alias("docid"), F.col("n_chars").cast("double").alias("score")))
    per = ranking.per_query(run, files.judgements(spark, path), (10,))
    return _rounded(per, "qid", "ndcg_cut_10", "map_cut_10", "recall_10", "P_10")


@_R.add("candidate_lists", "SELECT DISTINCT CAST(doc_id % 37 AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS docid FROM documents")
def candidate_lists(spark, d):
    path, q = scratch(spark), (F.col("doc_id") % 37).cast("string")
    lists = table(spark, d, "documents").groupBy(q.alias("qid"), F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("part")).agg(F.collect_list(F.col("doc_id").cast("string")).alias("l"))
    files.write_lines(lists.select(F.to_json(F.create_map("qid", "l")).alias("value")), path)
    return files.candidates(spark, path)


@_R.add("task_tables", """
SELECT layout, 'corpus' AS kind, CAST(doc_id AS VARCHAR) AS id, md5(coalesce(text, '')) AS text_md5, 0 AS rel FROM documents, (SELECT unnest(['split', 'subset', 'dataset']) AS layout)
UNION ALL SELECT layout, 'queries', CAST(item_id AS VARCHAR), md5(text), 0 FROM benchmark, (SELECT unnest(['split', 'subset', 'dataset']) AS layout)
UNION ALL SELECT layout, 'qrels', CAST(item_id AS VARCHAR), md5(CAST(item_id + 1 AS VARCHAR)), 1 FROM benchmark, (SELECT unnest(['split', 'subset', 'dataset']) AS layout)
""")
def task_tables(spark, d):
    """A task's corpus, queries and judgements from each of the three layouts of folders."""
    b, out = table(spark, d, "benchmark"), None
    given = {"corpus": table(spark, d, "documents").select(F.col("doc_id").alias("_id"), "text"), "queries": b.select(F.col("item_id").alias("_id"), "text"),
             "qrels": b.select(F.col("item_id").alias("query-id"), (F.col("item_id") + 1).alias("corpus-id"))}
    for layout, at in {"split": "{k}/test", "subset": "{k}/default/test", "dataset": "default/test/{k}"}.items():
        path = scratch(spark)
        for k, df in given.items():
            df.write.parquet(f"{path}/{at.format(k=k)}")
        c, q, j = retrieval.task_tables(spark, path)
        item = lambda kind, i, t, rel: (F.lit(layout).alias("layout"), F.lit(kind).alias("kind"), F.col(i).alias("id"), F.md5(t).alias("text_md5"), rel.alias("rel"))  # noqa: E731, B023
        rows = c.select(*item("corpus", "docid", "text", F.lit(0))).unionByName(q.select(*item("queries", "qid", "text", F.lit(0)))).unionByName(j.select(*item("qrels", "qid", "docid", F.col("rel"))))
        out = rows if out is None else out.unionByName(rows)
    return out


@_R.add("task_subsets", """
SELECT 'benchmarks' || (item_id % 2) || CASE WHEN item_id % 2 = 1 THEN '/' || s ELSE '' END AS task, CAST(item_id AS VARCHAR) AS qid, CAST(item_id AS VARCHAR) AS docid, 1 AS rel
FROM benchmark, (SELECT unnest(['de', 'en']) AS s) WHERE item_id % 2 = 1 OR s = 'de'
""")
def task_subsets(spark, d):
    """The judgements of all tasks below a folder, one of which has two subsets, by the loader of plain tasks."""
    root, b, i = scratch(spark), table(spark, d, "benchmark"), F.col("item_id")
    for task, at in ((0, "{k}/test"), (1, "{k}/de/test"), (1, "{k}/en/test")):
        own = b.where(i % 2 == task)
        own.select(i.alias("_id"), "text").write.parquet(f"{root}/benchmarks{task}/{at.format(k='corpus')}")
        own.select(i.alias("_id"), "text").write.parquet(f"{root}/benchmarks{task}/{at.format(k='queries')}")
        own.select(i.alias("query-id"), i.alias("corpus-id")).write.parquet(f"{root}/benchmarks{task}/{at.format(k='qrels')}")
    found = retrieval.load("rumteb", spark, root, {"task_names": ["benchmarks1", "benchmarks0"]})
    out = None
    for name, (_, _, j) in found.items():
        rows = j.select(F.lit(name).alias("task"), "qid", "docid", "rel")
        out = rows if out is None else out.unionByName(rows)
    return out


@_R.add("reranking_task", """
SELECT CAST(item_id AS VARCHAR) AS qid, CAST(item_id + k AS VARCHAR) AS docid, CAST(CASE WHEN k = 1 THEN 1 ELSE 0 END AS INT) AS rel, k = 2 AS changed FROM benchmark, unnest(range(1, 5)) AS t(k)
""")
def reranking_task(spark, d):
    """Candidates of the reranking task with their judgements, and whether they are changed documents, by its loader under a pinned revision."""
    root, b, i, revision = scratch(spark), table(spark, d, "benchmark"), F.col("item_id"), "0123456789abcdef" * 2 + "01234567"
    b.select(i.alias("_id"), "text").write.parquet(f"{root}/corpus/test")
    b.select(i.alias("_id"), "text").write.parquet(f"{root}/queries/test")
    b.select(i.alias("query-id"), (i + 1).alias("corpus-id"), F.lit(1.0).alias("score")).write.parquet(f"{root}/qrels/test")
    text = lambda *ks: F.to_json(F.create_map(i.cast("string"), F.array(*[(i + k).cast("string") for k in ks]))).alias("value")
    files.write_lines(b.select(text(1, 2, 3, 4)), f"{root}/candidates")
    files.write_lines(b.select(text(2)), f"{root}/qrel_diff")
    files.write_lines(b.limit(1).select(F.lit(revision).alias("value")), f"{root}/revision")
    _, _, judged, candidates, changed = retrieval.load("mfollowir", spark, root, {"revision": revision}, revision=revision, pinned=True)["mfollowir"]
    rows = candidates.join(judged, ["qid", "docid"], "left").join(changed.withColumn("changed", F.lit(True)), ["qid", "docid"], "left")
    return rows.select("qid", "docid", F.coalesce("rel", F.lit(0)).alias("rel"), F.coalesce("changed", F.lit(False)).alias("changed"))


@_R.add("synthetic_test", f"""
WITH {_PAIRED} SELECT qid, docid, rel FROM qr
""")
def synthetic_test(spark, d):
    """The paired test set by its loader, from its two files."""
    b, i, path = table(spark, d, "benchmark"), F.col("item_id"), scratch(spark)
    ps = lambda *ks: F.array(*[F.struct((i + k).cast("string").alias("docid"), F.lit("t").alias("text"), F.lit("").alias("title"), F.lit("").alias("explanation")) for k in ks])
    side = lambda q, ins, pos, new: F.struct(q.alias("query_id"), F.lit("q").alias("query"), ins.alias("only_instruction"), pos.alias("positive_passages"), new.alias("new_negatives"))
    rows = b.select(F.inline(F.array(side(i.cast("string"), F.lit(""), ps(0, 1, 2), F.slice(ps(0), 1, 0)),
                                     side(F.concat(i.cast("string"), F.lit("-instruct")), F.when(i % 4 == 0, " ").otherwise("only x"), ps(0, 1), ps(5, 2)))))
    files.write_sharded(records.as_training(rows.withColumn("positive_passages", F.transform("positive_passages", lambda p: p.dropFields("explanation")))), path, "test", 1000)
    files.write_pool(b.select(i.cast("string").alias("docid"), "text", F.lit("").alias("title")), path, "test")
    return retrieval.load("synthetic_test", spark, path, {"data_path": path, "revision": "r", "instruction_negative_field": "new_negatives"})["synthetic_test"][2]


@_R.add("infonce", """
WITH e AS (SELECT vec_id, vec_id // 8 AS batch, vec_id % 8 AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
q AS (SELECT batch, k // 4 AS i, v FROM e WHERE k % 4 = 0), p AS (SELECT batch, k // 4 AS j, k % 4 - 1 AS position, v FROM e WHERE k % 4 > 0),
s AS (SELECT q.batch, i, list_dot_product(q.v, p.v) / 0.5 AS s, i = j AND position = 0 AS own FROM q JOIN p USING (batch)),
l AS (SELECT batch, i, ln(sum(exp(s))) - max(CASE WHEN own THEN s END) AS loss FROM s GROUP BY 1, 2)
SELECT batch, round(avg(loss), 6) AS loss, count(*) AS n FROM l GROUP BY 1
""")
def infonce(spark, d):
    """Batches of eight vectors: two queries, each with a positive and two negatives."""
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("batch"), (F.col("vec_id") % 8).alias("k"), F.col("embedding").alias("v"))
    q = e.where("k % 4 = 0").select("batch", F.expr("k div 4").alias("i"), "v")
    p = e.where("k % 4 > 0").select("batch", F.expr("k div 4").alias("i"), (F.col("k") % 4 - 1).alias("position"), "v")
    return sampling.infonce(q, p, 0.5).select("batch", F.round("loss", 6).alias("loss"), "n")


@_R.add("pairwise_similarity", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS next_dot, round(sqrt(list_dot_product(a.v, a.v)), 6) AS norm FROM e a JOIN e b ON b.vec_id = a.vec_id + 1
""")
def pairwise_similarity(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(dot(F.col("embedding"), F.col("w")), 6).alias("next_dot"), F.round(norm(F.col("embedding")), 6).alias("norm"))


@_R.add("pair_counts", """
SELECT count(*) AS n_pairs, count(*) AS n_instructed, CAST(2 * count(*) AS BIGINT) AS n_negatives FROM benchmark WHERE item_id % 4 <> 0
""")
def pair_counts(spark, d):
    i = F.col("item_id")
    side = lambda q, ins, n: F.struct(q.alias("query_id"), F.lit(ins).alias("only_instruction") if isinstance(ins, str) else ins.alias("only_instruction"), F.slice(F.array(F.lit("x"), F.lit("y")), 1, n).alias("new_negatives"))
    rows = table(spark, d, "benchmark").select(F.inline(F.array(side(i.cast("string"), "", 0), side(F.concat(i.cast("string"), F.lit("-instruct")), F.when(i % 4 == 0, " ").otherwise("only x"), 2))))
    return ranking.pair_counts(ranking.checked_pairs(rows))


@_R.add("pooled_states", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, vec_id % 60 + 1 AS n FROM embeddings)
SELECT vec_id, round(v[n], 6) AS state, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM e
""")
def pooled_states(spark, d):
    """The state at the last token of a mask, and a normalised vector's first component."""
    e = table(spark, d, "embeddings")
    n = (F.col("vec_id") % 60 + 1).cast("int")
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(64) - n))
    return e.select("vec_id", F.round(last_token(F.col("embedding"), mask).cast("double"), 6).alias("state"), F.round(normalised(F.col("embedding"))[0], 6).alias("first"))


@_R.add("closed_ids", """
WITH c AS (SELECT conv_id, list(turn ORDER BY turn, text)[1:10] AS l FROM conversations GROUP BY 1), x AS (SELECT conv_id, list_concat(l, [99]) AS l FROM c)
SELECT conv_id, array_to_string(list_concat(l, list_transform(range((8 - len(l) % 8) % 8), lambda i: 0)), ',') AS ids FROM x
""")
def closed_ids(spark, d):
    """Ids cut to ten, closed by an end id and padded to a multiple of eight."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["turn"]).alias("l"))
    return rows.select("conv_id", F.array_join(with_end(F.col("l"), 99, 11), ",").alias("ids"))
