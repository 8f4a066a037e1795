"""Queries over results, schedules and streams."""
from pyspark.sql import functions as F

from ..functions.text import stamp
from ..operators import results
from ..sources import commits, files
from ..sources.scratch import scratch
from ..streaming import flows, requests
from .registry import Registry, table

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


def _documents(spark, d):
    """One nested result document per label row, as JSON."""
    r = table(spark, d, "labels")
    return r.select("doc_id", F.concat(
        F.lit('[{"task_name":"T'), (F.col("doc_id") % 3).cast("string"), F.lit('","scores":{"test":[{"hf_subset":"x","p-MRR":0.'), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"),
        F.lit(',"ndcg_at_10":'), F.col("quality").cast("string"), F.lit(',"nested":{"main_score":1,"map_at_5":'), F.col("toxic").cast("string"), F.lit(',"flag":true}}]}}]')).alias("j"))


@_R.add("flatten_metrics", """
WITH r AS (SELECT doc_id, 'T' || CAST(doc_id % 3 AS VARCHAR) AS t, quality, toxic FROM labels)
SELECT doc_id, t || '.p_mrr' AS metric, (doc_id % 1000) / 1000.0 AS value FROM r UNION ALL SELECT doc_id, t || '.ndcg_cut_10', CAST(quality AS DOUBLE) FROM r
UNION ALL SELECT doc_id, t || '.nested.map_cut_5', CAST(toxic AS DOUBLE) FROM r UNION ALL SELECT doc_id, t || '.nested.flag', 1.0 FROM r
""")
def flatten_metrics(spark, d):
    rows = _documents(spark, d)
    flat = rows.lateralJoin(results.FlattenMetrics(F.col("j").outer()))
    return flat.select("doc_id", results.metric_name(F.col("name")).alias("metric"), "value")


@_R.add("metric_rename", """
WITH r AS (SELECT unnest(['p-MRR', 'T1.p-MRR', 'xp-MRR', 'ndcg_at_10', 'a.map_at_100', 'recall_at_10']) AS name, unnest([1, 2, 3, 4, 5, 6]) AS i)
SELECT event_id, name, CASE i WHEN 1 THEN 'p_mrr' WHEN 2 THEN 'T1.p_mrr' WHEN 3 THEN 'xp-MRR' WHEN 4 THEN 'ndcg_cut_10' WHEN 5 THEN 'a.map_cut_100' ELSE name END AS renamed FROM events JOIN r ON i = event_id % 6 + 1
""")
def metric_rename(spark, d):
    names = F.array(*map(F.lit, ("p-MRR", "T1.p-MRR", "xp-MRR", "ndcg_at_10", "a.map_at_100", "recall_at_10")))
    name = F.element_at(names, (F.col("event_id") % 6).cast("int") + 1)
    return table(spark, d, "events").select("event_id", name.alias("name"), results.metric_name(name).alias("renamed"))


@_R.add("results_table", """
WITH m AS (SELECT event_type AS dataset, 'p_mrr' AS metric, avg(value) / 1000 AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'ndcg_cut_10', avg(value) / 100 FROM events GROUP BY 1)
SELECT dataset, metric, CASE metric WHEN 'ndcg_cut_10' THEN 0 ELSE 1 END AS key_rank, round(value, 6) AS value, CASE metric WHEN 'p_mrr' THEN printf('%.2f', round(value, 6) * 100) ELSE printf('%.4f', round(value, 6)) END AS shown FROM m
""")
def results_table(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("dataset")).agg(F.avg("value").alias("v"))
    item = lambda m, v: F.struct(F.lit(m).alias("metric"), v.alias("value"))
    tall = e.select("dataset", F.inline(F.array(item("p_mrr", F.col("v") / 1000), item("ndcg_cut_10", F.col("v") / 100), item("nauc_x", F.col("v")), item("precision_at_1", F.col("v")))))
    return results.summary(tall.withColumn("value", F.round("value", 6)), ["ndcg_cut_10"]).select("dataset", "metric", "key_rank", "value", "shown")


@_R.add("result_cache", """
WITH f AS (SELECT doc_id, sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS fingerprint FROM documents),
s AS (SELECT sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS fingerprint, max('/results/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.json') AS path FROM documents WHERE n_chars > 5000 GROUP BY 1)
SELECT doc_id, fingerprint, path, path IS NOT NULL AS hit FROM f LEFT JOIN s USING (fingerprint)
""")
def result_cache(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", results.fingerprints(table(spark, d, "documents"), "source", "lang").alias("fingerprint"))
    stored = docs.where("n_chars > 5000").select("fingerprint", F.concat(F.lit("/results/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".json")).alias("path"))
    return results.cached(docs.select("doc_id", "fingerprint"), stored)


@_R.add("result_scan", "SELECT 'm' || CAST(item_id % 3 AS VARCHAR) AS model, 'd' AS dataset, '20260102_030405' AS timestamp, count(*) AS n FROM benchmark WHERE item_id % 2 = 0 GROUP BY 1")
def result_scan(spark, d):
    """Result documents, one a file, scanned: payloads without results are ignored, as a manifest is."""
    path = scratch(spark)
    i = F.col("item_id")
    body = F.to_json(F.struct(F.concat(F.lit("m"), (i % 3).cast("string")).alias("model"), F.lit("d").alias("dataset"), stamp(F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")).alias("timestamp"),
                              F.when(i % 2 == 0, F.struct(i.alias("x"))).alias("results")))
    table(spark, d, "benchmark").select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/parts")
    files.write_lines(spark.createDataFrame([(files.manifest({"a": 1}, files.package_versions(["pyspark"]), "2026-01-02T03:04:05+00:00", "abc", False),)], "value string"), f"{path}/manifest")
    found = files.result_documents(spark, f"{path}/parts", "*.txt").unionByName(files.result_documents(spark, f"{path}/manifest", "*.txt"))
    return found.groupBy("model", "dataset", "timestamp").agg(F.count("*").alias("n"))


@_R.add("log_history", "SELECT CASE WHEN item_id % 4 > 0 THEN item_id END AS step, CAST(item_id AS DOUBLE) / 8 AS loss FROM benchmark")
def log_history(spark, d):
    """A trainer's log entries, of which some carry no step."""
    path, i = scratch(spark), F.col("item_id")
    entry = F.to_json(F.struct(F.when(i % 4 > 0, i).alias("step"), (i / 8).alias("loss")))
    states = table(spark, d, "benchmark").groupBy((i % 5).alias("part")).agg(F.array_join(F.collect_list(entry), ",").alias("l"))
    states.select(F.concat(F.lit('{"best": 1, "log_history": ['), "l", F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.log_history(spark, path).select("step", F.get_json_object("entry", "$.loss").cast("double").alias("loss"))


@_R.add("protocol_fingerprints", """
SELECT item_id, sha256('{"code_revision":"r","dataset":{"name":"d' || item_id || '"},"global":{"device":null,"dtype":null,"generic_instruction":"g","retrieval_top_k":100},"model":{"type":"bm25"}}') AS fingerprint FROM benchmark
""")
def protocol_fingerprints(spark, d):
    """The fingerprint of a request for each item's dataset."""
    name = F.struct(F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("name"))
    body = results.protocol_column({"retrieval_top_k": 100, "generic_instruction": "g", "other": 1}, F.struct(F.lit("bm25").alias("type")), name, "r")
    return table(spark, d, "benchmark").select("item_id", body.alias("fingerprint"))


@_R.add("listed_files", """
WITH n AS (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) AS k FROM documents) SELECT 'train-' || lpad(CAST(i AS VARCHAR), 5, '0') || '-of-' || lpad(CAST(k AS VARCHAR), 5, '0') || '.parquet' AS name FROM n, unnest(range(k)) AS t(i)
""")
def listed_files(spark, d):
    """The shards of a split in order; other splits' shards and logs of what was deleted do not count."""
    path, docs = scratch(spark), table(spark, d, "documents").select("doc_id", "lang")
    files.write_sharded(docs, path, "train", 50, ("doc_id",))
    files.write_sharded(docs.where("lang = 'en'"), path, "test", 50, ("doc_id",))
    files.write_jsonl(docs.where("lang = 'de'"), f"{path}/data/deleted_queries.jsonl")
    return spark.createDataFrame([(n,) for n in files.listed(spark, f"{path}/data", r"^train-.*\.parquet$")], "name string")


@_R.add("filtered_glob", "SELECT item_id AS query_id FROM benchmark WHERE item_id % 2 = 0")
def filtered_glob(spark, d):
    """Only a filter run's outputs are read by their name."""
    path, b = scratch(spark), table(spark, d, "benchmark")
    for name, rest in (("run_paraphrasing_1_filtered", 0), ("other", 1)):
        files.write_jsonl(b.where(F.col("item_id") % 2 == rest).select(F.col("item_id").alias("query_id")), f"{path}/parts_{name}")
        files.moved(spark, f"{path}/parts_{name}", f"{path}/{name}", ".jsonl")
    return files.filtered(spark, path).select("query_id")


@_R.add("predictions_read", "SELECT 's' || CAST(doc_id % 4 AS VARCHAR) AS subset, 'test' AS split, CAST(doc_id AS VARCHAR) AS qid, 'd' || CAST(doc_id % 7 AS VARCHAR) AS docid, CAST(n_chars AS DOUBLE) AS score FROM documents")
def predictions_read(spark, d):
    path = scratch(spark)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    one = F.concat(q(F.col("doc_id").cast("string")), F.lit(':{"d'), (F.col("doc_id") % 7).cast("string"), F.lit('":'), F.col("n_chars").cast("string"), F.lit("}"))
    per = table(spark, d, "documents").groupBy(F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")).alias("subset"), F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("part")).agg(F.array_join(F.collect_list(one), ",").alias("body"))
    value = F.concat(F.lit("{"), q(F.col("subset")), F.lit(':{"test":{'), F.col("body"), F.lit('}},"mteb_model_meta":{"name":"x"}}'))
    # one prediction document a file
    per.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.predictions(spark, path)


@_R.add("latest_checkpoint", "SELECT 'checkpoint-' || CAST(max(doc_id) AS VARCHAR) AS path, max(doc_id) AS step FROM documents")
def latest_checkpoint(spark, d):
    ids = table(spark, d, "documents").select(F.explode(F.array(F.concat(F.lit("checkpoint-"), F.col("doc_id").cast("string")), F.lit("final"))).alias("path"))
    return results.latest_checkpoint(ids).select("path", F.col("step").cast("long").alias("step"))


@_R.add("concurrency_schedule", """
WITH l AS (SELECT event_id, ts + INTERVAL 3 HOUR AS t FROM events), p AS (SELECT event_id, isodow(t) - 1 AS wd, hour(t) AS h FROM l)
SELECT event_id, CASE WHEN wd IN (5, 6) OR (wd = 4 AND h >= 18) OR (wd = 0 AND h < 7) THEN 9 WHEN h >= 8 AND h < 19 THEN 3 ELSE 6 END AS cap FROM p
""")
def concurrency_schedule(spark, d):
    return table(spark, d, "events").select("event_id", results.concurrency(F.col("ts").cast("timestamp")).alias("cap"))


@_R.add("resumable_filter", "SELECT event_id, event_type, value FROM events WHERE value > 10")
def resumable_filter(spark, d):
    """A file stream run twice under one checkpoint: the second run finds nothing new."""
    out, checkpoint = scratch(spark), scratch(spark)
    for _ in range(2):
        events = flows.event_stream(spark, f"{d}/events.parquet")
        flows.resumable(events, lambda x: x.where("value > 10").select("event_id", "event_type", "value"), out, checkpoint)
    return spark.read.schema("event_id bigint, event_type string, value double").parquet(out)


@_R.add("capped_stream", "SELECT event_id, 9 AS cap FROM events WHERE value > 10")
def capped_stream(spark, d):
    """A file stream whose batches go through as many partitions as the schedule allows when they start: on a weekend, nine."""
    out, checkpoint = scratch(spark), scratch(spark)
    for _ in range(2):
        flows.capped(flows.event_stream(spark, f"{d}/events.parquet"), lambda x: x.where("value > 10").select("event_id"), out, checkpoint, clock=lambda: "2026-01-03 12:00:00")
    return spark.read.schema("event_id bigint, cap int").parquet(out).select("event_id", "cap")


@_R.add("append_once", "SELECT event_id, user_id FROM events")
def append_once(spark, d):
    """Key-based resume: appended twice, present once."""
    path = scratch(spark)
    rows = table(spark, d, "events").select("event_id", "user_id")
    for _ in range(2):
        flows.append_new(rows, "event_id", path)
    return spark.read.schema(rows.schema).parquet(path)


@_R.add("event_tumbling", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark, d):
    """Extension: tumbling windows over the events as a stream."""
    out = flows.finished(flows.windows(flows.event_stream(spark, f"{d}/events.parquet"), "10 minutes"), ("w_start", "event_type"))
    return out.select(F.col("w_start").cast("timestamp_ntz").alias("w_start"), "event_type", "n", F.round("total", 4).alias("total"))


@_R.add("event_sliding", """
WITH s AS (SELECT unnest([0, 5]) AS back) SELECT time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(back) AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, s GROUP BY 1, 2
""")
def event_sliding(spark, d):
    """Extension: sliding windows."""
    out = flows.finished(flows.windows(flows.event_stream(spark, f"{d}/events.parquet"), "10 minutes", "5 minutes"), ("w_start", "event_type"))
    return out.select(F.col("w_start").cast("timestamp_ntz").alias("w_start"), "event_type", "n", F.round("total", 4).alias("total"))


@_R.add("event_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS s_start, count(*) AS n FROM s GROUP BY user_id, k
""")
def event_sessions(spark, d):
    """Extension: sessions of a user with gaps up to half an hour."""
    out = flows.finished(flows.sessions(flows.closed(spark, f"{d}/events.parquet")), ("user_id", "s_start"), append=True)
    return out.select("user_id", F.col("s_start").cast("timestamp_ntz").alias("s_start"), "n")


@_R.add("committed_stream", "SELECT event_id, event_type FROM events WHERE value > 10")
def committed_stream(spark, d):
    """A stream into committed batches, run again from the start under a checkpoint that was lost: its batches are known and count once."""
    path = scratch(spark)
    for _ in range(2):
        flows.appended(flows.event_stream(spark, f"{d}/events.parquet"), path, scratch(spark), "events", lambda x: x.where("value > 10").select("event_id", "event_type"))
    return commits.read(spark, path, "event_id bigint, event_type string")


@_R.add("inputs_without_logs", "SELECT item_id AS query_id FROM benchmark WHERE item_id % 3 = 0")
def inputs_without_logs(spark, d):
    """Generated records are read from a folder without its logs of deleted queries."""
    path, b = scratch(spark), table(spark, d, "benchmark")
    for name, rest in (("a", 0), ("deleted_queries", 1), ("deleted_negatives", 2)):
        files.write_jsonl(b.where(F.col("item_id") % 3 == rest).select(F.col("item_id").alias("query_id")), f"{path}/parts_{name}")
        files.moved(spark, f"{path}/parts_{name}", f"{path}/{name}", ".jsonl")
    return files.generated(spark, path).select("query_id")


@_R.add("stored_results", "SELECT 'm' || CAST(q AS VARCHAR) AS model, 'd' AS dataset, CAST(n AS VARCHAR) AS shown FROM (SELECT quality AS q, count(*) AS n FROM labels GROUP BY 1)")
def stored_results(spark, d):
    """Result documents, stored and found again beside a manifest that is no result."""
    path = scratch(spark)
    for r in table(spark, d, "labels").groupBy("quality").count().orderBy("quality").collect():  # a result for each of two grades
        files.store_result(spark, path, f"m{r.quality}", "d", {"n": r["count"]}, f"f{r.quality}", {"top_k": 5}, "20260102_030405")
    body = files.manifest({"seed": 1}, files.package_versions(["pyspark", "no-such-package"]), "2026-01-02T03:04:05+00:00", "abc", True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("append").text(path)
    return files.result_documents(spark, path, "part-*").select("model", "dataset", F.get_json_object("results", "$.n").alias("shown"))


@_R.add("retried_requests", """
SELECT CAST(item_id AS VARCHAR) AS query_id, CASE WHEN starts_with(md5(text), '0') THEN 'failed' ELSE 'success' END AS status, CASE WHEN NOT starts_with(md5(text), '0') THEN upper(substr(md5(text), 1, 8)) END AS response,
       CASE WHEN starts_with(md5(text), '0') THEN 2 ELSE 1 END AS tries FROM benchmark
""")
def retried_requests(spark, d):
    """Requests of a stream: those that fail are tried again by a timer, beside the others, and are told in the end."""
    def client():
        from hashlib import md5

        def call(prompt):
            digest = md5(prompt.encode()).hexdigest()
            if digest.startswith("0"):
                raise ValueError("no answer")
            return digest[:8].upper()

        return call

    given, out = scratch(spark), scratch(spark)
    table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("prompt")).write.parquet(given)
    source = spark.readStream.schema("query_id string, prompt string").parquet(given)
    requests.answered(source, client, out, scratch(spark), attempts=2, least=0.1, most=0.1, every="200 milliseconds", partitions=2)
    return spark.read.schema(requests.ANSWER).parquet(out).select("query_id", "status", "response", "tries")
