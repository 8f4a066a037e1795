"""Readers and writers: TSV, JSONL, sharded Parquet, predictions, results.  Schemas are declared, never inferred."""
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import FILTERED, GENERATED, TRAINING
from ..functions.text import strip
from .scratch import written


def _told_apart(names: list) -> tuple:
    """(start, length) of the part of the names (from 1, as substring counts) by which they differ: it orders them as they are ordered."""
    names = sorted(names)
    shared = len(os.path.commonprefix(names))
    return shared + 1, max((len(os.path.commonprefix(two)) for two in zip(names, names[1:])), default=shared) - shared + 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line of text files: line orders the rows of all files as they stand there.

    It is where a row was read, (what tells its file's name from the others, first byte of its split, number in the task), so that order needs
    no numbering and no shuffle: a split is read by one task from its first row to its last.  A row does not carry its path, which would be
    most of what a sort by line holds.  For consecutive numbers see operators.dedup.numbered.
    """
    name = F.col("_metadata.file_path")
    names = spark.read.format("binaryFile").load(path).select(name.alias("file")).collect()  # a row per file, of which no content is read
    at = F.struct(F.substring(name, *_told_apart([r.file for r in names])).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select("value", name.alias("file"), at.alias("line"))


def id_texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of `id TAB text` lines: lines with fewer fields or another id than a number are dropped, the last line of an id wins."""
    cut = F.split(strip(F.col("value")), "\t")
    rows = lines(spark, path).select(F.try_element_at(cut, F.lit(1)).try_cast("bigint").alias("id"), F.try_element_at(cut, F.lit(2)).alias("text"), "line")
    return rows.where("id is not null and text is not null").groupBy("id").agg(F.max_by("text", "line").alias("text"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pos_id, neg_id, line, file, value) of `qid TAB pos TAB neg` lines; malformed lines are dropped."""
    cut = F.split(strip(F.col("value")), "\t")
    rows = lines(spark, path).select(*[F.try_element_at(cut, F.lit(i + 1)).try_cast("bigint").alias(n) for i, n in enumerate(("qid", "pos_id", "neg_id"))], "line", "file", "value")
    return rows.where("qid is not null and pos_id is not null and neg_id is not null")


def jsonl(spark: SparkSession, path: str, schema: str, skip_deleted: bool = False, glob: str = "*.jsonl") -> DataFrame:
    """JSON lines under a declared schema; bad JSON fails, blank lines are skipped.  `_metadata.file_path` orders the files."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", glob).json(path)
    if skip_deleted:
        df = df.where(~F.col("_metadata.file_name").startswith("deleted_"))
    return df


def generated(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, GENERATED, skip_deleted=True)


def filtered(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, FILTERED, glob="run_paraphrasing_*_filtered*.jsonl")


def training_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """data/<split>-*.parquet below root; `validation` is `val`; a split without files is an error."""
    split = "val" if split == "validation" else split
    return spark.read.schema(TRAINING).parquet(f"{root}/data/{split}-*.parquet")


def splits(spark: SparkSession, root: str, schema: str = TRAINING) -> DataFrame:
    """All splits below root as one table with a column `split`, by the names of the files: a filter on it opens that split's files only."""
    name = F.regexp_extract("_metadata.file_name", "^(.+)-\\d{5}-of-\\d{5}\\.parquet$", 1)
    return spark.read.schema(schema).parquet(f"{root}/data").select("*", name.alias("split"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(column).write.mode("overwrite").text(path)


def write_routed(decided: DataFrame, path: str) -> None:
    """Kept, discarded and failed records, each under its decision."""
    decided.write.mode("overwrite").partitionBy("decision").json(path)


def write_filtered(outcome: DataFrame, path: str) -> None:
    """The three logs of a filter run (operators.records.filtered_records): kept records, discarded queries, and negatives that went."""
    outcome = written(outcome)  # decided once, read three times
    kept = outcome.where("status = 'kept'")
    write_jsonl(kept.select("record.*"), f"{path}/kept")
    write_jsonl(outcome.where("status = 'discarded'").select("discarded.*"), f"{path}/deleted_queries")
    write_jsonl(kept.select(F.explode("deleted").alias("d")).select("d.*"), f"{path}/deleted_negatives")


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str, pattern: str = "") -> list:
    """The names of the files below path that match a pattern, in order."""
    at, fs = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in names if re.search(pattern, n))


def moved(spark: SparkSession, source: str, target: str, suffix: str) -> None:
    """The part files of a written folder as files of their own: target-00000<suffix>, ...; by renames."""
    at, fs = _fs(spark, source)
    for i, name in enumerate(n for n in listed(spark, source) if n.startswith("part-")):
        fs.rename(_fs(spark, f"{source}/{name}")[0], _fs(spark, f"{target}{'' if not i else f'-{i:05d}'}{suffix}")[0])
    fs.delete(at, True)


def write_sharded(df: DataFrame, path: str, split: str, rows_per_shard: int = 150_000, order: tuple = ("query_id",), empty: bool = True) -> int:
    """Snappy Parquet files data/<split>-00000-of-000NN.parquet below path, of rows_per_shard rows each but for the last.

    Rows are numbered in `order` by ranges, every shard is one task's file, and the files get their names by renames; an
    empty table writes nothing, or is an error unless `empty`.  The number of shards is returned.
    """
    from ..operators.split import shard_numbers

    spark = df.sparkSession
    rows = written(shard_numbers(df, rows_per_shard, *order))
    shards = (rows.agg(F.max("shards").alias("n")).first().n or 0)
    if not shards and not empty:
        raise ValueError(f"the split {split} has no rows")
    if not shards:
        return 0
    parts = f"{path}/data/_{split}"
    rows.drop("shards").repartition(shards, "shard").sortWithinPartitions("shard", *order).write.mode("overwrite").option("compression", "snappy").partitionBy("shard").parquet(parts)
    at, fs = _fs(spark, parts)
    for folder in fs.listStatus(at):
        number = re.fullmatch(r"shard=(\d+)", folder.getPath().getName())
        for f in fs.listStatus(folder.getPath()) if number else ():
            if f.getPath().getName().endswith(".parquet"):
                fs.rename(f.getPath(), _fs(spark, f"{path}/data/{split}-{int(number.group(1)):05d}-of-{shards:05d}.parquet")[0])
    fs.delete(at, True)
    return shards


def write_pool(pool: DataFrame, path: str, split: str) -> None:
    """A split's documents as flat Parquet, <split>_corpus below path."""
    pool.select("docid", "text", "title").write.mode("overwrite").parquet(f"{path}/{split}_corpus")


def write_requeued(deleted: DataFrame, succeeded: DataFrame, spark: SparkSession, triples_path: str, path: str) -> None:
    """The raw lines of the first triple of every deleted query that has no success, unchanged, in the order of the files."""
    from ..operators.dedup import requeue

    missing = requeue(deleted, succeeded, triples(spark, triples_path), order=("line",))
    write_lines(missing.orderBy("line").select("value"), path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """subset, split, qid, docid, score of prediction files {subset: {split: {qid: {docid: score}}}}; other top-level keys are dropped."""
    files = spark.read.option("wholetext", True).text(path).select("value")
    per = files.select(F.explode(F.from_json("value", "map<string,string>")).alias("subset", "body")).where("subset <> 'mteb_model_meta'")
    tall = per.select("subset", F.explode(F.from_json("body", "map<string,map<string,map<string,double>>>")).alias("split", "q"))
    return tall.select("subset", "split", F.explode("q").alias("qid", "d")).select("subset", "split", "qid", F.explode("d").alias("docid", "score"))


def only_file(spark: SparkSession, pattern: str) -> str:
    """The one path that matches; none or several are an error."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(fs_path) or []
    paths = [str(x.getPath()) for x in found]
    if len(paths) != 1:
        raise FileNotFoundError(f"{len(paths)} files match {pattern}")
    return paths[0]


def result_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """model, dataset, timestamp, fingerprint, results (JSON), path of result files; payloads without model, dataset or results are ignored."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path).select("value", F.col("_metadata.file_path").alias("path"))
    get = lambda k: F.get_json_object("value", f"$.{k}")
    rows = files.select(get("model").alias("model"), get("dataset").alias("dataset"), get("timestamp").alias("timestamp"), get("protocol_fingerprint").alias("fingerprint"), get("results").alias("results"), "path")
    return rows.where("model is not null and dataset is not null and results is not null")


def log_history(spark: SparkSession, path: str) -> DataFrame:
    """step and the entry (JSON) of a trainer state's log_history."""
    files = spark.read.option("wholetext", True).text(path)
    entries = F.explode(F.from_json(F.get_json_object("value", "$.log_history"), "array<string>")).alias("entry")
    return files.select(entries).select(F.get_json_object("entry", "$.step").try_cast("bigint").alias("step"), "entry")


def manifest(settings: dict, versions: dict, created: str, revision: str | None = None, dirty: bool | None = None, device: dict | None = None) -> str:
    """A run manifest as canonical JSON: the configuration, the code's revision and whether it has local changes, packages, the device."""
    body = {"config": settings, "packages": versions, "created_at_utc": created, "git_revision": revision, "git_dirty": dirty, "device": device or {"available": False}}
    return json.dumps(body, sort_keys=True, ensure_ascii=False)


def code_state(folder: str) -> tuple:
    """(revision, dirty) of a checkout; (None, None) where there is none."""
    import subprocess

    ask = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True).stdout.strip()
    try:
        return ask("rev-parse", "HEAD"), bool(ask("status", "--porcelain"))
    except (OSError, subprocess.CalledProcessError):
        return None, None


def package_versions(names: list) -> dict:
    from importlib import metadata

    out = {}
    for name in names:
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            out[name] = "not-installed"
    return out


def config(path: str, sections: tuple = ()) -> dict:
    """A YAML configuration of the driver; a missing section is an error."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    missing = [s for s in sections if s not in found]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    return found


def statistics_json(paired: DataFrame, singles: dict, settings: dict, values: dict) -> str:
    """The record of a significance run: settings, each metric's paired figures, each model's own intervals, and the values behind them by topic.

    paired and singles hold one row a metric (operators.significance); singles and values name the models, values' rows are (metric, topic, value)."""
    def figures(df, names):
        return {r["metric"]: {out: r[c] for c, out in names.items() if c in r.asDict()} | {"bootstrap_95_ci": [r["low"], r["high"]]} for r in df.collect()}

    def by_topic(df):
        found = {}
        for r in df.collect():
            found.setdefault(str(r["topic"]), {})[r["metric"]] = r["value"]
        return found

    both = {"n": "n_topics", "mean_a": "model_a_mean", "mean_b": "model_b_mean", "mean": "difference_a_minus_b", "p": "paired_sign_flip_p_two_sided", "topics": "topic_ids"}
    own = {"n": "n_topics", "mean": "mean", "p": "sign_flip_p_two_sided_vs_zero"}
    return json.dumps({**settings, "difference_direction": "model_a - model_b", "metrics": figures(paired, both),
                       "individual_intervals": {name: figures(df, own) for name, df in singles.items()},
                       "per_topic": {name: by_topic(df) for name, df in values.items()}}, ensure_ascii=False, sort_keys=True)


def write_run(run: DataFrame, path: str) -> None:
    """A run (model, task, qid, docid, score), a folder for each model and task."""
    run.write.mode("overwrite").partitionBy("model", "task").parquet(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """qid, docid of candidate or changed-document lists {qid: [docid, ...]}, as JSON lines; ids are text."""
    rows = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("qid", "docids"))
    return rows.select("qid", F.explode("docids").alias("docid")).distinct()


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """qid, docid, rel of nested judgements {qid: {docid: score}}, as JSON lines; scores are whole numbers."""
    rows = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,map<string,int>>")).alias("qid", "d"))
    return rows.select("qid", F.explode("d").alias("docid", "rel"))


def test_files(spark: SparkSession, root: str) -> tuple:
    """(corpus, rows) of the test split alone: two files' columns are read, the training shards are not opened."""
    from ..functions.schemas import CORPUS

    return spark.read.schema(CORPUS).parquet(f"{root}/test_corpus"), training_split(spark, root, "test")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("qid string, docid string, score double, model string, task string").parquet(path)


def store_result(spark: SparkSession, path: str, model: str, dataset: str, results: dict, fingerprint: str, protocol: dict, stamp: str) -> None:
    """Appends one result document to the results table; what is not JSON is stored as its text."""
    from ..operators.results import canonical

    body = canonical({"model": model, "dataset": dataset, "timestamp": stamp, "protocol_fingerprint": fingerprint, "protocol": protocol, "results": results})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("append").option("lineSep", "\n").text(path)


def first_of_files(rows: DataFrame, most: int, done: int = 0) -> DataFrame:
    """Rows done + 1 .. done + most of each file (rows carry file and line)."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    return rows.withColumn("_n", n).where((F.col("_n") > done) & (F.col("_n") <= done + most)).drop("_n")
