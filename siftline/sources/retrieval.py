"""Adapters from benchmark rows to corpus, queries and qrels, and the registry of loaders."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first(df: DataFrame, names, kind: str = "string"):
    there = [n for n in names if n in df.columns]
    if not there:
        raise ValueError(f"none of the columns {', '.join(names)}")
    return F.coalesce(*[F.col(f"`{n}`").cast(kind) for n in there])


def corpus(df: DataFrame) -> DataFrame:
    """docid, text, title from rows with _id, id, docid, doc_id or corpus-id."""
    title = F.coalesce(F.col("title").cast("string"), F.lit("")) if "title" in df.columns else F.lit("")
    return df.select(_first(df, ("_id", "id", "docid", "doc_id", "corpus-id")).alias("docid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), title.alias("title"))


def queries(df: DataFrame) -> DataFrame:
    return df.select(_first(df, ("_id", "id", "query_id", "query-id", "qid", "item_id")).alias("qid"), _first(df, ("text", "query")).alias("text"))


def qrels(df: DataFrame, order: str | None = None) -> DataFrame:
    """qid, docid, rel; the score is 1 where there is none; the last of a repeated pair wins (by `order`, else the greatest)."""
    rel = _first(df, ("score", "rel", "relevance"), "double").cast("int") if {"score", "rel", "relevance"} & set(df.columns) else F.lit(1)
    rows = df.select(_first(df, ("query-id", "query_id", "qid")).alias("qid"), _first(df, ("corpus-id", "corpus_id", "docid", "doc_id")).alias("docid"), F.coalesce(rel, F.lit(1)).alias("rel"),
                     (F.col(order) if order else F.lit(0)).alias("_o"))
    return rows.groupBy("qid", "docid").agg(F.max_by("rel", F.struct("_o", "rel")).alias("rel"))


LOADERS: dict = {}


def loader(kind: str):
    """Registers a loader of (corpus, queries, qrels) for a dataset type."""
    def put(f):
        LOADERS[kind] = f
        return f

    return put


def load(kind: str, *args, revision: str | None = None, pinned: bool = False):
    if kind not in LOADERS:
        raise ValueError(f"unknown dataset type {kind}")
    if pinned and not (revision and len(revision) == 40 and all(c in "0123456789abcdef" for c in revision)):
        raise ValueError("the dataset type needs an immutable revision")
    return LOADERS[kind](*args)


KINDS = ("corpus", "queries", "qrels")
# The columns that a benchmark's JSON lines may have.
_COLUMNS = {"corpus": "_id id docid doc_id corpus-id title text", "queries": "_id id query_id query-id qid item_id text query",
            "qrels": "query-id query_id qid corpus-id corpus_id docid doc_id score rel relevance"}


def _inside(spark, path: str) -> list:
    """The folders in a folder, by name."""
    from .files import _fs

    at, fs = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def task_subsets(spark, root: str, split: str = "test") -> dict:
    """{subset: {kind: path}} of a task's folder, in any of three layouts: <kind>/<split> (one subset without a name), <kind>/<subset>/<split>
    and <subset>/<split>/<kind>; another layout, or a split that no subset has, is an error."""
    there = _inside(spark, root)
    if set(KINDS) <= set(there):
        inner = _inside(spark, f"{root}/corpus")
        if split in inner:
            return {"": {k: f"{root}/{k}/{split}" for k in KINDS}}
        found = {s: {k: f"{root}/{k}/{s}/{split}" for k in KINDS} for s in inner if all(split in _inside(spark, f"{root}/{k}/{s}") for k in KINDS)}
        if not found:
            raise ValueError(f"no split {split} in {root}")
        return found
    found = {s: {k: f"{root}/{s}/{split}/{k}" for k in KINDS} for s in there if set(KINDS) <= set(_inside(spark, f"{root}/{s}/{split}"))}
    if not found:
        raise ValueError(f"no layout of a task in {root}")
    return found


def _read(spark, path: str, kind: str) -> DataFrame:
    from .files import listed

    if any(n.endswith(".jsonl") for n in listed(spark, path)):
        return spark.read.schema(", ".join(f"`{c}` string" for c in _COLUMNS[kind].split())).option("mode", "FAILFAST").json(path)
    return spark.read.parquet(path)


def task_tables(spark, root: str, split: str = "test", subset: str | None = None) -> tuple:
    """(corpus, queries, qrels) of one subset of a task's folder; without a name, of the only one.  Tables are Parquet or JSON lines (*.jsonl)."""
    found = task_subsets(spark, root, split)
    if subset is None and len(found) > 1:
        raise ValueError(f"a subset of {', '.join(found)} has to be named for {root}")
    (subset,) = select_names(list(found), [subset]) if subset is not None else found
    paths = found[subset]
    return corpus(_read(spark, paths["corpus"], "corpus")), queries(_read(spark, paths["queries"], "queries")), qrels(_read(spark, paths["qrels"], "qrels"))


def _tasks(spark, root: str, config: dict) -> dict:
    """Tables of the named tasks, each a folder below root, in the order of the folders; all of them where none is named.

    A task of several subsets gives an entry <task>/<subset> for each, or for those of config["subsets"]; unknown names are errors."""
    folders, out = _inside(spark, root), {}
    asked = config.get("subsets")
    for name in select_names(folders, config.get("task_names") or folders):
        subsets = list(task_subsets(spark, f"{root}/{name}"))
        for s in subsets if asked is None or subsets == [""] else select_names(subsets, [x for x in asked if x in subsets] or asked):
            out[f"{name}/{s}" if len(subsets) > 1 else name] = task_tables(spark, f"{root}/{name}", subset=s)
    return out


@loader("rumteb")
def _plain(spark, root: str, config: dict) -> dict:
    return _tasks(spark, root, config)


@loader("en_mteb")
def _plain_english(spark, root: str, config: dict) -> dict:
    return _tasks(spark, root, config)


@loader("mfollowir")
def _reranking(spark, root: str, config: dict) -> dict:
    """The reranking task, with its candidate lists and changed documents; a revision other than the stored one is an error."""
    from .files import candidates

    stored = spark.read.text(f"{root}/revision").first()
    if config.get("revision") and (stored is None or stored.value.strip() != config["revision"]):
        raise ValueError(f"the configured revision {config['revision']} is not the stored one")
    return {"mfollowir": (*task_tables(spark, root), candidates(spark, f"{root}/candidates"), candidates(spark, f"{root}/qrel_diff"))}


@loader("synthetic_test")
def _synthetic(spark, root: str, config: dict) -> dict:
    """The paired test set from its two files: corpus, queries of all rows, derived judgements; without pairs or negatives it is an error."""
    from ..operators.ranking import checked_pairs, derive_qrels
    from .files import test_files

    check_fields(config, ("data_path", "revision", "instruction_negative_field"))
    docs, rows = test_files(spark, root)
    ids = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda p: p["docid"])
    flat = rows.select("query_id", "query", "only_instruction", ids("positive_passages").alias("positives"), ids(config["instruction_negative_field"]).alias("new_negatives"))
    checked_pairs(flat)
    return {"synthetic_test": (corpus(docs), flat.select(F.col("query_id").alias("qid"), F.col("query").alias("text")), derive_qrels(flat))}


RETRIEVERS: dict = {}


def retriever(kind: str):
    """Registers a retriever (queries, corpus, k) -> run."""
    def put(f):
        RETRIEVERS[kind] = f
        return f

    return put


@retriever("bm25")
def _bm25(q: DataFrame, c: DataFrame, k: int, **settings) -> DataFrame:
    """Title and text, stemmed; the stop words are the settings'."""
    from ..functions.text import passage
    from ..operators.bm25 import best, index

    docs = c.select("docid", passage(F.col("title"), F.col("text"), " ").alias("text"))
    return best(q, index(docs, [q], settings.get("stopwords", ()), settings.get("stem", True)), k)


@retriever("dense")
def _dense(q: DataFrame, c: DataFrame, k: int, **_) -> DataFrame:
    from ..operators.dense import topk

    return topk(q, c, k, without_self=False)


def _encoded(kind: str):
    """A retriever that encodes queries (qid, text) and passages (docid, text, title) as the model type formats them, then searches."""
    def run(q: DataFrame, c: DataFrame, k: int, encode=None, query_prefix: str = "", passage_prefix: str = "", instruction: str = "", dataset_type: str = "", separator: str = ". ", **_) -> DataFrame:
        from ..functions.text import instructed_query, passage, plain_prefix, prefixed
        from ..operators.dense import topk

        if encode is None:
            raise ValueError(f"the retriever {kind} needs an encoder")
        put = prefixed if kind == "causal_lm" else plain_prefix  # causal models strip, encoders do not
        text = instructed_query(F.col("text"), kind, dataset_type, instruction)
        asked = q.select("qid", encode(put(text, F.lit("query"), query_prefix, passage_prefix)).alias("v"))
        docs = c.select("docid", encode(put(passage(F.col("title"), F.col("text"), separator), F.lit("passage"), query_prefix, passage_prefix)).alias("v"))
        return topk(asked, docs, k, without_self=False)

    return run


for _kind in ("encoder", "causal_lm", "qwen3_embedding", "giga_embedding"):
    RETRIEVERS[_kind] = _encoded(_kind)


def retrieve(kind: str, q: DataFrame, c: DataFrame, k: int, **settings) -> DataFrame:
    if kind not in RETRIEVERS:
        raise ValueError(f"unknown retriever {kind}")
    return RETRIEVERS[kind](q, c, k, **settings)


def select_names(known: list, asked: list) -> list:
    """The asked names in the known order; unknown names are an error."""
    unknown = sorted(set(asked) - set(known))
    if unknown:
        raise ValueError(f"unknown: {', '.join(unknown)}; known: {', '.join(sorted(known))}")
    return [k for k in known if k in set(asked)]


def check_mix(kinds: list, instructed: tuple = ("synthetic_test", "instruction")) -> None:
    """Instruction tasks and plain tasks do not share a run."""
    sides = {k in instructed for k in kinds}
    if len(sides) > 1:
        raise ValueError("instruction tasks and plain tasks cannot be mixed")


def check_fields(config: dict, required: tuple) -> dict:
    """A configuration section with its required fields, or an error that names what is missing."""
    missing = [k for k in required if config.get(k) in (None, "", [], {})]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    return config
