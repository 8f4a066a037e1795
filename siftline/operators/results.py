"""Result documents: flattening, names, fingerprints, cache, tables."""
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# Keys of a result document that hold no metric, and keys that only nest.
METADATA = ["hf_subset", "languages", "dataset_revision", "evaluation_time", "main_score"]
STRUCTURE = ["scores", "test", "default", "mteb"]


@udtf(returnType="name: string, value: double")
class FlattenMetrics:
    """Numbers of a nested JSON document under dotted names; a later name replaces an earlier one, true is 1.

    Lists of task results start anew under the task's name; other lists nest without a name.
    """

    def eval(self, document: str):
        found: dict = {}
        todo = [("", json.loads(document))] if document else []
        while todo:
            prefix, node = todo.pop()
            inner = []
            if isinstance(node, list):
                tasks = bool(node) and isinstance(node[0], dict) and "task_name" in node[0]
                inner = [(x.get("task_name", "mteb"), x.get("scores", {})) if tasks else (prefix, x) for x in node if isinstance(x, (dict, list))]
            else:
                for key, value in node.items():
                    nests = isinstance(value, (dict, list))
                    name = prefix if nests and key in STRUCTURE else ".".join(x for x in (prefix, key) if x)
                    if key in METADATA:
                        continue
                    if nests:
                        inner.append((name, value))
                    elif isinstance(value, (int, float)):
                        inner.append((name, value))
            for item in reversed(inner):
                todo.append(item)
            while todo and isinstance(todo[-1][1], (int, float)):
                name, value = todo.pop()
                found[name] = float(value)
        yield from found.items()


def metric_name(c: Column) -> Column:
    """A last part p-MRR is p_mrr; ndcg_at_k and map_at_k are cut names."""
    c = F.regexp_replace(c, "(^|\\.)p-MRR$", "$1p_mrr")
    return F.regexp_replace(c, "(ndcg|map)_at_", "$1_cut_")


def shown(name: Column, value: Column) -> Column:
    """A metric as printed: p_mrr times 100 with two decimals, others with four."""
    return F.when(name.endswith("p_mrr"), F.format_string("%.2f", value * 100)).otherwise(F.format_string("%.4f", value))


def displayed(name: Column) -> Column:
    """Names that a table shows: not nauc_..., precision or recall."""
    return ~name.startswith("nauc_") & ~name.contains("precision") & ~name.contains("recall")


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(value) -> str:
    """SHA-256 of the canonical JSON of a driver-side document."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


# The settings of a configuration that decide a result.
GLOBAL_KEYS = ("device", "dtype", "generic_instruction", "retrieval_top_k")


def protocol(settings: dict, model: dict, dataset: dict, revision: str, keys=GLOBAL_KEYS) -> dict:
    """The part of a configuration that decides a result."""
    return {"code_revision": revision, "global": {k: settings.get(k) for k in keys}, "model": model, "dataset": dataset}


def protocol_column(settings: dict, model: Column, dataset: Column, revision: str, keys=GLOBAL_KEYS) -> Column:
    """fingerprint(protocol(...)) of models and datasets that are structs with their fields in sorted order, for a table of requests."""
    own = F.struct(*[F.lit(settings.get(k)).alias(k) for k in sorted(keys)])
    body = F.struct(F.lit(revision).alias("code_revision"), dataset.alias("dataset"), own.alias("global"), model.alias("model"))
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def fingerprints(df: DataFrame, *fields: str) -> Column:
    """SHA-256 of the canonical JSON of columns: fields in sorted order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def cached(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests with the newest stored path of the same fingerprint, and whether there is one."""
    newest = stored.groupBy("fingerprint").agg(F.max_by("path", "path").alias("path"))
    return requests.join(newest, "fingerprint", "left").withColumn("hit", F.col("path").isNotNull())


def latest_checkpoint(paths: DataFrame) -> DataFrame:
    """The path with the greatest numeric suffix."""
    n = F.regexp_extract("path", "-(\\d+)$", 1).try_cast("int")
    return paths.withColumn("step", n).where("step is not null").agg(F.max_by("path", "step").alias("path"), F.max("step").alias("step"))


def summary(metrics: DataFrame, key_metrics: list) -> DataFrame:
    """Rows (model, dataset, metric, value) in print order: key metrics first, then by name."""
    rank = F.coalesce(*[F.when(F.col("metric") == m, F.lit(i)) for i, m in enumerate(key_metrics)], F.lit(len(key_metrics)))
    return metrics.where(displayed(F.col("metric"))).withColumns({"key_rank": rank, "shown": shown(F.col("metric"), F.col("value"))})


def concurrency(ts: Column, zone: str = "Europe/Moscow") -> Column:
    """The request cap at a UTC time, by local time: 9 from Friday 18:00 to Monday 7:00, else 3 from 8:00 to 19:00, else 6."""
    local = F.from_utc_timestamp(ts, zone)
    day, hour = F.weekday(local), F.hour(local)
    weekend = day.isin(5, 6) | ((day == 4) & (hour >= 18)) | ((day == 0) & (hour < 7))
    return F.when(weekend, 9).when(hour.between(8, 18), 3).otherwise(6)
