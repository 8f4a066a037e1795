"""Boundaries to language models and encoders: pluggable functions over Arrow batches."""
import hashlib
import json
import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schemas import GENERATED

# What a failure of the connection says.
CONNECTION = ("Connection", "Errno")
# The fields of the two structured replies, and the kinds of error that a mined passage may have.
INSTRUCTION_FIELDS = ("rewritten_query", "rewritten_pos_doc", "rewritten_pos_title", "rewritten_neg_doc", "rewritten_neg_title", "reasoning", "instruction", "relevant_docs", "non_relevant_docs")
PASSAGE_FIELDS = ("matches_both", "error_type", "explanation", "title", "passage")
ERROR_TYPES = ("none", "different_interpretation", "omission", "mention_non_relevant_flag")


class Caller:
    """A client that is made when it is needed, with retries: waits double from `least` to `most` seconds; a connection error drops the client."""

    def __init__(self, client, attempts: int = 10, least: float = 5.0, most: float = 30.0, sleep=time.sleep):
        self.client, self.attempts, self.least, self.most, self.sleep, self.call = client, attempts, least, most, sleep, None

    def __call__(self, prompt, read=lambda reply: reply):
        """read(reply): a reply that cannot be read is a failure, too."""
        for i in range(self.attempts):
            try:
                if self.call is None:
                    self.call = self.client()
                return read(self.call(prompt))
            except Exception as e:  # any failure of the service is retried, then passed on
                if any(x in f"{type(e).__name__} {e}" for x in CONNECTION):
                    self.call = None
                if i + 1 == self.attempts:
                    raise
                self.sleep(min(self.most, max(self.least, 2.0**i)))


def generate(requests: DataFrame, client, attempts: int = 10, least: float = 5.0, most: float = 30.0, sleep=time.sleep) -> DataFrame:
    """query_id, status, error, response of requests (query_id, prompt): client() makes a function prompt -> text on the executor.

    Each request is tried `attempts` times, with waits between; one that fails every time is a row with status failed.
    """
    def run(frames):
        call = Caller(client, attempts, least, most, sleep)
        for frame in frames:
            out = []
            for qid, prompt in zip(frame["query_id"], frame["prompt"]):
                try:
                    out.append((qid, "success", None, call(prompt)))
                except Exception as e:
                    out.append((qid, "failed", f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(out, columns=["query_id", "status", "error", "response"])

    return requests.select("query_id", "prompt").mapInPandas(run, "query_id string, status string, error string, response string")


def read_instruction(reply: str) -> dict:
    """The first reply's fields; one that lacks a field is an error."""
    body = json.loads(reply)
    out = {f: body[f] for f in INSTRUCTION_FIELDS}
    out["relevant_docs"], out["non_relevant_docs"] = ([int(x) for x in out[f]] for f in ("relevant_docs", "non_relevant_docs"))
    return out


def read_passages(reply: str) -> dict:
    """The second reply's fields; a passage of another kind of error is an error."""
    body = json.loads(reply)
    docs = [{f: d[f] for f in PASSAGE_FIELDS} for d in body["documents"]]
    if any(d["error_type"] not in ERROR_TYPES or not isinstance(d["matches_both"], bool) for d in docs):
        raise ValueError("a passage's error type or match is not one of those known")
    return {"reasoning": body["reasoning"], "documents": docs}


def generated_records(samples: DataFrame, client, first, second, attempts: int = 10, least: float = 5.0, most: float = 30.0, sleep=time.sleep) -> DataFrame:
    """Generated records of enriched triples (qid, query, pos_id, pos_text, neg_id, neg_text): two chained calls.

    first(sample) is the prompt that rewrites the texts and writes the instruction; second(query, instruction) mines negatives for
    what the first has rewritten.  Both replies are JSON.  A failed record keeps its ids and says why.
    """
    def run(frames):
        call = Caller(client, attempts, least, most, sleep)
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                row = {"query_id": r["qid"], "original_query": r["query"], "original_positive_id": r["pos_id"], "original_negative_id": r["neg_id"], "status": "failed", "error": None,
                       "generated_instruction_text": None, "instruction": None, "mining": None}
                try:
                    one = call(first(r), read_instruction)
                    two = call(second(one["rewritten_query"], one["instruction"]), read_passages)
                    row |= {"status": "success", "generated_instruction_text": one["instruction"], "instruction": json.dumps(one, ensure_ascii=False), "mining": json.dumps(two, ensure_ascii=False)}
                except Exception as e:
                    row["error"] = str(e)
                out.append(row)
            yield pd.DataFrame(out, columns=list(row))

    flat = "query_id long, original_query string, original_positive_id long, original_negative_id long, status string, error string, generated_instruction_text string, instruction string, mining string"
    kinds = {f.name: f.dataType.simpleString() for f in samples.sparkSession.createDataFrame([], GENERATED).schema}
    rows = samples.select("qid", "query", "pos_id", "pos_text", "neg_id", "neg_text").mapInPandas(run, flat)
    return rows.select("query_id", "original_query", "original_positive_id", "original_negative_id", "status", "error", "generated_instruction_text",
                       F.from_json("instruction", kinds["instruction_data"]).alias("instruction_data"), F.from_json("mining", kinds["mining_data"]).alias("mining_data"))


def verdicts(rows: DataFrame, client, key: str = "record_id", **retries) -> DataFrame:
    """key, answer, reasoning, status of yes/no requests (key, prompt)."""
    from ..functions.text import parse_answer

    asked = generate(rows.select(F.col(key).cast("string").alias("query_id"), "prompt"), client, **retries)
    return asked.withColumn("_a", parse_answer(F.col("response"))).select(
        F.col("query_id").alias(key), "_a.answer", "_a.reasoning", F.when(F.col("status") == "failed", "error").otherwise(F.col("_a.status")).alias("status"))


def encoder(model, dims: int):
    """A pandas UDF text -> array<float>: model() makes a function list of texts -> matrix, once per worker."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(parts: "pd.Series") -> "pd.Series":
        call = model()
        return pd.Series(list(call(parts.fillna("").tolist())))

    return encode


def hashing_encoder(dims: int = 64):
    """A deterministic stand-in for an encoder: signed hashed words, at length 1."""
    def make():
        def call(texts):
            out = []
            for t in texts:
                v = [0.0] * dims
                for w in t.lower().split():
                    h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                    v[h % dims] += 1.0 if h >> 63 else -1.0
                n = sum(x * x for x in v) ** 0.5 or 1.0
                out.append([x / n for x in v])
            return out

        return call

    return make
