"""Dense retrieval: exact top-k by dot product, over all documents in blocks of queries, or over an index of groups around pivots."""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: queries of one broadcast block (an index, whose results are few, takes WIDE of them at once); its bytes are bounded by this times the dimension
BLOCK = 8192
WIDE = 4
#: scores that a task computes at once
CELLS = 1 << 20
#: an index's pivots come from a sample of so many documents at most; all documents are indexed
SAMPLE = 20_000
GROUPS = 1024
#: documents of an index's group, on average, while GROUPS allows it
MEMBERS = 64
#: a query's first groups hold so many documents for each of the k results
FIRST = 4


def _rows(col) -> np.ndarray:
    """A list column of one length, without nulls, as a matrix over its flat buffer."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def _ids(col) -> np.ndarray:
    """Ids as numbers, or as text of a fixed width, which sorts as text."""
    ids = col.to_numpy(zero_copy_only=False) if isinstance(col, pa.Array) else col.to_numpy()
    return np.array(ids.tolist(), str) if ids.dtype == object else ids


class Held:
    """The k best documents of every query so far, ties by the least id.

    Scores that a query's k-th rules out are dropped where they are computed; the others are gathered and sorted in from time to time.
    """

    def __init__(self, n: int, k: int, digits: int, floor: np.ndarray | None = None):
        self.k, self.digits, self.floor = k, digits, np.full(n, -np.inf) if floor is None else floor.copy()
        self.rows, self.gathered, self.most = [], 0, max(n * k, CELLS // 4)

    def add(self, asked: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """The documents of some queries (their numbers and vectors)."""
        if not self.rows and len(v) > 2 * self.k and np.isneginf(self.floor[asked]).all():  # a floor to begin with, by partial selection
            few = v[: 8 * self.k]
            for i in range(0, len(asked), max(1, CELLS // len(few))):
                some = slice(i, i + max(1, CELLS // len(few)))
                self.floor[asked[some]] = -np.partition(-np.round(q[some] @ few.T, self.digits), self.k - 1, axis=1)[:, self.k - 1]
            self.floor[np.isnan(self.floor)] = -np.inf
        step = max(1, CELLS // max(1, len(asked)))
        for a in range(0, len(v), step):
            sims = q @ v[a : a + step].T
            # what is under the floor by more than the rounding; not a number sorts last, but counts
            row, at = np.nonzero(~(sims < (self.floor[asked] - 10.0 ** -self.digits)[:, None]))
            if len(row):
                score = np.round(sims[row, at], self.digits)
                self.rows.append((asked[row].astype(np.int32), ids[a + at], score))
                self.gathered += len(row)
                if self.gathered > self.most:
                    self._merge()

    def _merge(self) -> None:
        row, ids, score = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < self.k
        row, ids, score = row[keep], ids[keep], score[keep]
        ends = np.flatnonzero(np.append(row[1:] != row[:-1], True))
        full = ends[np.diff(np.append(-1, ends)) == self.k]
        self.floor[row[full]] = np.fmax(self.floor[row[full]], score[full])
        self.rows, self.gathered = [(row, ids, score)], 0

    def batch(self, qids: np.ndarray):
        """The rows (qid, docid, score), or None."""
        if not self.rows:
            return None
        self._merge()
        row, ids, score = self.rows[0]
        return pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids), pa.array(score)], ["qid", "docid", "score"])


def _best(shared, k: int, digits: int):
    """The best k of every query among a task's documents, so that k rows a query and task are shuffled."""

    def run(batches):
        qids, q = shared.value
        held, every = Held(len(qids), k, digits), np.arange(len(qids))
        for batch in batches:
            if batch.num_rows:
                held.add(every, q, _ids(batch.column(0)), _rows(batch.column(1)))
        out = held.batch(qids)
        if out is not None:
            yield out

    return run


def _schema(queries: DataFrame, corpus: DataFrame) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"qid {kind(queries, 'qid')}, docid {kind(corpus, 'docid')}, score double"


def _in_blocks(queries: DataFrame, search, schema: str, blocks: int) -> DataFrame:
    """The union of search(qids, matrix) over so many blocks of queries (qid, v)."""
    rows = None
    for i in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        block = block.toArrow()
        if block.num_rows:
            found = search(_ids(block["qid"]), _rows(block["v"]))
            rows = found if rows is None else rows.unionByName(found)
    return queries.sparkSession.createDataFrame([], schema) if rows is None else rows


def _ranked(rows: DataFrame, k: int, without_self: bool) -> DataFrame:
    rows = rows.where("qid <> docid") if without_self else rows
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "docid")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk(queries: DataFrame, corpus: DataFrame, k: int, dims: int | None = None, digits: int = 6, without_self: bool = True) -> DataFrame:
    """qid, docid, score, rank: the k documents (docid, v) nearest to each query (qid, v), ties by docid; ids are numbers or text.

    Queries are broadcast in blocks of some BLOCK; a block's documents are scored as matrix products in every task.  The more blocks
    there are, the fewer tasks share the documents of each, as every task hands on k rows a query.
    """
    spark = queries.sparkSession
    cut = (lambda c: F.slice(c, 1, dims)) if dims else F.col
    corpus, queries = corpus.select("docid", cut("v").alias("v")), queries.select("qid", cut("v").alias("v"))
    schema, depth = _schema(queries, corpus), k + bool(without_self)
    n, cores = queries.count(), spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // BLOCK), min(2 * cores, n // (BLOCK // 8)) if BLOCK >= 8 else 1)
    tasks = max(1, min(max(2, -(-2 * cores // blocks)), -(-corpus.count() // BLOCK)))
    found = corpus.rdd.getNumPartitions()
    corpus = corpus.coalesce(tasks) if found > tasks else corpus.repartition(tasks) if found < tasks else corpus
    rows = _in_blocks(queries, lambda qids, q: corpus.mapInArrow(_best(spark.sparkContext.broadcast((qids, q)), depth, digits), schema), schema, blocks)
    return _ranked(rows, k, without_self)


# ---- an index whose groups can be passed over


@dataclass
class Index:
    """Groups of documents around pivots.  members: a written table (group, docid, v) in the order of the groups; pivots, and each
    group's radius (the greatest distance of a member from its pivot) and number of members; at most GROUPS groups."""

    members: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray


def _nearest(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots * pivots).sum(1) / 2 - v @ pivots.T).argmin(1)


def pivots_of(v: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """n means of a sample, by a few rounds of k-means."""
    c = v[np.sort(np.random.default_rng(11).choice(len(v), min(n, len(v)), replace=False))]
    for _ in range(rounds):
        near = _nearest(v, c)
        sums, count = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, v)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


def _grouped(shared):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _rows(batch.column(1))
                near = _nearest(v, shared.value)
                far = np.sqrt(((v - shared.value[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), *batch.columns, pa.array(far)], ["group", "docid", "v", "far"])

    return run


def index(corpus: DataFrame, groups: int | None = None) -> Index:
    """An index of the documents (docid, v), vectors of one length without nulls."""
    spark, corpus = corpus.sparkSession, corpus.select("docid", F.col("v").cast("array<double>").alias("v"))
    n = corpus.count()
    if not n:
        return Index(corpus.select(F.lit(0).alias("group"), "docid", "v"), np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64))
    sample = _rows(corpus.orderBy(F.xxhash64("docid")).limit(SAMPLE).select("v").toArrow()["v"])
    pivots = pivots_of(sample, groups or max(1, min(GROUPS, n // MEMBERS)))
    kind = corpus.schema["docid"].dataType.simpleString()
    rows = corpus.mapInArrow(_grouped(spark.sparkContext.broadcast(pivots)), f"group int, docid {kind}, v array<double>, far double")
    # ranges end in the id, so that a large group is not one task's
    members = written(rows.repartitionByRange("group", "docid").sortWithinPartitions("group", "docid"))
    found = members.groupBy("group").agg(F.max("far").alias("far"), F.count("*").alias("n")).toArrow()  # a row a group
    radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    radius[found["group"].to_numpy()], size[found["group"].to_numpy()] = found["far"].to_numpy(), found["n"].to_numpy()
    return Index(members.drop("far"), pivots, radius, size)


def _best_of_groups(shared, k: int, digits: int):
    """The best k of every query among a task's documents of the groups that the query visits."""

    def run(batches):
        qids, q, visits, floor = shared.value
        held = Held(len(qids), k, digits, floor)
        for batch in batches:
            if not batch.num_rows:
                continue
            group, ids, v = batch.column(0).to_numpy(), _ids(batch.column(1)), _rows(batch.column(2))
            cuts = np.flatnonzero(np.diff(group)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)]):
                asked = np.flatnonzero(visits[group[a]])
                for i in range(0, len(asked), BLOCK):
                    some = asked[i : i + BLOCK]
                    held.add(some, q[some], ids[a:b], v[a:b])
        out = held.batch(qids)
        if out is not None:
            yield out

    return run


def first_groups(bounds: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """(query, group): the groups of the greatest bounds that together hold FIRST * k documents."""
    order = np.argsort(-bounds, axis=1, kind="stable")
    held = np.cumsum(size[order], axis=1)
    out = np.zeros(bounds.shape, bool)
    np.put_along_axis(out, order, np.hstack([np.ones((len(order), 1), bool), held[:, :-1] < FIRST * k]), 1)
    return out & (size > 0)


def search(queries: DataFrame, at: Index, k: int, digits: int = 6, without_self: bool = True, report: dict | None = None) -> DataFrame:
    """topk()'s rows, by an index: a query's nearest groups give it a floor under its k-th score, and a group whose bound, the pivot's
    product and the radius times the query's length, is under the floor is not compared with it.

    report, if given, gets `compared` and `skipped`: pairs of a query and a document."""
    spark, queries = queries.sparkSession, queries.select("qid", F.col("v").cast("array<double>").alias("v"))
    schema, depth = _schema(queries, at.members), k + bool(without_self)
    count = {"compared": 0, "skipped": 0}

    def scan(qids, q, visits, floor=None):
        groups = np.flatnonzero(visits.any(0)).tolist()  # at most GROUPS numbers
        rows = at.members.where(F.col("group").isin(groups))
        return rows.mapInArrow(_best_of_groups(spark.sparkContext.broadcast((qids, q, visits.T.copy(), floor)), depth, digits), schema)

    def block(qids, q):
        if not len(at.size):
            return spark.createDataFrame([], schema)
        # a slice of queries at a time: a number a query and group
        parts = [slice(i, i + BLOCK // 4 + 1) for i in range(0, len(q), BLOCK // 4 + 1)]
        bound = lambda p: q[p] @ at.pivots.T + np.sqrt((q[p] * q[p]).sum(1))[:, None] * at.radius
        first = np.concatenate([first_groups(bound(p), at.size, depth) for p in parts])
        begun = written(scan(qids, q, first))
        w = Window.partitionBy("qid").orderBy(F.desc("score"))
        kth = begun.withColumn("n", F.row_number().over(w)).where(F.col("n") <= depth).groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == depth)
        kth = kth.toArrow()  # a row for each query of the block
        floor = np.full(len(qids), -np.inf)
        order = np.argsort(qids)
        floor[order[np.searchsorted(qids[order], _ids(kth["qid"]))]] = kth["floor"].to_numpy()
        second = np.zeros_like(first)
        for p in parts:
            bounds = bound(p)
            slack = 10.0 ** -digits + 1e-9 * np.abs(bounds)
            second[p] = (bounds + slack >= floor[p, None]) & ~first[p] & (at.size > 0)
        compared = int(((first | second).sum(0) * at.size).sum())
        count["compared"] += compared
        count["skipped"] += len(qids) * int(at.size.sum()) - compared
        return begun.unionByName(scan(qids, q, second, floor))

    rows = _in_blocks(queries, block, schema, max(1, -(-queries.count() // (WIDE * BLOCK))))
    if report is not None:
        report.update(count)
    return _ranked(rows, k, without_self)
