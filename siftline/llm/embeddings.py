"""Embedding near-dedup over a robust-pruned flat graph.

Distinct vectors are dealt to their nearest few of K centroids, so that shards
overlap; a shard that is still large is dealt to centroids of its own, again and
again.  Every shard builds a robust-pruned graph of its vectors; the adjacency lists of
a vector are united over its shards.  A shard is then searched with its own vectors as
queries over its vectors and the neighbours that the united lists lead to: a greedy
beam search from the shard's medoid, after which every vector found in range is
expanded until nothing new comes into range.  Links are verified by their cosine in
double precision.

A pair of vectors belongs to one shard: of the shards that both are members of, that of
the least hash; if there is none, the nearest shard of the one of the lower number.  A
link is a pair that its own shard finds from either end, and both ends count it there.
So what leaves a shard is linear in its vectors, however many links they have: a number
of links for each vector, to be added up over the shards, and a spanning forest.

Queries drawn without regard to what was found, more of them until LINKED have a link
(at most MOST_QUERIES), are compared against all vectors to audit the recall, which is
logged and can be had from near_duplicates(..., report); below TARGET the search runs
again, wider, and after the last round all vectors are compared with all, block by
block.

Equal vectors form one class: classes are searched, and links are counted for their
members.  Vectors of different lengths never share a shard.  Vectors that are null,
empty, zero, or hold null or non-finite components, link with nothing.  Rows that share
a vec_id are separate vectors; a null vec_id cannot be named: it is returned, unlinked.

K centroids of a length come from a sample of at most SAMPLE vectors; all vectors are
indexed.  Large shards are dealt on until all are small or dealing does not help any more.
Queries are searched in blocks of at most CELLS query-vector pairs, and neighbours are
looked at CELLS at a time.
"""
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, grouped, longs, parts, table, trimmed, written
from .components import components

COSINE = 0.95
SAMPLE = 20_000
SHARD = 1200
#: shards of one round of dealing; a shard of more than LARGE vectors is dealt on
MOST_SHARDS = 4096
LARGE = 6 * SHARD
DEGREE = 24
POOL = 64
ALPHA = 1.2
BEAM = 24
OVERLAP = 2
BLOCK = 1024
#: (query, vector) pairs of a shard that are held at once
CELLS = 1 << 21
SLACK = 0.12
QUERIES = 200
MOST_QUERIES = 4096
LINKED = 50
TARGET = 0.97

_LOG = logging.getLogger(__name__)


def unit_vectors(lists: pa.Array, named: np.ndarray) -> list:
    """The vectors fit for comparison as bytes of doubles of length 1, None for the others; named: rows that count at all."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    out = [None] * len(lists)
    if not len(lists):
        return out
    offs = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values
    whole = values.is_valid().to_numpy(zero_copy_only=False)
    flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) if len(values) else np.zeros(0)
    sizes = np.diff(offs)
    fit = lists.is_valid().to_numpy(zero_copy_only=False) & named & (sizes > 0)
    for d in np.unique(sizes[fit]).tolist():
        rows = np.flatnonzero(fit & (sizes == d))
        at = offs[rows][:, None] + np.arange(d)
        v = flat[at]
        ok = whole[at].all(1) & np.isfinite(v).all(1)
        top = np.where(ok, np.abs(np.where(np.isfinite(v), v, 0)).max(1), 0)
        rows, v, top = rows[top > 0], v[top > 0], top[top > 0]
        v = v / top[:, None]  # else lengths over- or underflow
        v = v / np.sqrt((v * v).sum(1))[:, None] + 0.0
        for i, x in zip(rows.tolist(), v):
            out[i] = x.tobytes()
    return out


def _units(batches):
    for batch in trimmed(batches):
        ids = column(batch, "vec_id")
        v = unit_vectors(column(batch, "embedding"), ids.is_valid().to_numpy(zero_copy_only=False))
        dims = pa.array([None if x is None else len(x) // 8 for x in v], pa.int32())
        yield pa.RecordBatch.from_arrays([ids, dims, pa.array(v, pa.binary())], ["vec_id", "dim", "v"])


def _matrix(col) -> np.ndarray:
    rows = col.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def _by_dim(batches):
    """(dim, batch) of rows of one length each."""
    for batch in trimmed(batches):
        if not batch.num_rows:
            continue
        dims = longs(batch, "dim")
        for d in np.unique(dims).tolist():
            yield d, batch.filter(pa.array(dims == d))


def centroids_of(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(7)
    c = vectors[np.sort(rng.choice(len(vectors), min(k, len(vectors)), replace=False))]
    for _ in range(rounds):
        near = np.concatenate([(vectors[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(vectors), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, vectors)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where((norm > 0)[:, None], sums / np.maximum(norm, 1e-12)[:, None], c)
    return c


def _nearest(v: np.ndarray, c: np.ndarray, overlap: int) -> np.ndarray:
    """The nearest few centroids of each vector, the nearest first."""
    t = min(overlap, len(c))
    sims = v @ c.T
    near = np.argpartition(-sims, t - 1, axis=1)[:, :t]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)


_MEMBER = "shard string, id long, copies long, v binary, home boolean"


def _members(shards: list, batch, home: np.ndarray, take: np.ndarray):
    kept = [column(batch, c).take(pa.array(take)) for c in ("id", "copies", "v")]
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.string()), *kept, pa.array(home)], ["shard", "id", "copies", "v", "home"])


def _assign(shared, overlap: int):
    """Members of the shards of the first round: a length's centroids, or one shard for a length without any."""

    def run(batches):
        centroids = shared.value
        for d, batch in _by_dim(batches):
            n = batch.num_rows
            near = _nearest(_matrix(column(batch, "v")), centroids[d], overlap) if d in centroids else np.zeros((n, 1), int)
            t = near.shape[1]
            yield _members([f"{d}/{x}" for x in near.ravel().tolist()], batch, np.tile(np.arange(t) == 0, n), np.repeat(np.arange(n), t))

    return run


def _split_centroids(batches):
    """Centroids of large shards from a drawn part of their vectors."""
    for shard, held in grouped_text(batches, "shard"):
        v = np.concatenate([_matrix(column(b, "v")) for b in held])
        k = int(longs(held[0], "k")[0])
        c = centroids_of(v, k)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.string()), pa.array([c.shape[0]], pa.int64()), pa.array([c.tobytes()], pa.binary())], ["shard", "k", "c"])


def _assign_again(overlap: int):
    """Members of large shards (with their centroids) dealt on; a vector stays at home where it was."""

    def run(batches):
        for batch in trimmed(batches):
            shards, cs = column(batch, "shard").to_pylist(), column(batch, "c")
            for shard in sorted(set(shards)):
                rows = np.flatnonzero(np.array([x == shard for x in shards]))
                part = batch.take(pa.array(rows))
                v = _matrix(column(part, "v"))
                near = _nearest(v, np.frombuffer(cs[int(rows[0])].as_py(), np.float64).reshape(-1, v.shape[1]), overlap)
                t = near.shape[1]
                home = column(part, "home").to_numpy(zero_copy_only=False)
                yield _members([f"{shard}/{x}" for x in near.ravel().tolist()], part, (home[:, None] & (np.arange(t) == 0)).ravel(), np.repeat(np.arange(len(v)), t))

    return run


def grouped_text(batches, key: str):
    """Whole groups of a stream that is sorted by a string key: (key, record batches)."""
    held, now = [], None
    for batch in trimmed(batches):
        keys = column(batch, key).to_pylist()
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if now is not None and keys[at] != now:
                yield now, held
                held = []
            now = keys[at]
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield now, held


def robust_prune(vectors: np.ndarray, pool: int, degree: int, alpha: float) -> list:
    """Out-neighbours of every vector: the nearest, then those that no chosen one is alpha times nearer to."""
    n = len(vectors)
    out = []
    p = min(pool, n - 1)
    if p <= 0:
        return [np.zeros(0, np.int64) for _ in range(n)]
    for lo in range(0, n, BLOCK):
        block = vectors[lo : lo + BLOCK]
        sims = block @ vectors.T
        sims[np.arange(len(block)), np.arange(lo, lo + len(block))] = -2
        cand = np.argpartition(-sims, p - 1, axis=1)[:, :p]
        near = np.take_along_axis(sims, cand, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
        dist = np.sqrt(np.maximum(0, 2 - 2 * near))
        for a in range(0, len(block), 128):
            own = vectors[cand[a : a + 128]]
            inner = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("qpd,qrd->qpr", own, own)))
            alive = np.ones(own.shape[:2], bool)
            picked = np.zeros(own.shape[:2], bool)
            rows = np.arange(len(own))
            for _ in range(degree):
                first = alive.argmax(1)
                some = alive[rows, first]
                if not some.any():
                    break
                picked[rows[some], first[some]] = True
                covered = alpha * inner[rows, first] <= dist[a : a + 128]
                alive &= ~(covered & some[:, None])
                alive[rows, first] = False
            out += [cand[a + i][picked[i]] for i in range(len(own))]
    return out


def _build(pool: int, degree: int, alpha: float):
    """(id, neighbour ids) of each vector of a shard; edges run both ways between neighbours."""

    def run(batches):
        for shard, held in grouped_text(batches, "shard"):
            ids = np.concatenate([longs(b, "id") for b in held])
            v = np.concatenate([_matrix(column(b, "v")) for b in held])
            lists = robust_prune(v, pool, degree, alpha)
            medoid = int((v @ v.mean(0)).argmax())
            src = np.concatenate([np.full(len(x), i) for i, x in enumerate(lists)] + [np.full(1, medoid)])
            dst = np.concatenate([*lists, np.full(1, medoid)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[src]), pa.array(ids[dst])], ["id", "to"])

    return run


def search(v: np.ndarray, heads: np.ndarray, adj: np.ndarray, queries: np.ndarray, medoid: int, beam: int, cosine: float):
    """(query, node) pairs in range: greedy beam search from the medoid for all queries, then expansion within range.

    Node i's neighbours are adj[heads[i]:heads[i+1]]; queries are node numbers.
    """
    n, q = len(v), len(queries)
    qv = v[queries]
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)
    ids = np.full((q, beam), -1)
    sims = np.full((q, beam), -2.0)
    done = np.ones((q, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = medoid, qv @ v[medoid], False
    seen[:, medoid] = True
    found = [(rows, np.full(q, medoid), sims[:, 0].copy())]

    def step(qi, nodes):
        """Unseen neighbours of (query, node) pairs with their cosines, CELLS neighbours at a time."""
        ends = np.cumsum(heads[nodes + 1] - heads[nodes])
        if not len(ends) or ends[-1] <= CELLS:
            return some(qi, nodes)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + CELLS, CELLS), "left"))
        parts_of = [some(qi[a:b], nodes[a:b]) for a, b in zip(cuts, [*cuts[1:], len(nodes)])]
        return tuple(np.concatenate(x) for x in zip(*parts_of))

    def some(qi, nodes):
        size = heads[nodes + 1] - heads[nodes]
        at = np.repeat(heads[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        qq, nb = np.repeat(qi, size), adj[at]
        fresh = ~seen[qq, nb]
        key = np.unique(qq[fresh] * n + nb[fresh])
        qq, nb = key // n, key % n
        seen[qq, nb] = True
        s = np.concatenate([np.einsum("ij,ij->i", qv[qq[i : i + 200_000]], v[nb[i : i + 200_000]]) for i in range(0, len(qq), 200_000)] or [np.zeros(0)])
        found.append((qq, nb, s))
        return qq, nb, s

    while True:
        open_sims = np.where(done, -3, sims)
        best = open_sims.argmax(1)
        live = rows[open_sims[rows, best] > -2.5]
        if not len(live):
            break
        done[live, best[live]] = True
        qq, nb, s = step(live, ids[live, best[live]])
        if not len(qq):
            continue
        first = np.searchsorted(qq, rows)
        rank = np.arange(len(qq)) - first[qq]
        width = int(rank.max()) + 1
        more_ids = np.full((q, width), -1)
        more_sims = np.full((q, width), -2.0)
        more_ids[qq, rank], more_sims[qq, rank] = nb, s
        touched = np.unique(qq)
        all_sims = np.hstack([sims[touched], more_sims[touched]])
        keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[touched] = np.take_along_axis(np.hstack([ids[touched], more_ids[touched]]), keep, 1)
        done[touched] = np.take_along_axis(np.hstack([done[touched], more_ids[touched] < 0]), keep, 1)
        sims[touched] = np.take_along_axis(all_sims, keep, 1)
    qq, nb, s = (np.concatenate(x) for x in zip(*found))
    close = s >= cosine - SLACK
    front = (qq[close], nb[close])
    grown = [(qq[s >= cosine], nb[s >= cosine])]
    while len(front[0]):
        qq, nb, s = step(*front)
        close = s >= cosine - SLACK
        front = (qq[close], nb[close])
        grown.append((qq[s >= cosine], nb[s >= cosine]))
    return tuple(np.concatenate(x) for x in zip(*grown))


_FOUND = "kind byte, a long, b long, n long"
#: a link (a < b); links of a vector, to be added up; a and b are connected
PAIR, COUNT, CONNECTED = 0, 1, 2


def _found(kind: int, a, b, n=None):
    nulls = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a, pa.int64()), nulls(b), nulls(n)], ["kind", "a", "b", "n"])


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected with through edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


class Owners:
    """Tells whose pairs are a shard's own; nodes come with the hashes of all shards that they are members of, and of their nearest one."""

    def __init__(self, shard: int, places: list, home: np.ndarray):
        width = max(map(len, places))
        # no two nodes share a filler
        self.places = np.array([[*p, *[None] * (width - len(p))] for p in places], object)
        there = self.places != None  # noqa: E711
        self.places = np.where(there, self.places, 0).astype(np.int64)
        self.there, self.shard, self.home = there, shard, home

    def own(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a < b: do the pairs belong to this shard?"""
        out = np.zeros(len(a), bool)
        for lo in range(0, len(a), 1 << 16):
            x, y = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
            common = ((self.places[x][:, :, None] == self.places[y][:, None, :]) & self.there[y][:, None, :]).any(2) & self.there[x]
            least = np.where(common, self.places[x], np.iinfo(np.int64).max).min(1)
            out[lo : lo + (1 << 16)] = np.where(common.any(1), least == self.shard, self.home[x] == self.shard)
        return out


class Links:
    """Links of a shard: numbers by node, and a spanning forest; pairs themselves only where they are asked for."""

    def __init__(self, copies: np.ndarray, pairs: bool):
        self.copies, self.n, self.pairs = copies, np.zeros(len(copies), np.int64), [] if pairs else None
        self.label = np.arange(len(copies))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.n += np.bincount(a, weights=self.copies[b], minlength=len(self.n)).astype(np.int64)
        self.n += np.bincount(b, weights=self.copies[a], minlength=len(self.n)).astype(np.int64)
        old = np.flatnonzero(self.label != np.arange(len(self.label)))
        self.label = least_labels(len(self.label), np.concatenate([a, old]), np.concatenate([b, self.label[old]]))
        if self.pairs is not None:
            self.pairs.append((a, b))

    def rows(self, ids: np.ndarray):
        if self.pairs is not None:
            for a, b in self.pairs:
                yield _found(PAIR, ids[a], ids[b])
        some = np.flatnonzero(self.n)
        yield _found(COUNT, ids[some], None, self.n[some])
        out = np.flatnonzero(self.label != np.arange(len(self.label)))
        yield _found(CONNECTED, ids[self.label[out]], ids[out])


def _exact(v: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", v[a[i : i + 100_000]], v[b[i : i + 100_000]]) >= cosine for i in range(0, len(a), 100_000)] or [np.zeros(0, bool)])


def _search(beam: int, cosine: float, pairs: bool):
    """What the shard's vectors are linked with, verified; see the module's text."""

    def run(batches):
        for _, held in grouped_text(batches, "shard"):
            ids, copies, home = (np.concatenate([longs(b, c) for b in held]) for c in ("id", "copies", "home"))
            own = np.concatenate([column(b, "own").to_numpy(zero_copy_only=False) for b in held])
            v = np.concatenate([_matrix(column(b, "v")) for b in held])
            lists, places = ([x for b in held for x in column(b, c)] for c in ("adj", "places"))
            order = np.argsort(ids)
            ids, copies, own, home, v = ids[order], copies[order], own[order], home[order], v[order]
            lists, places = [lists[i].values.to_numpy() for i in order.tolist()], [places[i].as_py() for i in order.tolist()]
            flat, src = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            inside = ids[at] == flat
            src, dst = np.concatenate([src[inside], at[inside]]), np.concatenate([at[inside], src[inside]])
            pair = np.unique(src * len(ids) + dst)
            src, adj = pair // len(ids), pair % len(ids)
            heads = np.searchsorted(src, np.arange(len(ids) + 1))
            mine = np.flatnonzero(own)
            medoid = int(mine[(v[mine] @ v[mine].mean(0)).argmax()])
            owners, links = Owners(int(longs(held[0], "number")[0]), places, home), Links(copies, pairs)
            place = np.full(len(ids), -1)
            place[mine] = np.arange(len(mine))
            # bit (i, j): member i or member j found the other one
            size = max(8, min(BLOCK, CELLS // len(ids)) // 8 * 8)
            bits = np.zeros((len(mine), -(-len(mine) // 8)), np.uint8)
            for lo in range(0, len(mine), size):
                block = mine[lo : lo + size]
                qi, nodes = search(v, heads, adj, block, medoid, beam, cosine)
                a, b = block[qi], nodes
                exact = _exact(v, a, b, cosine) & (a != b)
                qi, a, b = qi[exact], a[exact], b[exact]
                among = place[b] >= 0
                rows = np.zeros((len(block), len(mine)), bool)
                rows[qi[among], place[b[among]]] = True
                bits[lo : lo + size] = np.packbits(rows, axis=1)
                a, b = a[~among], b[~among]
                a, b = a[a < b], b[a < b]
                own_pairs = owners.own(a, b)
                links.add(a[own_pairs], b[own_pairs])
            for lo in range(0, len(mine), size):
                n = min(size, len(mine) - lo)
                rows = np.unpackbits(bits[lo : lo + n], axis=1, count=len(mine)).astype(bool)
                rows |= np.unpackbits(bits[:, lo // 8 : (lo + size) // 8], axis=1)[:, :n].T.astype(bool)
                i, j = np.nonzero(rows)
                a, b = mine[lo + i], mine[j]
                a, b = a[a < b], b[a < b]
                own_pairs = owners.own(a, b)
                links.add(a[own_pairs], b[own_pairs])
            yield from links.rows(ids)

    return run


def _compared(shared, cosine: float):
    """The shared vectors against a task's vectors: of each shared one its number of links there, and what connects them."""

    def run(batches):
        queries = shared.value  # by length: ids, vectors
        total = {d: np.zeros(len(ids), np.int64) for d, (ids, _) in queries.items()}
        for d, batch in _by_dim(batches):
            if d not in queries:
                continue
            ids, q = queries[d]
            other, copies = longs(batch, "id"), longs(batch, "copies")
            i, j = np.nonzero(_matrix(column(batch, "v")) @ q.T >= cosine)
            i, j = i[other[i] != ids[j]], j[other[i] != ids[j]]
            total[d] += np.bincount(j, weights=copies[i], minlength=len(ids)).astype(np.int64)
            at, inverse = np.unique(np.concatenate([other[i], ids[j]]), return_inverse=True)
            tree = least_labels(len(at), inverse[: len(i)], inverse[len(i) :])
            out = np.flatnonzero(tree != np.arange(len(at)))
            yield _found(CONNECTED, at[tree[out]], at[out])
        for d, (ids, _) in queries.items():
            yield _found(COUNT, ids[total[d] > 0], None, total[d][total[d] > 0])

    return run


def sharded(vectors: DataFrame, overlap: int = OVERLAP, shard: int = SHARD) -> DataFrame:
    """Members (shard, id, copies, v, home) of overlapping shards of vectors (id, dim, copies, v), as a written table."""
    spark = vectors.sparkSession
    sizes = {r.dim: r["count"] for r in vectors.groupBy("dim").count().where(F.col("count") * overlap > shard).collect()}  # at most n / shard lengths
    centroids = {}
    for d, n in sizes.items():
        sample = vectors.where(F.col("dim") == d).orderBy(F.xxhash64("id")).limit(min(n, SAMPLE)).select("v").toArrow()
        centroids[d] = centroids_of(_matrix(sample["v"]), min(MOST_SHARDS, max(1, n * overlap // shard)))
    shared = spark.sparkContext.broadcast(centroids)
    members = written(vectors.select("id", "dim", "copies", "v").mapInArrow(_assign(shared, overlap), _MEMBER))
    shared.destroy()
    largest = None
    while True:
        size = written(members.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > LARGE * shard // SHARD)
                       .withColumn("k", F.least(F.lit(64), F.ceil(F.col("n") * overlap / shard)).cast("long")))
        now = size.agg(F.max("n").alias("n")).first().n
        if now is None or now == largest:  # vectors that no centroids tell apart stay together
            break
        largest = now
        large = members.join(size, "shard")
        drawn = large.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(float(1 << 20)) * 4096 / F.col("n")).select("shard", "k", "v")  # some 4096 a shard
        found = written(drawn.repartition(parts(spark), "shard").sortWithinPartitions("shard").mapInArrow(_split_centroids, "shard string, k long, c binary"))
        salted = found.where("k > 1").select("shard", "c", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
        again = large.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(salted, ["shard", "salt"])
        again = again.select("shard", "id", "copies", "v", "home", "c").mapInArrow(_assign_again(overlap), _MEMBER)
        left = members.join(found.where("k > 1").select("shard"), "shard", "left_anti")
        # a vector of two old shards may come to a new one once only: names differ
        members = written(left.unionByName(again))
    return members


def near_links(vectors: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP, beam: int = BEAM, shard: int = SHARD, pairs: bool = False) -> DataFrame:
    """kind, a, b, n: numbers of links and connections of vectors (id, dim, copies, v), to be added up and united; with pairs, every link too, once."""
    spark = vectors.sparkSession
    members = sharded(vectors, overlap, shard)
    by_shard = members.repartition(parts(spark), "shard").sortWithinPartitions("shard")
    edges = by_shard.mapInArrow(_build(POOL, DEGREE, ALPHA), "id long, to long")
    number = F.xxhash64("shard")
    none = F.lit(None).cast("long")
    told = edges.select("id", "to", none.alias("place"), none.alias("home")).unionByName(
        members.select("id", none.alias("to"), number.alias("place"), F.when(F.col("home"), number).alias("home")))
    # at most DEGREE neighbours for each of a vector's shards
    united = written(told.groupBy("id").agg(F.collect_set("to").alias("adj"), F.collect_set("place").alias("places"), F.max("home").alias("home")))
    # a shard's nodes: its members, and what the united lists of its members lead to
    reach = members.select("shard", "id").join(united.select("id", "adj"), "id").select("shard", F.explode("adj").alias("id")).distinct()
    nodes = members.select("shard", "id", F.lit(True).alias("own")).unionByName(reach.withColumn("own", F.lit(False)))
    nodes = nodes.groupBy("shard", "id").agg(F.max("own").alias("own"))
    nodes = nodes.join(vectors.select("id", "copies", "v"), "id").join(united, "id").select("shard", number.alias("number"), "id", "copies", "own", "home", "places", "v", "adj")
    found = nodes.repartition(parts(spark), "shard").sortWithinPartitions("shard").mapInArrow(_search(beam, cosine, pairs), _FOUND)
    return written(found)


def _links_of(vectors: DataFrame, ids: DataFrame, cosine: float) -> DataFrame:
    """kind, a, b, n: all links of the vectors named by ids, few enough to be broadcast; the counts of an id are to be added up."""
    q = vectors.join(ids, "id", "left_semi").select("id", "dim", "v").toArrow().combine_chunks()
    by_dim = {}
    for d in set(q["dim"].to_pylist()):
        rows = q.filter(pa.array([x == d for x in q["dim"].to_pylist()]))
        by_dim[d] = (rows["id"].to_numpy(), _matrix(rows["v"]))
    shared = vectors.sparkSession.sparkContext.broadcast(by_dim)
    found = written(vectors.mapInArrow(_compared(shared, cosine), _FOUND))
    shared.destroy()
    return found


def exact_links(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """kind, a, b, n: all links, by brute force: quadratic work, in blocks of bounded size; no pair is written."""
    blocks = vectors.count() // block + 1
    found = None
    for i in range(blocks):
        ids = vectors.select("id").where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)) == i)
        part = _links_of(vectors, ids, cosine)
        found = part if found is None else found.unionByName(part)
    counts = found.where(F.col("kind") == COUNT).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return written(counts.unionByName(found.where(F.col("kind") == CONNECTED).distinct()))


def link_counts(found: DataFrame) -> DataFrame:
    """id, linked: how many other vectors, copies included, each vector is linked with."""
    return found.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))


def recall(vectors: DataFrame, counts: DataFrame, cosine: float = COSINE, queries: int = QUERIES) -> float:
    """The share of their links that the counts (id, linked) hold, for queries drawn by a hash of the id alone; 1 if none has a link.

    The smaller of the share of all these links and of the mean over linked queries, so that neither
    one large group nor many small ones hide a loss.
    """
    n = vectors.count()
    while True:
        ids = written(vectors.select("id").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(min(n, queries)))
        true = _links_of(vectors, ids, cosine).where(F.col("kind") == COUNT).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
        one = true.join(counts, "id", "left").select("n", F.least("n", F.coalesce("linked", F.lit(0))).alias("h"))
        r = one.agg(F.count("*").alias("linked"), F.sum("n").alias("n"), F.sum("h").alias("h"), F.avg(F.col("h") / F.col("n")).alias("mean")).first()
        if r.linked >= LINKED or queries >= min(n, MOST_QUERIES):
            return min(r.h / r.n, r.mean) if r.n else 1.0
        queries = min(MOST_QUERIES, queries * 4)


def near_duplicates(rows: DataFrame, cosine: float = COSINE, target: float = TARGET, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of rows (vec_id, embedding).

    report, if given, gets `recall` (of the rounds' searches) and `exhaustive` (whether all vectors were compared in the end).
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    units = written(rows.mapInArrow(_units, "vec_id long, dim int, v binary"))
    valid = units.where("v is not null").select("vec_id", "dim", "v", F.sha2("v", 256).alias("_class"))
    classes = written(valid.groupBy("_class").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("v").alias("v"))
                      .withColumn("_at", F.monotonically_increasing_id()))
    # rows of one vec_id may be of several classes: the graph's nodes are numbered by themselves
    vectors = classes.select(F.col("_at").alias("id"), "dim", "copies", "v")
    overlap, beam, shares = OVERLAP, BEAM, []
    for _ in range(3):
        found = near_links(vectors, cosine, overlap, beam)
        counts = written(link_counts(found))
        shares.append(recall(vectors, counts, cosine))
        _LOG.info("audited recall %.4f with overlap %d and beam %d", shares[-1], overlap, beam)
        if shares[-1] >= target:
            break
        overlap, beam = overlap + 2, beam * 2
    else:
        _LOG.warning("audited recall %.4f stays under %.2f: all vectors are compared", shares[-1], target)
        found = exact_links(vectors, cosine)
        counts = link_counts(found)
    if report is not None:
        report.update(recall=shares, exhaustive=shares[-1] < target)
    labels = components(found.where(F.col("kind") == CONNECTED).select("a", "b"))
    names = classes.select(F.col("_at").alias("node"), "id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = names.groupBy("component").agg(F.min("id").alias("component_id"))
    known = classes.select("_class", "_at", "copies").join(counts.withColumnRenamed("id", "_at"), "_at", "left").join(names.select(F.col("node").alias("_at"), "component"), "_at").join(least, "component")
    known = known.select("_class", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    answered = valid.select("vec_id", "_class").join(known, "_class").select("vec_id", "n_links", "component_id")
    rest = units.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = answered.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
