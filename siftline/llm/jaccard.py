"""N-gram Jaccard join in the metric space of shingle sets.

A document's set holds the 64-bit hashes of its distinct 5-word shingles (of its whole
sequence, if it has fewer words).  Two documents link when their Jaccard distance is
at most TAU = 1/4, decided on whole counts.

1. Isolation.  All shingle hashes are counted; a bitmap of those seen twice and one of
   very common ones put shingles in one global order: seen once, then repeated, then
   very common.  A linked pair shares one of the first n - ceil(3n/4) + 1 shingles of
   both sets, so a document whose first ones are all seen once has no link.
2. Equal sets become one class, and links are sought between classes.
3. Pivots.  For each shared leading shingle the least class is the pivot of the
   classes that hold it; distances to pivots are exact.  Every link lies among the
   classes that meet some pivot, its region.
4. Voronoi cells.  A class is dealt to its nearest pivot's region, its home.  It visits
   the other regions that it meets as a boundary document: there it is compared only
   with classes of another home, as its home compares it with its own.
5. Windows.  A region is cut into rings of width TAU around its pivot.  By the triangle
   inequality a class links only within its ring or the next, so the classes of the
   ring before that lie within TAU of a ring's nearest native are copied into it.
   Rings where all are linked already are not looked at, nor are members without an
   unconnected one near their size (linked sets differ by 4/3 at most).
6. Recursion.  A ring of more than CELL_BYTES of sets is dealt to further pivots, by
   hyperplane (at most 2 TAU beyond the home's distance) and radius (at most TAU beyond
   the cell's), again and again; one that no pivots split (all distances alike) meets in
   blocks of that size.  Only then are sets joined in, and inside a cell every class in
   turn is a pivot whose distances bound which classes may link with it.

The order only decides how much is compared: whatever the bitmaps hold, no link is
lost.  Null texts and texts without words have an empty set and link with nothing.
Rows that share an id are separate documents of that id; null ids sort last, and a
component of null ids only has a null component_id.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, column, dropped, grouped, longs, parts, table, written, written_at
from .components import components
from .substring import BUCKETS, Repeats, fineness, narrowed, repeats_of
from .textops import Words, dealt, mix, ngrams, run_hashes, runs

SHINGLE = 5
TAU = 0.25
#: times a shingle is seen from which it comes last in the order
COMMON = 2000
#: bytes of sets of a cell that is solved at once
CELL_BYTES = 8 << 20
#: bits of the map that finds the owners' rows: each, and at most
OWNER_BITS, OWNER_MAP = 64, 1 << 28
#: pivots that a cell is dealt to, and how often
MOST_PIVOTS, DEPTH = 64, 4


def shingle_sets(texts, size: int = SHINGLE):
    """(hashes, offsets): the sorted distinct shingle hashes of every text."""
    words = Words(texts, lower=True)
    grams = ngrams(words.hash, size)
    whole = words.row[: len(grams)] == words.row[size - 1 :] if len(grams) else np.zeros(0, bool)
    hashes, rows = grams[whole], words.row[: len(grams)][whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        first, last = words.first[:-1][short], words.first[1:][short]
        inside = np.zeros(len(words.hash), bool)
        for a, b in zip(first.tolist(), last.tolist()):
            inside[a:b] = True
        hashes = np.concatenate([hashes, mix(run_hashes(words.hash, inside, first, last))])
        rows = np.concatenate([rows, short])
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order].astype(np.int32), kind="stable")]
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(words.rows + 1))


def _all_shingles(buckets: int):
    def run(batches):
        for batch in chunked(batches):
            hashes, _ = shingle_sets(column(batch, "text"))
            if not len(hashes):
                continue
            mixed, raw = narrowed(hashes)
            q = dealt(mixed, buckets)
            starts, sizes = runs(q)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q[starts]), pa.array([raw[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist())], pa.binary())], ["q", "blob"])

    return run


def prefix_size(n):
    """How many leading shingles of a set of n must hold one that any linked set shares."""
    return n - (3 * n + 3) // 4 + 1


def _may_link(shared):
    """(batch, sizes, repeated, rows, hashes, offs, rank) of every slice: rows may have a link.

    repeated: how many of a set's shingles are repeated in the corpus; it shares no others.
    """

    def run(batches):
        rep = Repeats(*shared.value)
        for batch in chunked(batches):
            hashes, offs = shingle_sets(column(batch, "text"))
            keys = mix(hashes >> np.uint64(16))
            rank = rep.may(keys).astype(np.int8) + rep.often(keys)
            sizes = np.diff(offs)
            once = np.concatenate([[0], np.cumsum(rank == 0)])
            once = once[offs[1:]] - once[offs[:-1]]
            yield batch, sizes, sizes - once, np.flatnonzero((sizes > 0) & (once < prefix_size(sizes))).tolist(), hashes, offs, rank

    return run


def _print(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _prints(shared):
    """Every row's set size, and the fingerprint of its set if it may have a link."""

    def run(batches):
        for batch, sizes, _, may, hashes, offs, _ in _may_link(shared)(batches):
            prints = [None] * len(sizes)
            for i in may:
                prints[i] = _print(hashes[offs[i] : offs[i + 1]])
            yield pa.RecordBatch.from_arrays([column(batch, "_k"), column(batch, "_fp"), pa.array(sizes.astype(np.int64)), pa.array(prints, pa.binary())], ["_k", "_fp", "n", "print"])

    return run


def _sets(shared):
    """Size, repeated shingles, fingerprint, leading shingles and set of the rows that may have a link."""

    def run(batches):
        for _, sizes, repeated, may, hashes, offs, rank in _may_link(shared)(batches):
            prints, leads, sets = [], [], []
            for i in may:
                own, r = hashes[offs[i] : offs[i + 1]], rank[offs[i] : offs[i + 1]]
                prints.append(_print(own))
                first = np.argsort(r, kind="stable")[: prefix_size(len(own))]
                leads.append(own[first[r[first] > 0]].view(np.int64))
                sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes[may].astype(np.int64)), pa.array(repeated[may].astype(np.int64)), pa.array(prints, pa.binary()), pa.array(leads, pa.list_(pa.int64())),
                 pa.array(sets, pa.list_(pa.int64()))], ["n", "r", "print", "lead", "set"])

    return run


_HASHES = 4


def _places(fp: np.ndarray, own: int):
    """The bits of a row hash in its segment of own bits."""
    x = mix(fp.view(np.uint64))
    for _ in range(_HASHES):
        yield (x % np.uint64(own)).astype(np.int64)
        x = mix(x + np.uint64(1))


def _segment_of(fp: np.ndarray) -> np.ndarray:
    return dealt(mix(fp.view(np.uint64) + np.uint64(1)), BUCKETS)


def _dealt_owners(batches):
    for batch in batches:
        fp = longs(batch, "_fp")
        yield pa.RecordBatch.from_arrays([pa.array(_segment_of(fp)), pa.array(fp)], ["q", "_fp"])


def _owner_segments(own: int):
    def run(batches):
        for q, held in grouped(batches, "q"):
            flags = np.zeros(own, bool)
            for b in held:
                for at in _places(longs(b, "_fp"), own):
                    flags[at] = True
            yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["q", "segment"])

    return run


def _owner_map(owners: DataFrame):
    """A broadcast bitmap of the owners' row hashes, of OWNER_MAP bits at most: the texts need not be dealt to meet their owners.

    A row that it finds by mistake only gives a class twice.
    """
    spark = owners.sparkSession
    own = 64 * max(1, min(OWNER_BITS * owners.count(), OWNER_MAP) // (BUCKETS * 64))
    bitmap = np.zeros(BUCKETS * own // 8, np.uint8)
    at = owners.select("_fp").mapInArrow(_dealt_owners, "q long, _fp long").repartition(min(parts(spark), BUCKETS), "q").sortWithinPartitions("q")
    for r in at.mapInArrow(_owner_segments(own), "q long, segment binary").toLocalIterator():  # OWNER_MAP bits at most
        bitmap[r.q * own // 8 : (r.q + 1) * own // 8] = np.frombuffer(r.segment, np.uint8)
    return spark.sparkContext.broadcast((own, bitmap))


def _owned(shared):
    """The texts of the rows that may own a class."""

    def run(batches):
        own, bitmap = shared.value
        for batch in batches:
            fp = longs(batch, "_fp")
            base, there = _segment_of(fp) * own, np.ones(len(fp), bool)
            for at in _places(fp, own):
                at = at + base
                there &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([column(batch, "text").filter(pa.array(there))], ["text"])

    return run


def _linked(inter, a, b):
    """100 * intersection >= 75 * union, on whole counts."""
    return 100 * inter >= 75 * (a + b - inter)


class Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, labels):
        first = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i):
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i, j):
        self.up[self.root(j)] = self.root(i)


def may_link(r_a, n_a, r_b, n_b):
    """Whether sets of those sizes can link: 75% of the union needs 3/7 of both sizes in common, and only repeated shingles are."""
    return 7 * np.minimum(r_a, r_b) >= 3 * (n_a + n_b)


def solve(sets: list, repeated: np.ndarray, labels: list, sides: np.ndarray, known: np.ndarray, homes: np.ndarray, pivot: int) -> list:
    """Links (i, j) that connect all linked classes of a cell, but for those of one home elsewhere.

    labels: the component each class is known to belong to; sides: 3 for natives, 1 for copies, which do not meet each
    other (1 and 2: two blocks that meet); known: distances to the cell's pivot, nan where not measured.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, ids = np.unique(flat, return_inverse=True)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(ids.max()) + 1, bool)
    forest, links = Forest(labels), []
    pivots = [known]
    done = np.zeros(n, bool)
    for p in np.argsort(known, kind="stable").tolist():
        done[p] = True
        root = forest.root(p)
        may = ~done & ((sides & sides[p] == 0) | (sides == 3) | (sides[p] == 3)) & ((homes != homes[p]) | (homes == pivot))
        may &= may_link(repeated, sizes, repeated[p], sizes[p])
        for d in pivots:
            may &= ~(np.abs(d - d[p]) > TAU + 1e-9)  # an unmeasured distance bounds nothing
        todo = [i for i in np.flatnonzero(may).tolist() if forest.root(i) != root]
        if not todo:
            continue
        mark[ids[offs[p] : offs[p + 1]]] = True
        inter = np.array([np.count_nonzero(mark[ids[offs[i] : offs[i + 1]]]) for i in todo])
        mark[ids[offs[p] : offs[p + 1]]] = False
        union = sizes[todo] + sizes[p] - inter
        for i, x in zip(todo, inter.tolist()):
            if _linked(x, int(sizes[i]), int(sizes[p])):
                links.append((p, i))
                forest.join(p, i)
        if len(pivots) < 16:
            d = np.full(n, np.nan)
            d[todo], d[p] = 1 - inter / union, 0
            pivots.append(d)
    return links


def _solve_cells(batches):
    for _, held in grouped(batches, "gid"):
        data = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cls, sets = longs(data, "x"), column(data, "set")
        sets = [sets[i].values.to_numpy() for i in range(len(sets))]
        a, b = [], []
        cells = {}
        for i, cell in enumerate(column(data, "cell").to_pylist()):  # cells whose 64-bit gid is the same stay apart
            cells.setdefault(cell, []).append(i)
        label, side, home, r = column(data, "component").to_pylist(), longs(data, "side"), longs(data, "home"), longs(data, "r")
        known = column(data, "d").to_numpy(zero_copy_only=False)
        for cell, at in cells.items():
            at = np.array(at)
            for i, j in solve([sets[i] for i in at], r[at], [label[i] for i in at], side[at], known[at], home[at], int(cell.split("/")[0])):
                a.append(int(cls[at[i]]))
                b.append(int(cls[at[j]]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def joined(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text): _k (doc_id), _fp (a hash of the row), n_shingles, and, of rows that may have a link,
    first: the _k and _fp of its component's least row, null ids last."""
    base = docs.select(F.col("doc_id").cast("long").alias("_k"), _row_hash(docs).alias("_fp"), "text")
    fine = fineness(base)
    repeats = repeats_of(base.select("text").mapInArrow(_all_shingles(BUCKETS * fine), "q long, blob binary"), hot_least=COMMON, width=6, fine=fine)
    rows = written(base.mapInArrow(_prints(repeats), "_k long, _fp long, n long, print binary"))

    # equal sets are one class; of its rows the least alone carries the set, however many copies there are
    least = F.min(F.struct(F.col("_k").isNull().alias("null"), "_k", "_fp"))
    owners, owners_path = written_at(rows.where("print is not null").groupBy("print").agg(least.alias("own")).select(*_safe(F.col("own._k"), F.col("own._fp"))))
    found = _owner_map(owners)
    owned = base.select("text", "_fp").mapInArrow(_owned(found), "text string")
    classes, classes_path = written_at(owned.mapInArrow(_sets(repeats), "n long, r long, print binary, lead array<long>, set array<long>").withColumn("x", F.monotonically_increasing_id()))
    named = written(classes.groupBy("print").agg(F.min("x").alias("x")))
    repeats.destroy()
    found.destroy()
    dropped(docs.sparkSession, owners_path)
    if 1.01 * named.count() < classes.count():  # rows that are equal in every column; a few classes that are there twice do no harm
        again = classes_path
        classes, classes_path = written_at(classes.join(named.select("x"), "x", "left_semi").select(*classes.columns))
        dropped(docs.sparkSession, again)

    near, near_path = written_at(_distances(classes))
    links = near.where("p <> x" ).where(100 * F.col("i") >= 75 * (F.col("n") + F.col("np") - F.col("i"))).select(F.col("p").alias("a"), F.col("x").alias("b"))
    more = _within_regions(near, classes.select("x", "set"), components(links))
    labels = components(links.unionByName(more))
    labels = written(named.join(labels.withColumnRenamed("node", "x"), "x", "left").select("print", F.coalesce("component", "x").alias("c")))
    dropped(docs.sparkSession, classes_path, near_path)
    firsts = rows.where("print is not null").select("_k", "_fp", "print").join(labels, "print").groupBy("c").agg(least.alias("first"))
    labels = labels.join(firsts, "c").select("print", "first")
    return rows.join(labels, "print", "left").select("_k", "_fp", F.col("n").alias("n_shingles"), "first")


_SAFE = ["_n", "_k", "_fp"]


def _safe(k, fp) -> list:
    """A row's key by which null ids meet in a join."""
    return [k.isNull().alias("_n"), F.coalesce(k, F.lit(0)).alias("_k"), fp.alias("_fp")]


def _row_hash(docs: DataFrame):
    """A hash of the whole row: rows equal in it are copies of one row."""
    return F.xxhash64("text", F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])))


def _distances(classes: DataFrame) -> DataFrame:
    """p, x, n, r, np, i, d: each class with the pivots of its leading shingles; a pivot meets itself, too."""
    held = classes.select("x", "n", "r", F.explode("lead").alias("s"))
    least = held.groupBy("s").agg(F.min(F.struct("x", "n")).alias("p"), F.max("x").alias("q")).where("p.x <> q")
    pairs = held.join(least.select("s", F.col("p.x").alias("p"), F.col("p.n").alias("np")), "s").select("p", "np", "x", "n", "r").distinct()
    # sizes that differ more than twofold are over 1/2 apart without a look at the sets
    look = (F.col("p") != F.col("x")) & (2 * F.least("n", "np") >= F.greatest("n", "np"))
    sets = classes.select("x", "set")
    pivots = sets.select(F.col("x").alias("p"), F.col("set").alias("sp"))
    i = F.size(F.array_intersect("set", "sp")).cast("long").alias("i")
    near = pairs.where(look).join(sets, "x").join(pivots, "p").select("p", "x", "n", "r", "np", i)
    near = near.withColumn("d", 1 - F.col("i") / (F.col("n") + F.col("np") - F.col("i")))
    own = F.col("p") == F.col("x")
    rest = pairs.where(~look).select("p", "x", "n", "r", "np", F.when(own, F.col("n")).alias("i"), F.when(own, F.lit(0.0)).alias("d"))
    return near.unionByName(rest)


def _within_regions(near: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between members of a region that its pivot does not connect."""
    label = labels.select(F.col("node").alias("x"), "component")
    # what sizes alone say of an unmeasured distance
    beyond = F.greatest(F.lit(2 * TAU), 1 - F.least("n", "np") / F.greatest("n", "np"))
    own = near.select("p", "x", "n", "r", "d", F.when(F.col("d").isNull(), beyond).otherwise(F.col("d")).alias("far")).join(label, "x", "left").withColumn("component", F.coalesce("component", "x"))
    # regions with members that are not connected yet
    open_ = own.groupBy("p").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("p")
    # the home of a class is its nearest pivot; itself, if it is one
    home = near.groupBy("x").agg(F.min(F.struct(F.coalesce("d", F.lit(1.0)).alias("d"), "p"))["p"].alias("home"))
    own = written(own.join(open_, "p").join(home, "x"))
    # ring k lies at k * TAU .. (k + 1) * TAU; an unmeasured distance is beyond 2 * TAU, and a class of it is native to both outer rings, or to the last
    ring = F.greatest(F.ceil(F.col("far") / TAU - 1e-9) - 1, F.lit(0)).cast("int")
    rings = F.when(F.col("d").isNull() & (F.col("far") <= 3 * TAU + 1e-9), F.array(F.lit(2), F.lit(3))).otherwise(F.array(ring))
    native = own.withColumn("ring", F.explode(rings))
    nearest = native.groupBy("p", "ring").agg(F.min("far").alias("d0"))
    before = native.where("d is not null").withColumn("ring", F.col("ring") + 1).join(nearest, ["p", "ring"]).where(F.col("d") >= F.col("d0") - TAU - 1e-9).drop("d0")
    members = native.withColumn("side", F.lit(3)).unionByName(before.withColumn("side", F.lit(1)))
    cells = members.select(F.concat_ws("/", "p", "ring").alias("cell"), "x", "n", "r", "d", "home", "component", F.col("side").cast("long").alias("side"))
    cells = written(_open(cells))
    ready = [cells]
    for level in range(DEPTH + 1):
        size = cells.groupBy("cell").agg(F.sum(8 * F.col("n")).alias("bytes"), F.count("*").alias("members"))
        big = written(size.where(F.col("bytes") > CELL_BYTES))
        if not big.limit(1).count():
            break
        ready[-1] = cells.join(big.select("cell"), "cell", "left_anti")
        large = cells.join(big, "cell")
        if level == DEPTH:
            ready.append(_blocks(large))
            break
        dealt_on, whole = _dealt_on(large, sets, level)
        ready.append(_blocks(whole))
        cells = written(_open(dealt_on))
        ready.append(cells)
    groups = ready[0]
    for more in ready[1:]:
        groups = groups.unionByName(more)
    groups = groups.join(sets, "x").withColumn("gid", F.xxhash64("cell")).withColumn("d", F.coalesce("d", F.lit(float("nan"))))
    found = groups.repartition(parts(near.sparkSession), "gid").sortWithinPartitions("gid").mapInArrow(_solve_cells, "a long, b long")
    return written(found)


def _open(cells: DataFrame) -> DataFrame:
    """The members of cells that may have a link there: some native is near in size, and not all that are near in size are connected yet.

    Linked sets differ by 4/3 in size at most, so that they lie in one class of sizes or in neighbouring ones.
    """
    sized = cells.withColumn("size", F.floor(F.log("n") / float(1.000001 * np.log(4 / 3))).cast("int"))
    near = sized.groupBy("cell", "size").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("side").alias("s"))
    near = near.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    some = near.groupBy("cell", "size").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.max("s").alias("s")).where("c0 <> c1 and s > 1")
    return sized.join(some.select("cell", "size"), ["cell", "size"], "left_semi").select(*cells.columns)


def _dealt_on(large: DataFrame, sets: DataFrame, level: int) -> tuple:
    """Large cells dealt to pivots of their own, drawn by a hash: (the new cells, the members of cells that no pivots split)."""
    many = F.least(F.lit(MOST_PIVOTS), F.ceil(2 * F.col("bytes") / CELL_BYTES))
    drawn = F.pmod(F.xxhash64("x", F.lit(level)), F.lit(1 << 20)) < F.lit(float(1 << 20)) * 2 * many / F.col("members")
    pivots = large.where(drawn).select("cell", F.col("x").alias("q")).distinct()
    pivots = written(pivots.join(sets.select(F.col("x").alias("q"), F.col("set").alias("sq")), "q"))
    # a cell's pivots are few; its members are spread over salts that each get a copy of them
    salted = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    members = large.join(sets, "x").withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(16)).cast("int"))
    i = F.size(F.array_intersect("set", "sq"))
    far = members.join(salted, ["cell", "salt"]).select("cell", "x", "q", (1 - i / (F.col("n") + F.size("sq") - i)).alias("d"))
    far = written(far)
    home = far.groupBy("cell", "x").agg(F.min(F.struct("d", "q")).alias("h")).select("cell", "x", F.col("h.d").alias("least"), F.col("h.q").alias("at"))
    placed = far.join(home, ["cell", "x"])
    radius = placed.where("q = at").groupBy("cell", "q").agg(F.max("d").alias("radius"))
    placed = placed.join(radius, ["cell", "q"]).where((F.col("d") <= F.col("least") + 2 * TAU + 1e-9) & (F.col("d") <= F.col("radius") + TAU + 1e-9))
    placed = written(placed.select("cell", "x", "q", "d", (F.col("q") == F.col("at")).alias("inner")))
    # a cell whose members go to half of its pivots and more, or that has no pivot, is not split
    split = placed.groupBy("cell").agg((F.count("*") / F.count_if("inner")).alias("copies")).join(pivots.groupBy("cell").agg(F.count("*").alias("k")), "cell")
    split = written(split.where("k > 1 and copies < k / 2").select("cell"))
    new = placed.join(split, "cell").join(large.select("cell", "x", "n", "r", "home", "component"), ["cell", "x"]).select(
        F.concat_ws("/", "cell", "q").alias("cell"), "x", "n", "r", "d", "home", "component", F.when(F.col("inner"), 3).otherwise(1).cast("long").alias("side"))
    return new, large.join(split, "cell", "left_anti")


def _blocks(large: DataFrame) -> DataFrame:
    """Cells in blocks of half of CELL_BYTES: each block meets itself and every other one."""
    n = F.ceil(2 * F.col("bytes") / CELL_BYTES).cast("int")
    rows = large.withColumns({"blocks": n, "own": F.pmod(F.xxhash64("x"), n).cast("int")})
    met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("*", met)
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    cell = F.concat_ws("/", "cell", F.concat(F.lit("b"), F.least("own", "other"), F.lit("-"), F.greatest("own", "other")))
    return rows.select(cell.alias("cell"), "x", "n", "r", "d", "home", "component", side.cast("long").alias("side"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    return joined(docs).select(F.col("_k").alias("doc_id"), "n_shingles", F.when(F.col("first").isNotNull(), F.col("first._k")).otherwise(F.col("_k")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component the row of the least id stays (of several, that of the least row
    hash; of rows equal in all columns, one), and so do rows without words."""
    rows = written(joined(docs).where("first is not null").select("_k", "_fp", "first"))
    key, safe = _SAFE, _safe
    own = F.col("first._k").eqNullSafe(F.col("_k")) & (F.col("first._fp") == F.col("_fp"))
    lost = rows.where(~own).select(*safe(F.col("_k"), F.col("_fp"))).distinct()
    several = rows.where(own).groupBy("_k", "_fp").count().where("count > 1").select(*safe(F.col("_k"), F.col("_fp")))
    names = [f"`{c}`" for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("_row"), *safe(F.col("doc_id").cast("long"), _row_hash(docs)))
    left = keyed.join(lost.unionByName(several), key, "left_anti").select("_row")
    one = keyed.join(several, key, "left_semi").groupBy(*key).agg(F.any_value("_row").alias("_row")).select("_row")
    out = left.unionByName(one)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY 1) c ON c.x = d.doc_id
"""
