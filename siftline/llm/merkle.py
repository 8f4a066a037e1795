"""A Merkle manifest of a table: a tree of digests per group, a tree over the groups' roots, and a proof for every row.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests enter as hex text.  A leaf is H of the row's fields, each `-` if
null, else its UTF-8 byte count, a colon and the value.  In each tree every `fanout` consecutive nodes become their H, level by
level, until one is left; the last few may be fewer, even one.

Superblock reduction: nodes are dealt to buckets by index / fanout^levels; one applyInPandas collapses `levels` levels of a
bucket at once and gives every node the siblings met on the way (its lower proof) and the bucket a root.  The buckets' roots are
the nodes of the next pass, so that n leaves take log n / (levels * log fanout) passes, each a fanout^levels-th of the one before.
Proofs are put together from the top down: a bucket's proof stands behind those of its nodes.  Only digests are shuffled, never texts,
and no task or group holds more than fanout^levels nodes.

Groups ascend by UTF-8 bytes, null first; leaves of a group by id, null first, then by leaf.  Rows may repeat: equal rows are leaves
of their own.  An empty table has no rows and no root.  Extra columns are ignored; fields of any length are hashed where they are read.
"""
import hashlib
from binascii import hexlify

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import numbered
from .common import column, table, trimmed, written

#: levels that one pass collapses, at fanout 2
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields."""
    def field(c):
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, fields)), 256)


def joined(digests: bytes) -> bytes:
    """H of digests that stand one behind the other in 32 bytes each."""
    return hashlib.sha256(hexlify(digests)).digest()


def _collapsed(fanout: int, levels: int, names: list):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        at, size = rows["idx"].to_numpy(), int(rows["size"].iloc[0])
        nodes, proofs = list(rows["digest"]), [b""] * len(rows)
        members = [[i] for i in range(len(nodes))]
        for _ in range(levels):
            if size == 1:
                break
            up, under = [], []
            for a in range(0, len(nodes), fanout):  # a bucket starts at a multiple of fanout at every level
                run_of = nodes[a : a + fanout]
                for j in range(len(run_of)):
                    others = b"".join(run_of[:j] + run_of[j + 1 :])
                    for i in members[a + j]:
                        proofs[i] += others
                up.append(joined(b"".join(run_of)))
                under.append([i for m in members[a : a + fanout] for i in m])
            nodes, members, size = up, under, -(-size // fanout)
        rows["proof"] = proofs
        rows["root"] = [nodes[0]] + [None] * (len(rows) - 1)
        return rows.assign(idx=at)[names]

    return run


def trees(nodes: DataFrame, fanout: int = 2, levels: int = LEVELS, keep: tuple = ()) -> tuple[list, DataFrame]:
    """(layers, roots) of the trees over nodes (tree, size: nodes of the tree, idx: 0, 1, ... in each tree, digest: 32 bytes).

    A layer has tree, size, idx, bucket, proof and, once a bucket, root; the first one keeps the columns `keep` of the nodes.  roots: tree, digest.
    """
    span, layers = fanout**levels, []
    most = nodes.agg(F.max("size").alias("n")).first().n or 0
    while most > 1:
        names = ["tree", "size", "idx", "bucket", *keep, "digest", "proof", "root"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(*keep).schema)
        schema = f"tree long, size long, idx long, bucket long, {schema + ', ' if keep else ''}digest binary, proof binary, root binary"
        rows = nodes.select("tree", "size", "idx", F.expr(f"idx div {span}").alias("bucket"), *keep, "digest")
        alone = rows.where("size = 1").select("*", F.lit(b"").alias("proof"), F.col("digest").alias("root"))
        layer = written(rows.where("size > 1").groupBy("tree", "bucket").applyInPandas(_collapsed(fanout, levels, names), schema).unionByName(alone))
        layers.append(layer)
        nodes = layer.where("root is not null").select("tree", F.ceil(F.col("size") / span).alias("size"), F.col("bucket").alias("idx"), F.col("root").alias("digest"))
        most, keep = -(-most // span), ()
    return layers, nodes.select("tree", "digest", *keep)


def _proved(layers: list, above: DataFrame | None, keep: tuple, more: tuple) -> DataFrame:
    """The first layer's rows with their whole proofs: each layer's behind it, and at last those of `above` (tree, bucket, above, more)."""
    for layer in reversed(layers):
        first = layer is layers[0]
        rows = layer.withColumn("above", F.lit(b"")) if above is None else layer.join(above, ["tree", "bucket"])
        rows = rows.select("tree", "size", "idx", *(keep if first else ()), *(["digest"] if first else []), F.concat("proof", "above").alias("above"), *more)
        above = rows if first else rows.select("tree", F.col("idx").alias("bucket"), "above", *more)
    return above


def manifest(docs: DataFrame, leaves: Column, group: str = "lang", order: str = "doc_id", fanout: int = 2, levels: int | None = None, keep: tuple = ()) -> DataFrame:
    """One row per row of docs: `order`, leaf, subroot, root (32 bytes each), proof, and its place: idx of size, group_no of groups; and the columns keep.

    proof holds the digests of the siblings, level by level from the leaf to the root, left to right.  leaves is the rows' digest in hex (leaf()).
    """
    levels = levels or max(1, int(LEVELS / np.log2(fanout)))
    rows = docs.select(F.col(group).alias("_g"), F.col(order).alias("_id"), F.unhex(leaves).alias("digest"), F.monotonically_increasing_id().alias("_at"), *[F.col(c).alias(f"k_{c}") for c in keep])
    rows = numbered(written(rows), "_g", "_id", "digest", "_at")  # ranges end in the row's own number: no group or id is too large for a task
    groups = written(rows.groupBy("_g").agg(F.min("rn").alias("_first"), F.count("*").alias("size")))
    groups = written(numbered(groups, "_g", name="tree"))
    held = ("_id", *[f"k_{c}" for c in keep])
    nodes = rows.join(groups, rows["_g"].eqNullSafe(groups["_g"])).select("tree", "size", (F.col("rn") - F.col("_first")).alias("idx"), "digest", *held)
    nodes = written(nodes)
    layers, subroots = trees(nodes, fanout, levels, held)
    n = groups.count()
    tops = written(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("size"), F.col("tree").alias("idx"), "digest"))
    upper, roots = trees(tops, fanout, levels)
    root = roots.select("digest").first()
    whole = F.lit(bytes(root.digest) if root else b"")
    tops = _proved(upper, None, (), ()) if upper else tops.withColumn("above", F.lit(b""))
    above = tops.select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("bucket"), "above", F.col("digest").alias("subroot"))
    if layers:
        out = _proved(layers, above, held, ("subroot",))
    else:
        out = nodes.join(above.drop("bucket"), "tree")
    return out.select(F.col("_id").alias(order), *[F.col(f"k_{c}").alias(c) for c in keep], F.col("digest").alias("leaf"), "subroot", whole.alias("root"), F.col("above").alias("proof"),
                      "idx", "size", F.col("tree").alias("group_no"), F.lit(n).cast("long").alias("groups"))


def fold(digest: bytes, idx: int, size: int, proof: bytes, fanout: int = 2) -> tuple[bytes, bytes]:
    """(the root that a leaf and the siblings of its tree give, what is left of the proof)."""
    while size > 1:
        first = idx - idx % fanout
        others = 32 * (min(fanout, size - first) - 1)
        left, own = 32 * (idx - first), proof[:others]
        digest, proof = joined(own[:left] + digest + own[left:]), proof[others:]
        idx, size = idx // fanout, -(-size // fanout)
    return digest, proof


def _folding(fanout: int, leaf: str, keep: list):
    def run(batches):
        for batch in trimmed(batches):
            get = {c: column(batch, c).to_pylist() for c in (leaf, "proof", "idx", "size", "group_no", "groups")}
            out, proofs = [], []
            for digest, proof, idx, size, no, groups in zip(*get.values()):
                top, rest = fold(digest, idx, size, proof, fanout)
                top, rest = fold(top, no, groups, rest, fanout)
                if rest:
                    raise ValueError("a proof is longer than its tree")
                out.append(top)
                proofs.append(joined(proof))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(proofs, pa.binary()), pa.array(out, pa.binary())], [*keep, "proof_digest", "folded"])

    return run


def folded(rows: DataFrame, leaf: str = "leaf", fanout: int = 2, keep: tuple = ()) -> DataFrame:
    """keep, proof_digest (H of the siblings) and folded: the root that the column `leaf` and the proof of each of manifest()'s rows give."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    rows = rows.select(*dict.fromkeys([*keep, leaf, "proof", "idx", "size", "group_no", "groups"]))
    return rows.mapInArrow(_folding(fanout, leaf, list(keep)), f"{schema}, proof_digest binary, folded binary")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    own = leaf(*map(F.col, FIELDS))
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    tampers = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    other = leaf(*(more if c == "n_chars" else F.col(c) for c in FIELDS))
    docs = docs.withColumn("shown", F.unhex(F.when(F.coalesce(tampers, F.lit(False)), other).otherwise(own)))
    rows = folded(manifest(docs, own, keep=("shown",)), "shown", keep=("doc_id", "leaf", "subroot", "root"))
    text = lambda c: F.lower(F.hex(c))
    return rows.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), text("proof_digest").alias("proof_sha256"),
                       text("folded").alias("folded_root"), F.expr("folded = root").alias("verified"))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
           lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS inverse,
         F(doc_id) || F(source) || F(lang) AS head, n_chars, F(text) AS tail
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, sha256(head || F(n_chars) || tail) AS h,
         sha256(head || CASE WHEN xor(inverse, 4294967295) % 7 = 0 THEN F(n_chars + 1) ELSE F(n_chars) END || tail) AS shown
  FROM d
), low AS (
  SELECT lang, 0 AS l, i, h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM low WHERE n > 1 GROUP BY lang, l, i // 2
), sub AS (SELECT lang, h AS subroot, l AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM low WHERE n = 1),
high AS (
  SELECT 0 AS l, g AS i, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL
  SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM high WHERE n > 1 GROUP BY l, i // 2
), top AS (SELECT h AS root, l AS depth FROM high WHERE n = 1),
placed AS (SELECT v.*, sub.subroot, sub.g, sub.depth AS lows, top.depth AS highs, top.root FROM leaves v JOIN sub ON v.lang IS NOT DISTINCT FROM sub.lang CROSS JOIN top),
steps AS (
  SELECT a.doc_id, s.l, xor((a.i >> s.l), 1) AS j, (a.i >> s.l) & 1 AS odd, a.lang, false AS up FROM placed a, unnest(range(a.lows)) AS s(l)
  UNION ALL
  SELECT a.doc_id, a.lows + s.l, xor((a.g >> s.l), 1), (a.g >> s.l) & 1, CAST(s.l AS VARCHAR), true FROM placed a, unnest(range(a.highs)) AS s(l)
), path AS (
  SELECT s.doc_id, s.l, s.odd, low.h FROM steps s LEFT JOIN low ON NOT s.up AND low.lang IS NOT DISTINCT FROM s.lang AND low.l = s.l AND low.i = s.j WHERE NOT s.up
  UNION ALL
  SELECT s.doc_id, s.l, s.odd, high.h FROM steps s LEFT JOIN high ON high.l = CAST(s.lang AS BIGINT) AND high.i = s.j WHERE s.up
), climb AS (
  SELECT doc_id, 0 AS l, shown AS h FROM placed
  UNION ALL
  SELECT c.doc_id, c.l + 1, sha256(CASE WHEN p.h IS NULL THEN c.h WHEN p.odd = 1 THEN p.h || c.h ELSE c.h || p.h END)
  FROM climb c JOIN path p ON p.doc_id = c.doc_id AND p.l = c.l
), proof AS (SELECT doc_id, sha256(coalesce(string_agg(h, '' ORDER BY l), '')) AS proof_sha256 FROM path GROUP BY 1)
SELECT placed.doc_id, placed.h AS leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, climb.h AS folded_root, climb.h = root AS verified
FROM placed JOIN climb ON climb.doc_id = placed.doc_id AND climb.l = placed.lows + placed.highs LEFT JOIN proof ON proof.doc_id = placed.doc_id
"""


def _spelled(sql: str) -> str:
    """The SQL with F(x), a field's text, written out."""
    import re

    return re.sub(r"\bF\(([^()]*)\)", r"coalesce(octet_length(encode(CAST(\1 AS VARCHAR))) || ':' || CAST(\1 AS VARCHAR), '-')", sql)


ORACLE = _spelled(ORACLE)
