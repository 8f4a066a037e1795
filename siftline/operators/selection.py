"""The n-th rows of a seeded order without a sort: counts of digits narrow the draw's values down to a few rows.

A draw has 32 bits.  One pass counts the rows by the upper 16 bits; only where the rows of one value of these are more than LISTED,
another pass counts by the lower ones.  The rows that share what is left are listed, in order of draw and key.  What comes back is a
threshold, so that selecting is a comparison in the scan, with no shuffle.
"""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import draw

#: rows with one prefix that are ordered by the driver
LISTED = 4096
_BITS = 16


@dataclass
class Threshold:
    """The n-th row's draw (32 bits) and key; of the `held` rows equal to it in both, `take` count.  No draw: all rows; a draw of -1: none."""

    draw: int | None
    key: object = None
    take: int = 0
    held: int = 0


def bits(seed: int, key: str) -> Column:
    """The 32 bits of the draw."""
    return (draw(seed, key) * F.lit(4294967296.0)).cast("long")


def thresholds(df: DataFrame, seed: int, key: str, targets: list, stratum: str | None = None, from_end: bool = False) -> list:
    """A Threshold for each target (stratum's value, n): of the n-th of that stratum's rows in the order of (draw, key), or in the reverse order."""
    value = bits(seed, key)
    rows = df.select(F.col(key).alias("key"), (F.col(stratum) if stratum else F.lit(0)).alias("s"), (F.lit((1 << 32) - 1) - value if from_end else value).alias("v"))
    open_ = {i: [s, n, 0, 32] for i, (s, n) in enumerate(targets) if n > 0}  # stratum, n within the prefix, prefix, bits that are left
    out = {i: Threshold(-1) for i, (_, n) in enumerate(targets) if n <= 0}
    many = set(open_)
    while many:
        wanted = {}
        for i in many:
            s, _, prefix, left = open_[i]
            wanted.setdefault((s, prefix, left), []).append(i)
        counts = {}
        left = open_[next(iter(many))][3]
        some = F.lit(False)
        for s, prefix, _ in wanted:
            some = some | (F.col("s").eqNullSafe(F.lit(s)) & (F.shiftright("v", left) == prefix if left < 32 else F.lit(True)))
        found = rows.where(some).groupBy("s", F.shiftright("v", left - _BITS).alias("p")).count().collect()  # 65,536 rows a target at most
        for r in found:
            counts.setdefault((r.s, r.p >> _BITS), []).append((r.p, r["count"]))
        again = set()
        for (s, prefix, _), which in wanted.items():
            for i in which:
                n, held = open_[i][1], 0
                for p, c in sorted(counts.get((s, prefix), [])):
                    if n <= c:
                        held = c
                        break
                    n -= c
                if not held:
                    out[i] = Threshold(None)
                    del open_[i]
                    continue
                open_[i] = [s, n, p, left - _BITS]
                if held > LISTED and left > _BITS:
                    again.add(i)
        many = again
    for left in {x[3] for x in open_.values()}:
        own = {i: x for i, x in open_.items() if x[3] == left}
        some = F.lit(False)
        for s, _, prefix, _ in own.values():
            some = some | (F.col("s").eqNullSafe(F.lit(s)) & (F.shiftright("v", left) == prefix))
        # draws of 32 equal bits, and keys that repeat, are counted, not listed
        listed = rows.where(some).groupBy("s", "v", "key").count().collect()
        by = {}
        for r in listed:
            by.setdefault((r.s, r.v >> left), []).append((r.v, r.key, r["count"]))
        for i, (s, n, prefix, _) in own.items():
            # least draws first, then the keys in order, null as the database sorts it
            at = sorted(by[s, prefix], key=lambda r: r[0])
            at.sort(key=lambda r: (r[1] is not None, r[1]) if r[1] is not None else (False,), reverse=from_end)
            at.sort(key=lambda r: r[0])
            for v, k, c in at:
                if n <= c:
                    out[i] = Threshold((1 << 32) - 1 - v if from_end else v, k, n, c)
                    break
                n -= c
    return [out[i] for i in range(len(targets))]


def before(value: Column, key: Column, at: Threshold, from_end: bool = False) -> Column:
    """Whether a row comes before the threshold's row."""
    if at.draw is None:
        return F.lit(True)
    if at.draw < 0:
        return F.lit(False)
    own = F.lit(at.key)
    least = key > own if from_end else (key.isNull() & own.isNotNull()) | (key < own)
    nulls = key.isNotNull() if from_end else F.lit(False)
    tie = nulls if at.key is None else F.coalesce(least, F.lit(not from_end and at.key is not None))
    return (value > at.draw if from_end else value < at.draw) | ((value == at.draw) & tie)


def equal(value: Column, key: Column, at: Threshold) -> Column:
    """Whether a row is equal to the threshold's row."""
    return F.lit(False) if at.draw is None or at.draw < 0 else (value == at.draw) & key.eqNullSafe(F.lit(at.key))
