"""Vector expressions over array<float> columns, in double precision."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def last_token(states: Column, mask: Column) -> Column:
    """The state of the last token under a 0/1 mask."""
    return F.element_at(states, F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int")))


def with_end(ids: Column, end: int, most: int, multiple: int = 8, pad: int = 0) -> Column:
    """Token ids cut to most - 1, closed by the end id and padded to a multiple."""
    cut = F.concat(F.slice(ids, 1, most - 1), F.array(F.lit(end)))
    gap = F.pmod(-F.size(cut), F.lit(multiple))
    return F.concat(cut, F.array_repeat(F.lit(pad), gap))
