"""Vector functions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def guarded_cosine(a: Column, b: Column) -> Column:
    """Null if either is null or they differ in length; a length of zero counts as one."""
    norm = lambda v: F.when(dot(v, v) == 0, 1.0).otherwise(F.sqrt(dot(v, v)))
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)), dot(a, b) / (norm(a) * norm(b)))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def above_mean_bits(values: Column) -> Column:
    """Average hash: a bit for each value, the first the highest, set if it is above the mean."""
    mean = F.aggregate(_wide(values), F.lit(0.0), lambda t, x: t + x) / F.size(values)
    return F.aggregate(F.transform(_wide(values), lambda x: (x > mean).cast("long")), F.lit(0).cast("long"), lambda t, b: F.shiftleft(t, 1).bitwiseOR(b))


def sign_bits(values: Column) -> Column:
    return F.aggregate(_wide(values), F.lit(0).cast("long"), lambda t, x: F.shiftleft(t, 1).bitwiseOR((x > 0).cast("long")))


def parse_vector(text: Column) -> Column:
    """[a,b,...] as an array; null if it is none."""
    return F.from_json(text, "array<float>")
