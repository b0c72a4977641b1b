"""16-bit fixed-point vectors (Q1.15 at norm 0.95) as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET_NORM, ONE, EPS = 0.95, 32768, 1e-12
#: Up to this dimension a dot product with a literal vector is written out, which Spark compiles.
UNROLL = 128


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def quantize(v: Column, target: float = TARGET_NORM) -> Column:
    """rint(target * v / (|v| + 1e-12) * 32768), half to even, as array<int>. The norm is computed once a row:
    it travels as the only element of an outer array."""
    per = F.transform(F.array(norm(v) + F.lit(EPS)), lambda n: F.transform(v, lambda x: F.rint(F.lit(target) * (x.cast("double") / n) * F.lit(float(ONE))).cast("int")))
    return F.element_at(per, 1)


def dequantize(q: Column, dimension: int | None = None) -> Column:
    """array<float>; with a dimension, other lengths raise an error."""
    out = F.transform(q, lambda x: (x.cast("double") / ONE).cast("float"))
    if dimension is None:
        return out
    return F.when(F.size(q) == dimension, out).otherwise(F.raise_error(F.concat(F.lit(f"vector length is not {dimension}: "), F.size(q).cast("string"))))


def dot(a: Column | str, b: Column | Sequence[int]) -> Column:
    """Sum of (a * b + 16384) >> 15 over the components, as bigint. b: a column, or a query vector of ints. With a column's name and a
    query vector the sum is written as one SQL text, which is parsed at once."""
    if isinstance(a, str):
        if not isinstance(b, Column) and 0 < len(b) <= UNROLL:
            terms = " + ".join(f"shiftright(cast(get(`{a}`, {i}) as int) * {int(y)} + 16384, 15)" for i, y in enumerate(b))
            return F.expr(f"cast({terms} as bigint)")
        a = F.col(a)
    if isinstance(b, Column):
        terms = F.zip_with(a, b, lambda x, y: F.shiftright(x.cast("int") * y.cast("int") + 16384, 15))
        return F.aggregate(terms, F.lit(0), lambda s, x: s + x).cast("bigint")
    if len(b) > UNROLL:
        return dot(a, F.array(*[F.lit(int(x)) for x in b]))
    total = F.lit(0)
    for i, y in enumerate(b):
        total = total + F.shiftright(F.get(a, F.lit(i)).cast("int") * F.lit(int(y)) + 16384, 15)
    return total.cast("bigint")


def recover_cos(raw: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw / F.lit(ONE * TARGET_NORM * TARGET_NORM)))


def plain_score(raw: Column) -> Column:
    """The score of the contiguous top-k: raw / 32768."""
    return raw / F.lit(float(ONE))


def l2_normalize(v: Column) -> Column:
    """Unit length; all-zero vectors stay."""
    per = F.transform(F.array(norm(v)), lambda n: F.when(n != 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>")))
    return F.element_at(per, 1)
