"""Vector expressions over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def let(value, f) -> Column:
    """f(value) with the value computed once: inside a lambda, an outer expression is evaluated for every element."""
    return F.transform(F.array(value), f)[0]


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a) -> Column:
    """Unit length; a vector of length 0 stays as it is."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def centred_unit(a, least: float = 1e-6) -> Column:
    """Mean subtracted, unit length; a constant vector becomes all zeros, so a dot product is a correlation."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    unit = lambda c: let(norm(c), lambda n: F.transform(c, lambda x: F.when(n > least, x / n).otherwise(0.0)))
    return let(a, lambda v: let(mean(v), lambda m: let(F.transform(v, lambda x: x - m), unit)))


def cosine100(a, b) -> Column:
    return 100 * dot(l2_normalise(a), l2_normalise(b))


def mean_vector(rows: DataFrame, by: list[str], vector: str, out: str = "mean") -> DataFrame:
    """Element-wise mean of the vectors of each group, by position; groups are never gathered in one task."""
    flat = rows.select(*by, F.posexplode(vector).alias("_i", "_x"))
    means = flat.groupBy(*by, "_i").agg(F.avg("_x").alias("_m"))
    packed = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_p"))
    return packed.select(*by, F.transform("_p", lambda p: p["_m"]).alias(out))


def head_logits(x, weights: list[list[float]], bias: list[float]) -> Column:
    """x . w + b for each class of a small linear head."""
    return F.array(*[dot(x, F.array(*map(F.lit, map(float, w)))) + F.lit(float(b)) for w, b in zip(weights, bias, strict=True)])


def softmax(scores) -> Column:
    def share(e):
        return let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total))

    return let(F.array_max(scores), lambda top: let(F.transform(scores, lambda s: F.exp(s - top)), share))


def argmax(scores) -> Column:
    """0-based place of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("long")


def array_mse(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def array_l1(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def valid_vector(v, size: int) -> Column:
    """Declared length and every part finite; a null vector is not valid."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == size) & finite, F.lit(False))
