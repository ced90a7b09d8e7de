"""Vector and score expressions; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COSINE, DOT, EUCLIDEAN = "cosine", "dot", "euclidean"


def vector_literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0, kept within -1 and 1."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def euclidean_similarity(a: Column, b: Column) -> Column:
    return 1 / (1 + euclidean_distance(a, b))


def similarity(metric: str, a: Column, b: Column) -> Column:
    """By the collection's metric; an unknown metric counts as cosine."""
    return {DOT: dot, EUCLIDEAN: euclidean_similarity}.get(metric, cosine)(a, b)


def is_valid_vector(v: Column, dimension: int | Column) -> Column:
    """As many elements as the dimension, all finite numbers."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimension) & finite, F.lit(False))


def require_vector(v: Column, dimension: int) -> Column:
    """The vector, or an error where it isn't valid."""
    return F.when(is_valid_vector(v, dimension), v).otherwise(F.raise_error(F.concat(F.lit(f"not a vector of {dimension} finite numbers: "), F.coalesce(v.cast("string"), F.lit("null")))).cast("array<double>"))


def min_max(df: DataFrame, score: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``out``: the score as a share of the way from the least to the greatest; 1 where all are equal. For ranked candidates: without ``by`` it moves all rows to one task."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(F.col(score).isNull(), None).when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def fusion_weights(dense: float, sparse: float) -> tuple[float, float]:
    total = dense + sparse
    return (dense / total, sparse / total) if total > 0 else (0.5, 0.5)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """Of normalised strings: 1 if equal, 0 if one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


#: Fixed values of the 32-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def fnv1a(text: Column) -> Column:
    """FNV-1a over the UTF-16 units of a text, read as a signed 32-bit number without its sign."""

    def units(c: Column) -> Column:
        p = F.ascii(c).cast("bigint")
        over = p - 65536
        return F.when(p > 65535, F.array(F.shiftright(over, 10) + 55296, over.bitwiseAND(F.lit(1023)) + 56320)).otherwise(F.array(p))

    codes = F.flatten(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), units))
    h = F.aggregate(codes, F.lit(FNV_BASIS).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(4294967295)))
    return F.when(h >= 2147483648, F.lit(4294967296) - h).otherwise(h)
