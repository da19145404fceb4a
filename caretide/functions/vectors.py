"""Dense vector expressions."""

from pyspark.sql import Column, functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def cosine_similarity(a: Column, b: Column) -> Column:
    """NaN when a vector is all zeros, NULL when one is missing."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    value = F.coalesce(F.try_divide(_dot(a, b), norms), F.lit(float("nan")))
    return F.when(a.isNotNull() & b.isNotNull(), value)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def normalize_dim(vector: Column, dim: int) -> Column:
    """Pad with zeros or cut to ``dim`` entries."""
    padding = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(dim) - F.size(vector)))
    return F.when(vector.isNotNull(), F.slice(F.concat(vector.cast("array<float>"), padding), 1, dim))


def is_missing(vector: Column) -> Column:
    """No vector yet, or only the zero placeholder."""
    return vector.isNull() | ~F.exists(vector, lambda x: x != 0)


def first_available(*vectors: Column) -> Column:
    return F.coalesce(*vectors)
