"""Vector expressions as Columns; all arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; NULL if either is NULL or has another length."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 + inner product: 0..2 for unit vectors."""
    return 1 + dot(a, b)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; NULL for zero vectors."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column | str, eps: float = 1e-8) -> Column:
    """Unit length; a zero vector stays zero."""
    return F.transform(_col(a), lambda x: x.cast("double") / F.greatest(norm(a), F.lit(eps)))


def mean(a: Column | str, dim: int) -> Column:
    """Element-wise mean as one hash aggregate with ``dim`` buffers: nothing is exploded, and maps pre-aggregate."""
    return F.array(*(F.avg(F.element_at(_col(a), i + 1).cast("double")) for i in range(dim)))


def to_text(a: Column | str, digits: int = 8) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(_col(a), lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), ","), F.lit("]"))


def from_text(a: Column | str) -> Column:
    """A vector from text or bytes like ``[0.1,2]``; NULL where it cannot be read."""
    return F.from_json(_col(a).cast("string"), "array<float>")


def literal(values: list[float]) -> Column:
    return F.lit([float(x) for x in values]).cast("array<double>")
