"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dot(left: Column | str, right: Column | str) -> Column:
    """Inner product in double precision; on unit vectors this is the cosine similarity."""
    products = F.zip_with(_col(left), _col(right), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_normalize(vector: Column | str) -> Column:
    """Unit vector; a zero vector stays zero, so it has similarity 0 and never NaN."""
    vector = _col(vector)
    norm = F.sqrt(dot(vector, vector))
    safe = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return F.transform(vector, lambda x: x.cast("double") / safe)


def clean_refs(refs: Column | str, count: Column | str | int) -> Column:
    """Citation numbers: keep 1..count, make them zero-based, sort, drop repeats (C17)."""
    count = F.lit(count) if isinstance(count, int) else _col(count)
    kept = F.filter(_col(refs), lambda n: (n >= 1) & (n <= count))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda n: n - 1)))
