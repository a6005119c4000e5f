"""Vector columns: casts, length checks, norms, text precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(vector: Column, dim: int | None = None) -> Column:
    """``array<double>``; with ``dim`` given, another length fails the job."""
    vector = vector.cast("array<double>")
    if dim is None:
        return vector
    wrong = F.raise_error(
        F.concat(F.lit(f"embedding length differs from {dim}: "), F.size(vector).cast("string"))
    )
    return F.when(vector.isNull() | (F.size(vector) == dim), vector).otherwise(wrong)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def text_precision(vector: Column, digits: int = 8) -> Column:
    """Vector rounded to the digits a text load keeps."""
    return F.transform(vector, lambda x: F.round(x, digits))
