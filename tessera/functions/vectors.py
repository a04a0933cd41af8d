"""Vector arithmetic on array columns, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Squared norms at or below this count as zero.
EPSILON = 2.220446049250313e-16


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """v divided by its norm. Filter with is_valid first; a zero vector gives null.

    The norm is bound to a lambda variable: written straight into the inner function it would be computed again for every component."""
    divided = F.transform(F.array(norm(v)), lambda n: F.when(n > EPSILON, F.transform(v, lambda x: x / n)))
    return F.element_at(divided, 1)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def is_valid(v: Column) -> Column:
    """Whether a vector has finite components and a norm above epsilon."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (norm(v) > EPSILON), F.lit(False))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mean_vector(column: str) -> Column:
    """Component means as an aggregate: partial sums per task, so a large group shuffles one row a task, and no code is generated per component."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.mean(array_to_vector(F.col(column))))
