"""Vectors as arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def format_vector(v: Column) -> Column:
    """"[0.100000,...]", six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def decide(similarity: Column, merge: float = 0.90, low: float = 0.75) -> Column:
    """new, tiebreak or merge; both bounds belong to the upper side, no similarity means new."""
    return F.when(similarity.isNull() | (similarity < low), "new").when(similarity < merge, "tiebreak").otherwise("merge")
