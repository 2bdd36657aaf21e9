"""Vector distances as expressions over arrays, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


METRICS = {"cosine": cosine_distance, "inner_product": negative_inner_product, "l2": l2_distance}
