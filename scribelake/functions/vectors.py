"""Vectors as arrays of numbers, by higher-order functions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = lambda x, y: x.cast("double") * y.cast("double")
    return F.aggregate(F.zip_with(a, b, product), F.lit(0.0), lambda s, x: s + x)


def fused_dot(a: Column, b: Column) -> Column:
    """``dot`` by fused multiply-add: each product is added before it is rounded."""
    fma = lambda s, x, y: F.java_method(F.lit("java.lang.Math"), F.lit("fma"), x, y, s).cast("double")
    pair = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.aggregate(F.zip_with(a, b, pair), F.lit(0.0), lambda s, p: fma(s, p["x"], p["y"]))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Of unit length; the zero vector stays."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))
