"""Arithmetic and filters between a vector and a scalar, and between scalars.

A scalar that is computed is a one-column subquery of one row, so no join is planned. Scalars of several values
(top-k) count by their first value against a vector and are zipped by idx against one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import MIRRORED, arithmetic, compare
from ..functions.types import ValueType


def literal(spark: SparkSession, value: float) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("idx"), F.lit(float(value)).alias("value"))


def as_column(scalar) -> Column:
    """The scalar's first value as a column; null if it has none."""
    if scalar.df is None:
        return F.lit(float(scalar.literal))
    return scalar.df.where(F.col("idx") == 1).select("value").scalar()


def vector_scalar(op: str, vector, scalar, swapped: bool) -> tuple[DataFrame, ValueType]:
    """One row out for each row in; none if the scalar has no value. swapped: the scalar stands on the left."""
    s, v = as_column(scalar), F.col("value")
    a, b = ((s, scalar.value_type), (v, vector.value_type)) if swapped else ((v, vector.value_type), (s, scalar.value_type))
    value, kind = arithmetic(op, *a, *b)
    df = vector.df if scalar.df is None else vector.df.where(s.isNotNull())
    return df.withColumn("value", value), kind


def filtered(op: str, vector, scalar, swapped: bool) -> DataFrame:
    """The rows whose value compares true, with their own value and type."""
    op = MIRRORED[op] if swapped else op
    return vector.df.where(compare(op, F.col("value"), vector.value_type, as_column(scalar), scalar.value_type))


def scalar_scalar(op: str, left, right) -> tuple[DataFrame, ValueType]:
    """Zipped by idx; ends with the shorter. A literal is one value, at idx 1."""
    if left.df is None or right.df is None:
        many = right if left.df is None else left
        a, b = ((as_column(left), left.value_type), (F.col("value"), right.value_type)) if left.df is None else ((F.col("value"), left.value_type), (as_column(right), right.value_type))
        value, kind = arithmetic(op, *a, *b)
        return many.df.where(F.col("idx") == 1).select("idx", value.alias("value")), kind
    value, kind = arithmetic(op, F.col("a"), left.value_type, F.col("b"), right.value_type)
    both = left.df.select("idx", F.col("value").alias("a")).join(right.df.select("idx", F.col("value").alias("b")), "idx")
    return both.select("idx", value.alias("value")), kind
