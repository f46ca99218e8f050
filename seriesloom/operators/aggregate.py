"""Whole-vector aggregates: one partial and one final aggregation, no sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import nan_last_max
from ..functions.types import ValueType


def measure(op: str, value: Column, kind: ValueType, direct: bool) -> tuple[Column, ValueType]:
    """The aggregate of value and its type. direct: the operand is a bare selector, whose count takes its type."""
    if op == "count":
        to = kind if direct else ValueType.UINTEGER64
        return F.count(value).cast(to.spark), to
    if op == "avg":
        return F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0)).cast("double"), ValueType.FLOAT64
    if op == "max" and kind is ValueType.FLOAT64:
        return nan_last_max(value), kind
    return {"sum": F.sum, "min": F.min, "max": F.max}[op](value), kind


def aggregate(op: str, df: DataFrame, kind: ValueType, direct: bool) -> tuple[DataFrame, ValueType]:
    """A scalar of one row, or of none where there is nothing to aggregate; count gives 0 then."""
    value, to = measure(op, F.col("value"), kind, direct)
    return df.agg(value.alias("value")).where(F.col("value").isNotNull()).select(F.lit(1).alias("idx"), "value"), to
