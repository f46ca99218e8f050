"""topk and bottomk: the k largest or smallest values, as a scalar of k values in order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.types import ValueType


def evaluate_k(k) -> int:
    """k's first value, cut to a whole number; negative, NaN and missing count as 0. A computed k is one value."""
    value = k.literal
    if k.df is not None:
        row = k.df.where(F.col("idx") == 1).select("value").first()
        value = None if row is None else row[0]
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return 0
    return int(min(max(value, 0), 2**63 - 1))


def first_k(op: str, k, vector) -> DataFrame:
    """Each partition keeps its own k rows and only those meet (TakeOrderedAndProject); the numbering runs over k rows.
    NaN and null never count. Ties are alike, as only values are returned."""
    v = F.col("value")
    order = v.desc() if op == "topk" else v.asc()
    df = vector.df.where(v.isNotNull())
    if vector.value_type is ValueType.FLOAT64:
        df = df.where(~F.isnan(v))
    most = evaluate_k(k)
    kept = df.select("value").orderBy(order)
    kept = kept.limit(most) if most < 2**31 else kept  # a limit is an int; so many rows are all there are
    return kept.select(F.row_number().over(Window.orderBy(order)).alias("idx"), "value")
