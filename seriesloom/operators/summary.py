"""Aggregates answered from per-file statistics: files wholly inside the range give their one row, only the files at
its edges are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.types import ValueType
from .aggregate import measure


def summarise(samples: DataFrame, value: str = "value", by: tuple[str, ...] = ("stream_id", "file_id")) -> DataFrame:
    """One row per file: its time range, count, sum, least, greatest and first value. Null values don't count.
    NaN counts as in the aggregates: in sums, but as least or greatest only if there is nothing else."""
    v = F.col(value)
    rows = samples.where(v.isNotNull())
    return rows.groupBy(*by).agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("n"), F.sum(v).alias("value_sum"), F.min(v).alias("min_value"), F.coalesce(F.max(F.when(~F.isnan(v.cast("double")), v)), F.max(v)).alias("max_value"), F.min_by(v, "ts").alias("first_value"))


def from_summary(op: str, summary: DataFrame, samples: DataFrame, kind: ValueType, start: int, end: int, by: tuple[str, ...] = ("stream_id", "file_id")) -> tuple[DataFrame, ValueType]:
    """The aggregate of samples between start and end. summary and samples are already those of the selected streams;
    samples carry the columns in `by`. Equal to aggregating the samples themselves."""
    inside = (F.col("min_ts") >= start) & (F.col("max_ts") <= end)
    meets = (F.col("max_ts") >= start) & (F.col("min_ts") <= end)
    edge = summary.where(meets & ~inside).select(*by)
    rest = samples.where(F.col("ts").between(start, end)).join(edge, list(by), "left_semi").where(F.col("value").isNotNull())
    total = F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), measure("max", F.col("value"), kind, True)[0].alias("hi")
    parts = summary.where(inside).select(F.col("value_sum").alias("s"), "n", F.col("min_value").alias("lo"), F.col("max_value").alias("hi")).unionByName(rest.agg(*total))
    s, n = F.sum("s"), F.coalesce(F.sum("n"), F.lit(0))
    value, to = {
        "sum": lambda: (s, kind),
        "count": lambda: (n.cast(kind.spark), kind),
        "avg": lambda: (s.cast("double") / F.nullif(n, F.lit(0)).cast("double"), ValueType.FLOAT64),
        "min": lambda: (F.min("lo"), kind),
        "max": lambda: (measure("max", F.col("hi"), kind, True)[0], kind),
    }[op]()
    return parts.agg(value.alias("value")).where(F.col("value").isNotNull()).select(F.lit(1).alias("idx"), F.col("value").cast(to.spark if op != "sum" or to is not ValueType.UINTEGER64 else "decimal(38,0)").alias("value")), to
