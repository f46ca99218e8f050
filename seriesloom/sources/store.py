"""The store's tables as the series operators want them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import canonical_id
from ..session import spread

#: Bounds of a plausible ts in milliseconds: 2018-01-01 (included) to 2027-01-01 (excluded).
FIRST_MS, LAST_MS = 1_514_764_800_000, 1_798_761_600_000


def plausible(samples: DataFrame, *also: str) -> DataFrame:
    """(seq, stream_id, name, ts, value, and the columns in `also`) of the rows with a stream, a plausible ts and a value, NaN and infinities
    included. Stream ids are canonical."""
    keep = F.col("stream_id").isNotNull() & F.col("value").isNotNull() & (F.col("ts") >= FIRST_MS) & (F.col("ts") < LAST_MS)
    rows = spread(samples.where(keep).select("seq", "stream_id", "name", "ts", "value", *also))
    return rows.select("seq", canonical_id(F.col("stream_id")).alias("stream_id"), "name", "ts", "value", *also)


def finite(rows: DataFrame) -> DataFrame:
    v = F.col("value")
    return rows.where(~F.isnan(v) & (F.abs(v) < float("inf")))


def named(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `metric`: the row's own name, else the one that other rows of its stream have, else null. Only the
    nameless rows are joined, to one row per stream."""
    # Distinct names first, which needs no order: the least of texts is a sort, over few rows then.
    names = rows.where(F.col("name").isNotNull()).select("stream_id", "name").distinct().groupBy("stream_id").agg(F.min("name").alias("metric"))
    own = rows.where(F.col("name").isNotNull()).select(*columns, F.col("name").alias("metric"))
    return own.unionByName(rows.where(F.col("name").isNull()).select(*columns).join(names, "stream_id", "left"))


def with_catalog(rows: DataFrame, catalog: DataFrame, fields: tuple[str, ...] = ("step_ms",)) -> DataFrame:
    """rows joined to their metric's entry; rows of unknown metrics drop out. The catalogue has one row per metric;
    Spark broadcasts it as long as its size is under the session's threshold."""
    return rows.join(catalog.select(F.col("name").alias("metric"), *fields), "metric")


def readings(spark: SparkSession, d: str, *also: str) -> DataFrame:
    return finite(plausible(spark.read.parquet(f"{d}/samples.parquet"), *also))
