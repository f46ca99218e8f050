"""Arithmetic between two series: full outer merge on time, with linear interpolation.

Out comes one row per timestamp of either side. A side without a sample there takes its first value before its first
sample, its last value after its last, else the straight line between its neighbours: rounded half away from zero if
both sides are integers, unrounded if either is Float64. If a side is empty, so is the result. Null values and null
timestamps are left out; of samples at the same time on one side the largest value counts.

The time axis is cut into RANGES ranges of about equally many samples, by approximate quantiles, and each of these into
PARTS of equal length; windows run within a part, and what a part needs from outside (the last sample before it, the
first after it) comes from one row per part. So no task ever sorts a whole series, however its times are spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import arithmetic
from ..functions.types import ValueType, promote

RANGES, PARTS = 32, 32


def _filled(side: str, kind: ValueType, rounded: bool, spark_type: str):
    """The side's value at ts from a (own sample), and its neighbours (t0, a0) before and (t1, a1) after."""
    c = lambda x: F.col(f"{side}{x}")
    t, t0, t1 = F.col("ts").cast("double"), c("0.ts").cast("double"), c("1.ts").cast("double")
    v0, v1 = c("0.v"), c("1.v")
    slope = (v1.cast("double") - v0.cast("double")) / (t1 - t0)
    line = (t - t0) * slope + v0.cast("double")
    between = (F.round(line) if rounded else line).cast(spark_type)
    return F.coalesce(c(""), F.when(v0.isNull(), v1).when(v1.isNull(), v0).otherwise(between))


def _range_of(bounds: list[int], low: int = 0, high: int | None = None) -> str:
    """How many of the ascending bounds are at or before ts, by halving, as SQL."""
    high = len(bounds) if high is None else high
    if low == high:
        return str(low)
    mid = (low + high) // 2
    return f"IF(ts < {bounds[mid]}L, {_range_of(bounds, low, mid)}, {_range_of(bounds, mid + 1, high)})"


def interpolated(op: str, left: DataFrame, lt: ValueType, right: DataFrame, rt: ValueType, ranges: int = RANGES, parts: int = PARTS) -> tuple[DataFrame, ValueType]:
    as_float = ValueType.FLOAT64 in (lt, rt)
    types = ("double", "double") if as_float else (lt.spark, rt.spark)
    kinds = (ValueType.FLOAT64, ValueType.FLOAT64) if as_float else (lt, rt)
    null = lambda k: F.lit(None).cast(types[k])
    live = F.col("value").isNotNull() & F.col("ts").isNotNull()
    a = left.where(live).select("ts", F.col("value").cast(types[0]).alias("a"), null(1).alias("b"))
    b = right.where(live).select("ts", null(0).alias("a"), F.col("value").cast(types[1]).alias("b"))
    both = a.unionAll(b)
    shares = [i / ranges for i in range(1, ranges)]
    low, high, cuts = both.agg(F.min("ts"), F.max("ts"), F.percentile_approx("ts", F.lit(shares or [0.5]), 10_000)).first()
    bounds = sorted(set(cuts or [])) if shares else []
    starts = [low or 0, *bounds]
    widths = [max(1, (b - a) // parts + 1) for a, b in zip(starts, [*bounds, (high or 0) + 1])]
    at = lambda xs: F.element_at(F.expr(f"array({', '.join(f'{x}L' for x in xs)})"), F.col("range") + 1)
    part = F.floor((F.col("ts") - at(starts)) / at(widths)).cast("bigint")
    ranged = both.withColumn("range", F.expr(_range_of(bounds))).withColumn("bucket", F.col("range") * (parts + 1) + part).drop("range").repartition("bucket")
    points = ranged.groupBy("bucket", "ts").agg(F.max("a").alias("a"), F.max("b").alias("b"))

    def point(x: str):
        return F.when(F.col(x).isNotNull(), F.struct("ts", F.col(x).alias("v")))

    # One row per part, at most ranges * (parts + 1) of them: its first and last sample of each side.
    edges = points.groupBy("bucket").agg(*(f(F.when(F.col(x).isNotNull(), F.struct("ts", F.col(x).alias("v")))).alias(f"{x}_{n}") for x in "ab" for n, f in (("first", F.min), ("last", F.max))))
    order = Window.orderBy("bucket")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    edges = edges.select("bucket", *(F.last(f"{x}_last", ignorenulls=True).over(before).alias(f"{x}_in") for x in "ab"), *(F.first(f"{x}_first", ignorenulls=True).over(after).alias(f"{x}_out") for x in "ab"))
    own = Window.partitionBy("bucket").orderBy("ts")
    past, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    wide = points.join(F.broadcast(edges), "bucket").select(
        "ts", "a", "b",
        *(F.coalesce(F.last(point(x), ignorenulls=True).over(past), F.col(f"{x}_in")).alias(f"{x}0") for x in "ab"),
        *(F.coalesce(F.first(point(x), ignorenulls=True).over(ahead), F.col(f"{x}_out")).alias(f"{x}1") for x in "ab"),
    )
    rounded = not as_float
    value, kind = arithmetic(op, F.col("x"), kinds[0], F.col("y"), kinds[1])
    out = wide.select("ts", _filled("a", lt, rounded, types[0]).alias("x"), _filled("b", rt, rounded, types[1]).alias("y"))
    out = out.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    assert kind in (ValueType.FLOAT64, promote(lt, rt))
    return out.select(F.lit(None).cast("string").alias("stream_id"), "ts", value.alias("value")), kind
