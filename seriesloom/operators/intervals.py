"""Continuous periods and gaps of time intervals, by a sweep line.

Every interval gives +1 at its start and -1 just after its end; the running sum is the number of active intervals.
Where it leaves zero a period starts, where it returns to zero a gap may. Events are first summed per entity and
time, then cut into time ranges: running sums are taken within a range and added to the count at the range's start,
which comes from one row per entity and range. So a single entity with a third of all intervals spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut

RANGE = 86_400_000
LAST = 2**63 - 1


def _base(rows: DataFrame, what, name: str, order_after: bool) -> DataFrame:
    """Per entity and range: the sum of `what` over earlier ranges, or its least value over later ones."""
    per = rows.groupBy("entity", "bucket").agg(what.alias("x"))
    w = Window.partitionBy("entity").orderBy("bucket")
    over = F.first("x").over(w.rowsBetween(1, 1)) if order_after else F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.select("entity", "bucket", over.alias(name))


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, width: int = RANGE) -> DataFrame:
    """(entity, kind, start, end) with kind 'covered' or 'gap', both ends included, in the units of start and end
    (whole numbers). A row covers start to end; a null end means open-ended. Rows with a null entity, a null start
    or an end before the start cover nothing. Adjoining intervals (5 after 4) merge. A covered period without an end
    has a null end; a gap always lies between two covered periods. Repeated rows change nothing. No rows, no result.
    width: length of a time range; it doesn't change the result."""
    rows = df.select(F.col(entity).alias("entity"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
    rows = rows.where(F.col("entity").isNotNull() & F.col("s").isNotNull() & (F.col("e").isNull() | (F.col("e") >= F.col("s"))))
    close = F.when(F.col("e").isNotNull() & (F.col("e") < LAST), F.struct((F.col("e") + 1).alias("t"), F.lit(-1).cast("bigint").alias("d")))
    events = rows.select("entity", F.explode(F.array_compact(F.array(F.struct(F.col("s").alias("t"), F.lit(1).cast("bigint").alias("d")), close))).alias("v")).select("entity", "v.t", "v.d")
    deltas = cut(events.groupBy("entity", F.floor(F.col("t") / F.lit(width)).cast("bigint").alias("bucket"), "t").agg(F.sum("d").alias("d")), "deltas")
    own = Window.partitionBy("entity", "bucket").orderBy("t")
    active = F.col("base") + F.sum("d").over(own)
    counted = deltas.join(_base(deltas, F.sum("d"), "base", False), ["entity", "bucket"]).withColumn("active", active)
    turns = counted.where((F.col("active") == 0) != (F.col("active") == F.col("d"))).select("entity", "bucket", "t", (F.col("active") > 0).alias("on"))
    paired = turns.join(_base(turns, F.min("t"), "later", True), ["entity", "bucket"]).withColumn("next", F.coalesce(F.lead("t").over(own), F.col("later")))
    kind = F.when(F.col("on"), "covered").otherwise("gap")
    return paired.where(F.col("on") | F.col("next").isNotNull()).select("entity", kind.alias("kind"), F.col("t").alias("start"), (F.col("next") - 1).alias("end"))
