"""A series as a text plot. Spark brings it down to one row per column first."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F


def columns(df: DataFrame, width: int) -> list[tuple[float, float] | None]:
    """Least and greatest value in each of `width` equal parts of the time range; None where there is none."""
    ends = df.agg(F.min("ts"), F.max("ts")).first()
    if ends is None or ends[0] is None:
        return []
    span = max(1, ends[1] - ends[0])
    at = F.least(F.floor((F.col("ts") - ends[0]).cast("double") / span * width), F.lit(width - 1)).cast("int")
    v = F.col("value").cast("double")
    rows = df.where(~F.isnan(v) & (F.abs(v) < float("inf"))).groupBy(at.alias("x")).agg(F.min(v), F.max(v)).collect()
    out: list[tuple[float, float] | None] = [None] * width
    for x, low, high in rows:
        out[x] = (low, high)
    return out


def plot(df: DataFrame, width: int = 180, height: int = 60) -> str:
    """df(ts, value); values that aren't finite are left out, and an empty series gives an empty text."""
    cols = columns(df, width)
    seen = [c for c in cols if c]
    if not seen:
        return ""
    low, high = min(c[0] for c in seen), max(c[1] for c in seen)
    scale = (high - low) or 1.0
    row = lambda v: min(height - 1, math.floor((v - low) / scale * height))
    grid = [[" "] * width for _ in range(height)]
    for x, c in enumerate(cols):
        if c:
            for y in range(row(c[0]), row(c[1]) + 1):
                grid[height - 1 - y][x] = "*"
    return "\n".join([f"{high:g}", *("".join(r).rstrip() for r in grid), f"{low:g}"])
