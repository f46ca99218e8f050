"""CSV in and out: a header row, then time and value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import LoomError
from ..functions.types import ValueType


class CsvError(LoomError, ValueError):
    """A cell can't be read as its type."""


def read_csv(spark: SparkSession, path: str, kind: ValueType) -> DataFrame:
    """(ts, value) of a file with a header row. A bad cell is an error that names the first such line; negative times
    and, for UInteger64, negative values are bad cells. A file without rows gives no rows."""
    raw = spark.read.csv(path, header=True, schema="ts STRING, value STRING", enforceSchema=True)
    ts, value = F.expr("try_cast(trim(ts) AS BIGINT)"), F.expr(f"try_cast(trim(value) AS {kind.spark})")
    whole = F.lit(True) if kind is ValueType.FLOAT64 else F.trim("value").rlike(r"^[+-]?\d+$")
    good = ts.isNotNull() & (ts >= 0) & value.isNotNull() & whole & F.trim("ts").rlike(r"^\+?\d+$")
    if kind is ValueType.UINTEGER64:
        good = good & (value >= 0) & (value <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    bad = raw.where(~F.coalesce(good, F.lit(False))).first()
    if bad is not None:
        lines = (x for f in sorted({r[0] for r in spark.read.text(path).select(F.input_file_name()).distinct().collect()}) for x in enumerate(spark.read.text(f).toLocalIterator(), 1))
        cells = [",".join("" if c is None else c for c in bad)]
        at = next((n for n, r in lines if n > 1 and r[0].replace('"', "").rstrip(",") == cells[0].rstrip(",")), None)
        raise CsvError(f"line {at}: can't read {tuple(bad)} as {kind.value}")
    return raw.select(ts.alias("ts"), value.alias("value"))


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """A vector result as Timestamp,Value with values as doubles, in order of time: one file, or for large results
    several that follow one another in the order of their names."""
    rows = df.select(F.col("ts").alias("Timestamp"), F.col("value").cast("double").alias("Value")).orderBy("Timestamp")
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").csv(path, header=True)
