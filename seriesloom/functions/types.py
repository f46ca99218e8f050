"""Value types of streams, their promotion and their Spark types."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, functions as F

MAX_I64 = 2**63 - 1
MAX_TS = MAX_I64


class ValueType(Enum):
    """INTEGER64 is BIGINT, UINTEGER64 DECIMAL(20,0) since Spark has no unsigned type, FLOAT64 DOUBLE."""

    INTEGER64 = "Integer64"
    UINTEGER64 = "UInteger64"
    FLOAT64 = "Float64"

    @property
    def spark(self) -> str:
        return {"Integer64": "bigint", "UInteger64": "decimal(20,0)", "Float64": "double"}[self.value]

    @property
    def column(self) -> str:
        return {"Integer64": "v_i64", "UInteger64": "v_u64", "Float64": "v_f64"}[self.value]

    @classmethod
    def of(cls, text: str) -> ValueType:
        short = {"i64": cls.INTEGER64, "u64": cls.UINTEGER64, "f64": cls.FLOAT64}
        return short[text] if text in short else cls(text)


def promote(*kinds: ValueType) -> ValueType:
    """Float64 if any is, else Integer64 if any is, else UInteger64."""
    for kind in (ValueType.FLOAT64, ValueType.INTEGER64):
        if kind in kinds:
            return kind
    return ValueType.UINTEGER64


def convert(c: Column, source: ValueType, target: ValueType) -> Column:
    """c as the target type. An unsigned value of 2^63 or more becomes the signed number with the same 64 bits;
    a float becomes an integer by truncation, saturating at the type's ends, NaN as 0."""
    if source is target:
        return c
    if target is ValueType.FLOAT64:
        return c.cast("double")
    if source is ValueType.UINTEGER64:
        two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
        return F.when(c > F.lit(MAX_I64).cast("decimal(20,0)"), c - two64).otherwise(c).cast("bigint")
    if source is ValueType.FLOAT64:
        low, high, kind = ("-9223372036854775808", str(MAX_I64), "bigint") if target is ValueType.INTEGER64 else ("0", "18446744073709551615", "decimal(20,0)")
        inside = (c > F.lit(low).cast("double")) & (c < F.lit(high).cast("double"))
        ends = F.when(c >= F.lit(high).cast("double"), F.lit(high).cast(kind)).otherwise(F.lit(low).cast(kind))
        whole = F.when(inside, F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)))
        return F.when(F.isnan(c), F.lit(0).cast(kind)).when(inside, whole.cast(kind)).when(c.isNotNull(), ends)
    return c.cast("decimal(20,0)")
