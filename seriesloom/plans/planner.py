"""Query tree to DataFrame plan. Planning reads only the catalogue, but for a computed k, and for arithmetic between two
series the quantiles of their times; Spark optimises and runs the rest."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..errors import QuerySyntaxError, TimeRangeError, UnsupportedError
from ..functions.numeric import ARITHMETIC, fold
from ..functions.types import MAX_TS, ValueType
from ..operators import aggregate as agg
from ..operators import arithmetic as arith
from ..operators.interpolate import interpolated
from ..operators.topk import first_k
from . import promql as q


@dataclass(frozen=True)
class Plan:
    """kind 'vector': df(stream_id, ts, value); kind 'scalar': df(idx, value), of 0 to n rows. A literal has no df
    until it is the whole query. streams: how many series a vector holds, as far as it matters (1 or more)."""

    kind: str
    value_type: ValueType
    df: DataFrame | None = None
    literal: float | None = None
    streams: int = 1
    selector: tuple | None = None


@dataclass(frozen=True)
class Selected:
    df: DataFrame
    value_type: ValueType
    streams: int


class Source(Protocol):
    """Where selectors find their streams."""

    spark: SparkSession

    def select(self, selector: q.Selector, start: int, end: int) -> Selected: ...

    def hinted(self, op: str, selector: q.Selector, start: int, end: int) -> tuple[DataFrame, ValueType] | None:
        """The aggregate from pre-aggregated files, if the source keeps them."""


class Planner:
    def __init__(self, source: Source, start: int | None, end: int | None, hints: bool = True):
        if start is not None and end is not None and start > end:
            raise TimeRangeError(f"start {start} is after end {end}")
        self.source, self.start, self.end, self.hints = source, start, end, hints

    def plan(self, text: str) -> Plan:
        p = self.expr(q.parse(text))
        if p.df is None:
            p = Plan("scalar", p.value_type, arith.literal(self.source.spark, p.literal), p.literal)
        return p

    def expr(self, e) -> Plan:
        if isinstance(e, q.Number):
            return Plan("scalar", ValueType.FLOAT64, literal=e.value)
        if isinstance(e, q.Refused):
            raise UnsupportedError(e.label)
        if isinstance(e, q.Unary):
            raise UnsupportedError("Unary")
        if isinstance(e, q.Selector):
            return self.selector(e)
        if isinstance(e, q.Binary):
            return self.binary(e)
        if isinstance(e, q.Aggregate):
            return self.aggregate(e)
        raise QuerySyntaxError(f"can't plan {type(e).__name__}")

    def range_of(self, s: q.Selector) -> tuple[int, int]:
        start, end = self.start, self.end
        if s.offset_ms is not None and s.at is None:
            raise UnsupportedError("offset without @")
        if s.at is not None:
            start = 0 if s.at == "start" else MAX_TS if s.at == "end" else int(s.at * 1000)
            start = max(0, min(MAX_TS, start + (s.offset_ms or 0)))
        if start is None:
            raise TimeRangeError("start is missing")
        if end is None:
            raise TimeRangeError("end is missing")
        return start, end

    def selector(self, s: q.Selector) -> Plan:
        start, end = self.range_of(s)
        got = self.source.select(s, start, end)
        return Plan("vector", got.value_type, got.df, streams=got.streams, selector=(s, start, end))

    def binary(self, e: q.Binary) -> Plan:
        left, right = self.expr(e.left), self.expr(e.right)
        math = e.op in ARITHMETIC
        if left.kind == right.kind == "scalar":
            if not math:
                raise UnsupportedError("comparison of two scalars")
            if left.df is None and right.df is None:
                return Plan("scalar", ValueType.FLOAT64, literal=fold(e.op, left.literal, right.literal))
            df, kind = arith.scalar_scalar(e.op, left, right)
            return Plan("scalar", kind, df)
        if left.kind == right.kind:
            if not math:
                raise UnsupportedError("comparison of two vectors")
            if left.streams > 1 or right.streams > 1:
                raise UnsupportedError("arithmetic on several streams a side")
            df, kind = interpolated(e.op, left.df, left.value_type, right.df, right.value_type)
            return Plan("vector", kind, df)
        vector, scalar, swapped = (left, right, False) if left.kind == "vector" else (right, left, True)
        if math:
            df, kind = arith.vector_scalar(e.op, vector, scalar, swapped)
        else:
            df, kind = arith.filtered(e.op, vector, scalar, swapped), vector.value_type
        return Plan("vector", kind, df, streams=vector.streams)

    def aggregate(self, e: q.Aggregate) -> Plan:
        if e.grouping is not None:
            warnings.warn("by and without don't group here: aggregates cover the whole vector", stacklevel=2)
        child = self.expr(e.operand)
        if child.kind != "vector":
            raise UnsupportedError(f"{e.op} over a scalar")
        if e.op in q.SELECTING:
            k = self.expr(e.param)
            if k.kind != "scalar":
                raise QuerySyntaxError(f"{e.op} needs a scalar as its first argument")
            return Plan("scalar", child.value_type, first_k(e.op, k, child))
        if self.hints and child.selector and (done := self.source.hinted(e.op, *child.selector)):
            return Plan("scalar", done[1], done[0])
        df, kind = agg.aggregate(e.op, child.df, child.value_type, direct=child.selector is not None)
        return Plan("scalar", kind, df)
