"""Any DataFrame as labelled series, without copying it: each series takes its time, value and labels from columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import NoStreamsMatchedError
from ..functions.types import MAX_TS, ValueType, convert, promote
from ..plans.planner import Selected
from ..plans.promql import Matcher, Selector


def matches(m: Matcher, label: Column) -> Column:
    """PromQL's matcher; a label that isn't there counts as the empty text, patterns cover the whole value. As plain
    comparisons wherever they can be, so that they reach the scan."""
    if m.op in ("=", "!="):
        hit, empty = label == m.value, m.value == ""
    elif re.fullmatch(r"\w+(\|\w+)*", m.value):
        hit, empty = label.isin(m.value.split("|")), False
    else:
        hit, empty = label.rlike(f"^(?:{m.value})$"), re.fullmatch(m.value, "") is not None
    if m.op[0] == "!":
        return label.isNotNull() & ~hit if empty else label.isNull() | ~hit
    return label.isNull() | hit if empty else label.isNotNull() & hit


def any_group(s: Selector, label) -> Column | None:
    groups = [reduce(and_, (matches(m, label(m.label)) for m in g)) for g in s.groups]
    return reduce(or_, groups) if groups else None


@dataclass(frozen=True)
class Series:
    """df's rows as the streams of one metric: one stream per combination of the label columns. within(start, end), if
    given, is a condition on plain columns that holds for every row between start and end, so that the scan can skip."""

    df: DataFrame
    ts: Column
    value: Column
    value_type: ValueType
    labels: dict[str, str] = field(default_factory=dict)
    within: Callable[[int, int], Column] | None = None


def micros_within(column: str) -> Callable[[int, int], Column]:
    """For a timestamp column without zone, read in UTC, whose series counts microseconds."""
    literal = lambda x: F.timestamp_micros(F.lit(min(x, 2**62))).cast("timestamp_ntz")
    return lambda start, end: (F.col(column) >= literal(start)) & (F.col(column) <= literal(end))


class TableSource:
    """A fixed set of metrics over DataFrames. Filters stay plain comparisons on columns, so they reach the scan.
    A metric may be spread over several Series of different types; they are promoted together. A metric given as a
    function is only built when a query names it."""

    def __init__(self, spark: SparkSession, metrics: dict[str, Series | list[Series] | Callable[[], Series | list[Series]]]):
        self.spark, self.metrics = spark, metrics
        self._built: dict[str, list[Series]] = {}
        self._known: dict[tuple, int] = {}  # streams that a selector matches; the tables don't change

    def _parts(self, name: str) -> list[Series]:
        if name not in self._built:
            given = self.metrics.get(name, [])
            given = given() if callable(given) else given
            self._built[name] = given if isinstance(given, list) else [given]
        return self._built[name]

    def _streams(self, s: Selector, i: int, p: Series, rows: DataFrame) -> int:
        """How many streams of a Series the selector matches: 0, 1 or more."""
        asked = (s.name, s.groups, i)
        if asked not in self._known:
            pinned = len(s.groups) == 1 and {m.label for m in s.groups[0] if m.op == "="} >= set(p.labels)
            if pinned or not p.labels:
                self._known[asked] = int(not rows.isEmpty())
            else:
                self._known[asked] = len(rows.select(*p.labels.values()).distinct().limit(2).collect())
        return self._known[asked]

    def select(self, s: Selector, start: int, end: int) -> Selected:
        parts = self._parts(s.name)
        if not parts:
            raise NoStreamsMatchedError(f"no stream matches {s.name}")
        kind = promote(*(p.value_type for p in parts))
        dfs, streams = [], 0
        for i, p in enumerate(parts):
            cond = any_group(s, lambda k, p=p: F.col(p.labels[k]) if k in p.labels else F.lit(None).cast("string"))
            rows = p.df if cond is None else p.df.where(cond)
            streams += self._streams(s, i, p, rows)
            dfs.append(self._shaped(s, p, rows, kind, start, end))
        if not streams:
            raise NoStreamsMatchedError(f"no stream matches {s}")
        return Selected(reduce(DataFrame.unionAll, dfs), kind, streams)

    @staticmethod
    def _shaped(s: Selector, p: Series, rows: DataFrame, kind: ValueType, start: int, end: int) -> DataFrame:
        names = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for k, c in sorted(p.labels.items())]
        if p.within is not None and end < MAX_TS:
            rows = rows.where(p.within(start, end))
        value = convert(p.value.cast(p.value_type.spark), p.value_type, kind)
        return rows.select(F.concat_ws(",", F.lit(s.name), *names).alias("stream_id"), p.ts.alias("ts"), value.alias("value")).where(F.col("ts").between(start, end))

    def hinted(self, op: str, s: Selector, start: int, end: int):
        return None
