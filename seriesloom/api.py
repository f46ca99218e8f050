"""Connection, Inserter and Query: the programming interface to a store."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import CatalogError, ValueTypeError
from .functions.types import ValueType
from .plans.planner import Plan, Planner, Source
from .plans.promql import parse_identity
from .sources.csv import read_csv
from .sources.warehouse import Warehouse

LIMITS = {ValueType.INTEGER64: (-(2**63), 2**63 - 1), ValueType.UINTEGER64: (0, 2**64 - 1)}


class Query:
    """A planned query. `df` is its lazy result: (ts, value) in order of time for a vector, (idx, value) in order for a
    scalar. next_scalar and next_vector walk through it and end with None."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self._rows: Iterator | None = None

    @property
    def value_type(self) -> ValueType:
        return self.plan.value_type

    @property
    def return_type(self) -> str:
        return self.plan.kind

    @property
    def df(self) -> DataFrame:
        if self.plan.kind == "scalar":
            return self.plan.df.select("idx", "value").orderBy("idx")
        cols = self.plan.df.columns
        return self.plan.df.orderBy("ts", "stream_id").select("ts", "value") if "stream_id" in cols else self.plan.df.orderBy("ts")

    def _next(self):
        if self._rows is None:
            self._rows = self.df.toLocalIterator()
        return next(self._rows, None)

    def next_scalar(self):
        if self.plan.kind != "scalar":
            raise TypeError("the result is a vector")
        row = self._next()
        return None if row is None else self._python(row["value"])

    def next_vector(self):
        if self.plan.kind != "vector":
            raise TypeError("the result is a scalar")
        row = self._next()
        return None if row is None else (row["ts"], self._python(row["value"]))

    def _python(self, value):
        return float(value) if self.value_type is ValueType.FLOAT64 else int(value)


class Inserter:
    """Buffers typed samples of one stream; they can be read after flush. Times may come in any order and repeat."""

    def __init__(self, store: Warehouse, stream_id: str, kind: ValueType, batch: int = 1_000_000):
        self.store, self.stream_id, self.value_type, self.batch = store, stream_id, kind, batch
        self.rows: list[tuple] = []

    def _insert(self, ts: int, value, kind: ValueType) -> None:
        if kind is not self.value_type:
            raise ValueTypeError(f"the stream holds {self.value_type.value}, not {kind.value}")
        if kind in LIMITS and not LIMITS[kind][0] <= value <= LIMITS[kind][1]:
            raise ValueTypeError(f"{value} is out of range for {kind.value}")
        if not 0 <= ts <= 2**63 - 1:
            raise ValueTypeError(f"time {ts} is out of range")
        self.rows.append((ts, float(value) if kind is ValueType.FLOAT64 else int(value)))
        if len(self.rows) >= self.batch:
            self.flush()

    def insert_integer64(self, ts: int, value: int) -> None:
        self._insert(ts, value, ValueType.INTEGER64)

    def insert_uinteger64(self, ts: int, value: int) -> None:
        self._insert(ts, value, ValueType.UINTEGER64)

    def insert_float64(self, ts: int, value: float) -> None:
        self._insert(ts, value, ValueType.FLOAT64)

    def flush(self) -> None:
        if not self.rows:
            return
        from decimal import Decimal

        unsigned = self.value_type is ValueType.UINTEGER64
        data = [(self.stream_id, t, Decimal(v) if unsigned else v) for t, v in self.rows]
        self.store.append(self.store.spark.createDataFrame(data, f"stream_id string, ts bigint, {self.value_type.column} {self.value_type.spark}").coalesce(1))
        self.rows = []


class Connection:
    """A store, or any other source of series, behind a Spark session."""

    def __init__(self, spark: SparkSession, path: str | None = None, source: Source | None = None):
        self.spark = spark
        self.store = Warehouse(spark, path) if path is not None else None
        self.source: Source = source if source is not None else self.store

    def _store(self) -> Warehouse:
        if self.store is None:
            raise CatalogError("this connection has no store")
        return self.store

    def create_stream(self, stream: str, kind: ValueType) -> str:
        """Name and labels must be new, as a whole; a stream with more or fewer labels doesn't clash."""
        return self._store().create(*parse_identity(stream), kind)

    def delete_stream(self, stream: str) -> None:
        raise NotImplementedError("streams can't be deleted")

    def check_stream_exists(self, stream: str) -> bool:
        """Whether any stream has that name and at least these labels."""
        return bool(self._store().with_labels(*parse_identity(stream)))

    def get_all_streams(self) -> DataFrame:
        """(stream_id, labels, value_type); the metric's name is the label __name."""
        return self._store().streams.select("stream_id", F.map_concat(F.create_map(F.lit("__name"), "name"), "labels").alias("labels"), "value_type")

    def _single(self, stream: str):
        found = self._store().with_labels(*parse_identity(stream))
        if len(found) != 1:
            raise CatalogError(f"{stream} is {'no stream' if not found else 'more than one stream'}")
        return found[0]

    def get_stream_value_type(self, stream: str) -> ValueType:
        return ValueType(self._single(stream)["value_type"])

    def prepare_insert(self, stream: str) -> Inserter:
        row = self._single(stream)
        return Inserter(self._store(), row["stream_id"], ValueType(row["value_type"]))

    def import_csv(self, stream: str, path: str) -> None:
        row = self._single(stream)
        kind = ValueType(row["value_type"])
        self._store().append(read_csv(self.spark, path, kind).select(F.lit(row["stream_id"]).alias("stream_id"), "ts", F.col("value").alias(kind.column)))

    def prepare_query(self, text: str, start: int | None = None, end: int | None = None, hints: bool = True) -> Query:
        return Query(Planner(self.source, start, end, hints).plan(text))
