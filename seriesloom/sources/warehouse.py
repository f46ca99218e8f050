"""The store: a folder with the stream catalogue, the samples and their per-file statistics, all Parquet.

Samples lie in batches, and in those in a fixed number of hash buckets of the stream id, sorted by stream and time
within each Parquet file, so a selector's ids prune folders, row-group statistics prune the rest, and millions of
streams don't make millions of folders. In a batch, at most MAX_ENTRIES successive samples of one stream have the same
file id; `summary` has one row of statistics for each.

A batch is prepared aside, samples and then statistics, and put in place by renaming its two folders; one of the same
name is replaced, so that a repeated batch doesn't double its samples.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..errors import CatalogError, NoStreamsMatchedError
from ..functions.types import ValueType, convert, promote
from ..operators.summary import from_summary
from ..plans.planner import Selected
from ..plans.promql import Selector
from .tables import any_group

STREAMS = "stream_id STRING, name STRING, labels MAP<STRING,STRING>, value_type STRING"
SAMPLES = "stream_id STRING, file_id STRING, ts BIGINT, v_i64 BIGINT, v_u64 DECIMAL(20,0), v_f64 DOUBLE, bucket INT"
STATS = ", ".join(f"sum_{s} {w}, min_{s} {t}, max_{s} {t}, first_{s} {t}" for s, t, w in (("i64", "BIGINT", "BIGINT"), ("u64", "DECIMAL(20,0)", "DECIMAL(38,0)"), ("f64", "DOUBLE", "DOUBLE")))
SUMMARY = f"stream_id STRING, file_id STRING, min_ts BIGINT, max_ts BIGINT, n BIGINT, {STATS}"
BUCKETS = 256
MAX_ENTRIES = 62_500
#: Up to so many ids stand in the filter itself; beyond, the catalogue is joined.
STATIC_IDS = 1000


class Warehouse:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("streams", STREAMS), ("samples", SAMPLES), ("summary", SUMMARY)):
            if not self._exists(name):
                writer = spark.createDataFrame([], schema).write
                (writer.partitionBy("bucket") if name == "samples" else writer).parquet(f"{self.path}/{name}")

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        p, fs = self._fs(name)
        return fs.exists(p)

    def drop(self) -> None:
        """Remove the whole store."""
        p, fs = self._fs("")
        fs.delete(p, True)

    @property
    def streams(self) -> DataFrame:
        return self.spark.read.schema(STREAMS).parquet(f"{self.path}/streams")

    @property
    def samples(self) -> DataFrame:
        return self.spark.read.schema(SAMPLES).parquet(f"{self.path}/samples")

    @property
    def summary(self) -> DataFrame:
        return self.spark.read.schema(SUMMARY).parquet(f"{self.path}/summary")

    def matching(self, s: Selector) -> DataFrame:
        """Catalogue rows of the selector; extra labels on a stream don't matter."""
        cond = any_group(s, lambda k: F.try_element_at("labels", F.lit(k)))
        rows = self.streams.where(F.col("name") == s.name)
        return rows if cond is None else rows.where(cond)

    def with_labels(self, name: str, labels: dict[str, str]) -> list:
        """At most two streams of that name that have at least these labels."""
        return reduce(lambda df, kv: df.where(F.try_element_at("labels", F.lit(kv[0])) == kv[1]), labels.items(), self.streams.where(F.col("name") == name)).limit(2).collect()

    def create(self, name: str, labels: dict[str, str], kind: ValueType) -> str:
        same = self.streams.where((F.col("name") == name) & (F.size("labels") == len(labels)))
        for k, v in labels.items():
            same = same.where(F.try_element_at("labels", F.lit(k)) == v)
        if not same.isEmpty():
            raise CatalogError(f"stream {name}{labels} exists")
        stream_id = str(uuid.uuid4())
        self.spark.createDataFrame([(stream_id, name, labels, kind.value)], STREAMS).coalesce(1).write.mode("append").parquet(f"{self.path}/streams")
        return stream_id

    def append(self, rows: DataFrame, batch: str | None = None) -> None:
        """rows(stream_id, ts, and one of v_i64, v_u64, v_f64 filled). Nothing is sorted out: repeats stay. batch: a
        name; what a batch of this name held before is replaced. By default each batch is new."""
        name = f"b{uuid.uuid4().hex if batch is None else batch}"
        for c, t in (("v_i64", "bigint"), ("v_u64", "decimal(20,0)"), ("v_f64", "double")):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(t))
        hashed = F.pmod(F.xxhash64("stream_id"), F.lit(BUCKETS)).cast("int")
        parts = rows.select("stream_id", "ts", "v_i64", "v_u64", "v_f64", hashed.alias("bucket"), F.spark_partition_id().alias("part"))
        # Samples are numbered within what one task brought of a stream, so a stream's samples need not meet.
        nth = F.row_number().over(Window.partitionBy("bucket", "stream_id", "part").orderBy("ts")) - 1
        placed = parts.withColumn("file_id", F.concat_ws("-", F.lit(name), "part", F.floor(nth / F.lit(MAX_ENTRIES)).cast("string"))).drop("part")
        aside = f"_staging/{name}-{uuid.uuid4().hex}"
        placed.sortWithinPartitions("bucket", "stream_id", "ts").write.option("maxRecordsPerFile", MAX_ENTRIES).partitionBy("bucket").parquet(f"{self.path}/{aside}/samples")
        own = self.spark.read.schema(SAMPLES).parquet(f"{self.path}/{aside}/samples")
        stats = []
        for s in ("i64", "u64", "f64"):
            v = F.col(f"v_{s}")
            top = F.coalesce(F.max(F.when(~F.isnan(v), v)), F.max(v)) if s == "f64" else F.max(v)
            stats += [F.sum(v).alias(f"sum_{s}"), F.min(v).alias(f"min_{s}"), top.alias(f"max_{s}"), F.min_by(v, F.when(v.isNotNull(), F.col("ts"))).alias(f"first_{s}")]
        own.groupBy("stream_id", "file_id").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("n"), *stats).coalesce(1).write.parquet(f"{self.path}/{aside}/summary")
        for table in ("samples", "summary"):
            (made, fs), (place, _) = self._fs(f"{aside}/{table}"), self._fs(f"{table}/batch={name}")
            fs.delete(place, True)
            fs.rename(made, place)
        p, fs = self._fs(aside)
        fs.delete(p, True)

    def compact(self) -> None:
        """All batches as one, with files of a stream filled up; not while others read or write."""
        old = [f.getPath() for p, fs in (self._fs("samples"), self._fs("summary")) for f in fs.listStatus(p) if f.getPath().getName().startswith("batch=")]
        self.append(self.samples.select("stream_id", "ts", "v_i64", "v_u64", "v_f64").repartition("stream_id"))
        fs = self._fs("samples")[1]
        for p in old:
            fs.delete(p, True)

    def _resolve(self, s: Selector):
        found = self.matching(s)
        some = found.select("stream_id", "value_type").limit(STATIC_IDS + 1).collect()
        if not some:
            raise NoStreamsMatchedError(f"no stream matches {s}")
        names = {r[1] for r in some} if len(some) <= STATIC_IDS else {r[0] for r in found.select("value_type").distinct().collect()}
        return found, [ValueType(n) for n in sorted(names)], [r[0] for r in some]

    def _only(self, df: DataFrame, found: DataFrame, ids: list[str], bucketed: bool) -> DataFrame:
        if len(ids) > STATIC_IDS:
            return df.join(found.select("stream_id"), "stream_id", "left_semi")
        df = df.where(F.col("stream_id").isin(ids))
        if bucketed:
            df = df.where(F.col("bucket").isin([F.pmod(F.xxhash64(F.lit(i)), F.lit(BUCKETS)).cast("int") for i in ids]))
        return df

    @staticmethod
    def _value(kinds: list[ValueType], kind: ValueType):
        return F.coalesce(*(convert(F.col(k.column), k, kind) for k in kinds))

    def select(self, s: Selector, start: int, end: int) -> Selected:
        found, kinds, ids = self._resolve(s)
        kind = promote(*kinds)
        rows = self._only(self.samples.where(F.col("ts").between(start, end)), found, ids, True)
        return Selected(rows.select("stream_id", "ts", self._value(kinds, kind).alias("value")), kind, len(ids))

    def hinted(self, op: str, s: Selector, start: int, end: int):
        """Streams of several types aren't served from statistics."""
        found, kinds, ids = self._resolve(s)
        if len(kinds) > 1:
            return None
        kind, c = kinds[0], kinds[0].column[2:]
        stats = self._only(self.summary, found, ids, False).select("stream_id", "file_id", "min_ts", "max_ts", "n", F.col(f"sum_{c}").alias("value_sum"), F.col(f"min_{c}").alias("min_value"), F.col(f"max_{c}").alias("max_value"))
        rows = self._only(self.samples, found, ids, True).select("stream_id", "file_id", "ts", F.col(kind.column).alias("value"))
        return from_summary(op, stats, rows, kind, start, end)

    def headers(self) -> DataFrame:
        """Per file and stream: time range, count and statistics as doubles."""
        pick = lambda p: reduce(lambda a, b: F.coalesce(a, b), (F.col(f"{p}_{s}").cast("double") for s in ("i64", "u64", "f64")))
        return self.summary.select("stream_id", "file_id", "min_ts", "max_ts", "n", *(pick(p).alias(f"{p}_value") for p in ("sum", "min", "max", "first")))


    def files(self) -> DataFrame:
        """Per Parquet file of samples: its size in bytes, its rows, and how many times smaller it is than 16 bytes a
        row."""
        per = self.samples.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("n"))
        return per.withColumn("ratio", F.col("n") * 16 / F.col("bytes"))
