"""Rolling totals over trailing periods, kept as a versioned daily state in a folder.

State: the readings already counted, amounts per entity and day, and the rolling totals per entity and day. A version
takes arrivals: readings not yet counted change their days' amounts, and every date from an entity's first changed day
on is recomputed as

    total(day) = total(day before) + amount(day) - amount(day that leaves the period)

seeded with the totals of the last unchanged day. A version reads, of the readings already counted, those of its
arrivals' days, of the amounts those of the longest period before the first changed day, and writes only what is new:
files are sorted by day, so filters on days skip the rest. Of several totals of a date the latest version's count. All
amounts are summed per day before anything is ordered, so an entity with a third of all readings has no more rows to
order than any other: at most one per lane and day of the calendar.

Totals are exact, so that what was added is what is taken off: a double is a whole number of units 2^(LANE * lane), with
lanes by size, and each lane's amounts are whole numbers of up to 38 digits. What is reported are doubles again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window

from ..session import cut, scratch

DAY_MS = 86_400_000
#: Bits that the units of two neighbouring lanes differ by; the least lane's unit is below the least double.
LANE, LEAST = 32, -34
#: A double's whole number of units is taken apart into two parts of up to so many bits.
PART = 43
EXACT = "decimal(38,0)"


def lane_of(v: Column) -> Column:
    """The lane whose unit divides v; 0 for 0."""
    return F.coalesce(F.greatest(F.lit(LEAST), F.floor((F.floor(F.log2(F.abs(v))) - 53) / F.lit(LANE))), F.lit(0)).cast("int")


def scaled(v: Column, lane: Column) -> Column:
    """v times 2^(-LANE * lane), in two steps, as that may be no double."""
    half = F.pow(F.lit(2.0), lane * F.lit(-LANE // 2))
    return v * half * half


def daily(rows: DataFrame) -> DataFrame:
    """(entity, day, value) to (entity, day, lane, amount, n)."""
    units = rows.withColumn("lane", lane_of(F.col("value"))).withColumn("u", scaled(F.col("value"), F.col("lane")))
    upper = units.withColumn("hi", F.floor(F.col("u") / F.lit(2.0**PART))).withColumn("lo", (F.col("u") - F.col("hi") * F.lit(2.0**PART)).cast("bigint"))
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    return upper.groupBy("entity", "day", "lane").agg((total("hi") * F.lit(2**PART).cast("decimal(20,0)") + total("lo")).cast(EXACT).alias("amount"), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class RollingState:
    """The state in folder `path` as of `version`; version 0 has nothing. A version that wasn't finished doesn't count
    and is written over by the next one."""

    spark: SparkSession
    path: str
    windows: tuple[int, ...] = (7, 30)
    version: int = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, windows: tuple[int, ...] = (7, 30)) -> RollingState:
        """The last finished version in a folder."""
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/spans")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if fs.exists(p) else []
        return cls(spark, path, windows, max(done, default=0))

    def _read(self, name: str, first: int = 1, last: int | None = None) -> DataFrame:
        """The rows that versions first to last wrote, with their version."""
        paths = [f"{self.path}/{name}/version={v}" for v in range(first, (self.version if last is None else last) + 1)]
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _write(self, name: str, df: DataFrame, order: str = "day") -> DataFrame:
        new = self.version + 1
        df.sortWithinPartitions(order).write.mode("overwrite").parquet(f"{self.path}/{name}/version={new}")
        return self._read(name, new, new).drop("version")

    def _latest(self, rolling: DataFrame) -> DataFrame:
        """Of rows of several versions the last per entity, day and lane; a lane never loses readings."""
        if self.version < 2:
            return rolling.drop("version")
        totals = [f"{p}_{w}" for w in self.windows for p in ("total", "n")]
        return rolling.groupBy("entity", "day", "lane").agg(F.max_by(F.struct(*totals), "version").alias("t")).select("entity", "day", "lane", "t.*")

    def advance(self, arrivals: DataFrame, entity: str = "entity", ts: str = "ts", value: str = "value") -> RollingState:
        """The next version, written. Arrivals in any order, late ones included; equal (entity, ts in ms, value) count
        once, within the arrivals and against the state. Rows with a null or non-finite part are left out. Without new
        readings the next version has the same rows."""
        v = F.col(value).cast("double")
        rows = arrivals.select(F.col(entity).alias("entity"), F.col(ts).alias("ts"), (v + F.lit(0.0)).alias("value"))
        rows = rows.where(F.col("entity").isNotNull() & F.col("ts").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
        rows = rows.distinct().withColumn("day", F.floor(F.col("ts") / F.lit(DAY_MS)).cast("int"))
        if self.version:
            rows = cut(rows, "arrivals")
            days = [r[0] for r in rows.select("day").distinct().collect()]  # at most the days of the calendar
            rows = rows.join(self._read("seen").where(F.col("day").isin(days)).drop("version"), ["entity", "day", "ts", "value"], "left_anti")
        delta = self._write("daily", daily(self._write("seen", rows)))
        changed = delta.groupBy("entity").agg(F.min("day").alias("since"), F.max("day").alias("last"))
        if not self.version:
            span, spans = changed, changed.select("entity", F.col("since").alias("first"), "last")
            self._write("rolling", self._roll(delta, span, None))
        else:
            old = self._read("spans", self.version).drop("version").withColumnRenamed("last", "ended")
            both = changed.join(old, "entity", "full")
            spans = both.select("entity", F.least("first", "since").alias("first"), F.greatest("ended", "last").alias("last"))
            span = cut(both.where(F.col("since").isNotNull()).select("entity", F.least("since", F.col("ended") + 1).alias("since"), F.greatest("ended", "last").alias("last")), "span")
            earliest = span.agg(F.min("since")).first()[0]
            back = (2**31 - 1 if earliest is None else earliest) - max(self.windows)
            known = self._read("daily", last=self.version + 1).where(F.col("day") >= back).join(span.select("entity", "since"), "entity")
            amounts = known.where(F.col("day") >= F.col("since") - max(self.windows)).groupBy("entity", "day", "lane").agg(F.sum("amount").cast(EXACT).alias("amount"), F.sum("n").alias("n"))
            before = self._read("rolling").where(F.col("day") >= back).join(span.select("entity", (F.col("since") - 1).alias("day")), ["entity", "day"])
            self._write("rolling", self._roll(amounts, span, self._latest(before)))
        self._write("spans", spans, "entity")
        return RollingState(self.spark, self.path, self.windows, self.version + 1)

    def _roll(self, amounts: DataFrame, span: DataFrame, seeds: DataFrame | None) -> DataFrame:
        """Totals of every date from each entity's `since` to its `last`, from the amounts per day and the totals of the
        day before."""
        zero = F.lit(0).cast(EXACT)
        within = lambda df: df.join(span, "entity").where(F.col("day").between(F.col("since"), F.col("last")))
        columns = [c for w in self.windows for c in (f"total_{w}", f"n_{w}")]

        def moves(day: Column, signs: dict[int, int]) -> DataFrame:
            per = [c for w in self.windows for c in ((F.col("amount") * signs.get(w, 0)).cast(EXACT).alias(f"total_{w}"), (F.col("n") * signs.get(w, 0)).alias(f"n_{w}"))]
            return within(amounts.select("entity", "lane", day.alias("day"), *per)).select("entity", "lane", "day", *columns)

        # What arrives on a day leaves the period w days later.
        parts = moves(F.col("day"), dict.fromkeys(self.windows, 1))
        for w in self.windows:
            parts = parts.unionByName(moves(F.col("day") + w, {w: -1}))
        lanes = amounts.select("entity", "lane")
        if seeds is not None:
            parts = parts.unionByName(seeds.select("entity", "lane", "day", *columns))
            lanes = lanes.unionByName(seeds.select("entity", "lane"))
        dates = lanes.distinct().join(span, "entity").select("entity", "lane", F.explode(F.sequence("since", "last")).alias("day"))
        empty = [c for w in self.windows for c in (zero.alias(f"total_{w}"), F.lit(0).cast("bigint").alias(f"n_{w}"))]
        # At most a few rows per date and lane, so an entity's fit one task, which sums and orders them.
        full = parts.unionByName(dates.select("entity", "lane", "day", *empty)).repartition("entity").groupBy("entity", "lane", "day").agg(*(F.sum(c).alias(c) for c in columns))
        run = Window.partitionBy("entity", "lane").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        types = {c: EXACT if c.startswith("total") else "bigint" for c in columns}
        rolled = full.select("entity", "lane", "day", *(F.sum(c).over(run).cast(types[c]).alias(c) for c in columns))
        if seeds is None:
            return rolled
        return rolled.join(span.select("entity", "since"), "entity").where(F.col("day") >= F.col("since")).drop("since")

    def report(self) -> DataFrame:
        """(entity, day as DATE, and per period w: sum_w, avg_w, n_w). An empty period sums to 0 and has no average."""
        half = F.pow(F.lit(2.0), F.col("lane") * F.lit(LANE // 2))
        sums = [c for w in self.windows for c in (F.sum(F.col(f"total_{w}").cast("double") * half * half).alias(f"s_{w}"), F.sum(f"n_{w}").alias(f"n_{w}"))]
        days = self._latest(self._read("rolling")).groupBy("entity", "day").agg(*sums)
        per = [c for w in self.windows for c in (F.col(f"s_{w}").alias(f"sum_{w}"), (F.col(f"s_{w}") / F.nullif(F.col(f"n_{w}"), F.lit(0))).alias(f"avg_{w}"), F.col(f"n_{w}"))]
        return days.select("entity", F.date_from_unix_date("day").alias("day"), *per)


def rolling_totals(batches: list[DataFrame], entity: str, ts: str, value: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Report after a version for each of the batches, in a folder that goes when the process ends. An entity's dates run
    from its first to its last reading. No rows, no result."""
    spark = batches[0].sparkSession
    state = RollingState(spark, scratch(spark, "rolling"), windows)
    for b in batches:
        state = state.advance(b, entity, ts, value)
    return state.report()
