"""Queries of the series operators over the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import canonical_file, canonical_id
from ..operators.grid import regular
from ..operators.intervals import periods_and_gaps
from ..operators.orphans import json_elements, orphans
from ..operators.rolling import rolling_totals
from ..operators.spikes import implausible
from .keys_sql import cfile, cid
from ..sources.store import named, plausible, readings


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# Problem 1


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every stream on its metric's grid: smoothed value, its standard deviation, readings in the slot."""
    rows = named(readings(spark, d), ["stream_id", "ts", "value"])
    known = rows.join(read(spark, d, "metric_catalog").select(F.col("name").alias("metric"), "step_ms", "lo_limit", "hi_limit"), "metric")
    v = F.col("value")
    usable = F.coalesce(v >= F.col("lo_limit"), F.lit(True)) & F.coalesce(v <= F.col("hi_limit"), F.lit(True))
    return regular(known.select(F.col("stream_id").alias("entity"), "ts", "value", "step_ms", usable.alias("usable")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_grid(spark, d).where("missing").select(F.col("entity").alias("stream_id"), "slot_ts")


def p1_slots(spark: SparkSession, d: str) -> DataFrame:
    """The grid's slots with their readings, without what the smoother adds."""
    return p1_grid(spark, d).select(F.col("entity").alias("stream_id"), "slot_ts", F.col("n_readings").cast("bigint").alias("n_readings"), "missing", (F.col("value").isNull() == F.col("sd").isNull()).alias("consistent"))


# Problem 2

#: The metric that only grows and the one that holds its values by nature.
COUNTERS, HELD = ["request_count"], ["fan_setpoint"]


def p2_implausible(spark: SparkSession, d: str) -> DataFrame:
    """Implausible rows with their kind: range, spike or run."""
    rows = named(plausible(read(spark, d, "samples")), ["stream_id", "seq", "ts", "value"])
    known = rows.join(read(spark, d, "metric_catalog").select(F.col("name").alias("metric"), "step_ms", F.col("lo_limit").alias("lo"), F.col("hi_limit").alias("hi")), "metric")
    return implausible(known.select(F.col("stream_id").alias("entity"), "seq", "ts", "value", "step_ms", "lo", "hi", F.col("metric").isin(COUNTERS).alias("counter"), F.col("metric").isin(HELD).alias("held")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_implausible(spark, d).select("seq").distinct()


# Problem 3


def files(spark: SparkSession, d: str) -> DataFrame:
    """The registration that counts of each id and filename: the latest, of equally late ones the one that ends last."""
    rows = read(spark, d, "id_to_file").select(canonical_id(F.col("id")).alias("id"), canonical_file(F.col("filename")).alias("filename"), "start_ts", "end_ts", "registered_at")
    latest = rows.where(F.col("id").isNotNull() & F.col("filename").isNotNull()).groupBy("id", "filename").agg(F.max(F.struct("registered_at", "end_ts", "start_ts")).alias("r"))
    return latest.where(F.col("r.start_ts") != 0).select("id", F.col("r.start_ts").alias("start_ts"), F.col("r.end_ts").alias("end_ts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    got = periods_and_gaps(files(spark, d), "id", "start_ts", "end_ts")
    return got.where(F.col("kind") == "gap").select(F.col("entity").alias("id"), F.col("start").alias("gap_start"), F.col("end").alias("gap_end"))


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    got = periods_and_gaps(files(spark, d), "id", "start_ts", "end_ts")
    return got.where(F.col("kind") == "covered").select(F.col("entity").alias("id"), F.col("start").alias("period_start"), F.col("end").alias("period_end"))


# Problem 5

#: A double times this, less the difference of that and the double, is the double in 31 bits.
SPLIT = float(2**22 + 1)


def p5_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Three versions: what had arrived a week before the last arrival, that week but for its last day, and that day."""
    rows = readings(spark, d, "received_at")
    last = read(spark, d, "samples").agg(F.max("received_at")).first()[0]
    at = F.coalesce(F.col("received_at") <= F.lit(last) - F.expr("INTERVAL 7 DAYS"), F.lit(True)), F.coalesce(F.col("received_at") <= F.lit(last) - F.expr("INTERVAL 1 DAY"), F.lit(True))
    batches = [rows.where(at[0]), rows.where(~at[0] & at[1]), rows.where(~at[1])]
    return rolling_totals(batches, "stream_id", "ts", "value").withColumnRenamed("entity", "stream_id")


def p5_versions(spark: SparkSession, d: str) -> DataFrame:
    """The same after versions that each correct dates all over the history: the rows by the day of arrival in turn.
    Amounts are rounded to 31 bits, so that they don't show in what order a sum was taken."""
    rows = readings(spark, d, "received_at").withColumn("part", F.coalesce(F.pmod(F.datediff(F.to_date("received_at"), F.lit("2018-01-01")), F.lit(3)), F.lit(0)))
    got = rolling_totals([rows.where(F.col("part") == i) for i in range(3)], "stream_id", "ts", "value").withColumnRenamed("entity", "stream_id")
    coarse = lambda c: (F.col(c) * F.lit(SPLIT) - (F.col(c) * F.lit(SPLIT) - F.col(c))).alias(c)
    return got.select(*(coarse(c) if c[:3] in ("sum", "avg") else c for c in got.columns))


# Problem 6


def p6_orphans(spark: SparkSession, d: str) -> DataFrame:
    files_, postings = read(spark, d, "id_to_file"), read(spark, d, "stream_to_ids")
    ref = lambda table, field, key, at, rows: rows.select(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), key.alias("key"), F.col(at).cast("timestamp").alias("at"))
    elements = postings.select(F.explode(json_elements(F.col("ids"))).alias("e"), "recorded_at")
    ids = ref("id_to_file", "id", canonical_id(F.col("id")), "registered_at", files_).unionAll(ref("stream_to_ids", "ids", canonical_id(F.col("e")), "recorded_at", elements))
    names = ref("id_to_file", "filename", canonical_file(F.col("filename")), "registered_at", files_)
    parents = lambda rows, key, made, gone: rows.select(key.alias("key"), F.col(made).cast("timestamp").alias("made"), F.col(gone).cast("timestamp").alias("gone"))
    streams = parents(read(spark, d, "streams"), canonical_id(F.col("stream_id")), "created_at", "deleted_at")
    headers = parents(read(spark, d, "file_header"), canonical_file(F.col("filename")), "written_at", "removed_at")
    return orphans(ids, streams).unionAll(orphans(names, headers))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_orphans(spark, d).select("ref_table", "ref_field", F.col("key").alias("ref_value"), "period")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, column, month and reason."""
    return p6_orphans(spark, d).groupBy("ref_table", "ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("keys"), F.sum("n_refs").alias("n_references"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_grid, p1_slots, p2_found, p2_implausible, p3_found, p3_periods, p5_rolling, p5_versions, p6_found, p6_report)}


def oracle_sql() -> dict[str, str]:
    covered = f"""r AS (SELECT {cid('id')} AS id, {cfile('filename')} AS f, start_ts, end_ts, registered_at FROM id_to_file WHERE id IS NOT NULL AND filename IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY id, f ORDER BY registered_at DESC NULLS LAST, end_ts DESC NULLS LAST, start_ts DESC NULLS LAST) AS k FROM r),
c AS (SELECT id, start_ts AS s, coalesce(end_ts, 9223372036854775807) AS e FROM l WHERE k = 1 AND start_ts <> 0 AND (end_ts IS NULL OR end_ts >= start_ts)),
m AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)"""
    rows = "r AS (SELECT * FROM samples WHERE stream_id IS NOT NULL AND ts >= 1514764800000 AND ts < 1798761600000 AND value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value))"
    names = "n AS (SELECT stream_id, min(name) AS metric FROM samples WHERE stream_id IS NOT NULL AND value IS NOT NULL AND ts >= 1514764800000 AND ts < 1798761600000 GROUP BY ALL)"
    day = "SELECT DISTINCT stream_id, ts, value FROM r"
    span = "b AS (SELECT stream_id, unnest(range(min(day), max(day) + 1)) AS day FROM d GROUP BY stream_id)"
    frame = lambda f, w, by="": f"{f} OVER (PARTITION BY stream_id{by} ORDER BY day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    # Exact, in whole numbers of units by the size of the value; each period is summed anew.
    both = ", ".join(f"sum(CAST(s_{w} AS DOUBLE) * pow(2, 16 * lane) * pow(2, 16 * lane)) AS sum_{w}, CAST(sum(n_{w}) AS BIGINT) AS n_{w}" for w in (7, 30))
    exact = f"""WITH {rows}, u AS (SELECT stream_id, ts // 86400000 AS day, value, CASE WHEN value = 0 THEN 0 ELSE greatest(-34, CAST(floor((floor(log2(abs(value))) - 53) / 32) AS INT)) END AS lane FROM ({day})),
d AS (SELECT stream_id, day, lane, sum(CAST(value * pow(2, -16 * lane) * pow(2, -16 * lane) AS HUGEINT)) AS s, count(*) AS n FROM u GROUP BY ALL), {span},
g AS (SELECT b.stream_id, b.day, l.lane, CAST(s AS HUGEINT) AS s, n FROM b JOIN (SELECT DISTINCT stream_id, lane FROM d) l ON b.stream_id = l.stream_id LEFT JOIN d ON b.stream_id = d.stream_id AND b.day = d.day AND l.lane = d.lane),
w AS (SELECT stream_id, day, lane, {', '.join(f"coalesce({frame('sum(s)', w, ', lane')}, 0) AS s_{w}, coalesce({frame('sum(n)', w, ', lane')}, 0) AS n_{w}" for w in (7, 30))} FROM g),
t AS (SELECT stream_id, day, {both} FROM w GROUP BY ALL)
SELECT stream_id, DATE '1970-01-01' + CAST(day AS INTEGER) AS day, {', '.join(f"sum_{w}, sum_{w} / nullif(n_{w}, 0) AS avg_{w}, n_{w}" for w in (7, 30))} FROM t"""
    # Plain sums of doubles, rounded as in the query.
    coarse = lambda x: f"({x}) * {SPLIT} - (({x}) * {SPLIT} - ({x}))"
    plain = f"""WITH {rows}, d AS (SELECT stream_id, ts // 86400000 AS day, fsum(value) AS s, count(*) AS n FROM ({day}) GROUP BY ALL), {span},
g AS (SELECT b.stream_id, b.day, s, n FROM b LEFT JOIN d ON b.stream_id = d.stream_id AND b.day = d.day),
w AS (SELECT stream_id, day, {', '.join(f"coalesce({frame('fsum(s)', w)}, 0) AS s_{w}, coalesce({frame('sum(n)', w)}, 0) AS n_{w}" for w in (7, 30))} FROM g)
SELECT stream_id, DATE '1970-01-01' + CAST(day AS INTEGER) AS day, {', '.join(f"{coarse(f's_{w}')} AS sum_{w}, {coarse(f's_{w} / nullif(n_{w}, 0)')} AS avg_{w}, CAST(n_{w} AS BIGINT) AS n_{w}" for w in (7, 30))} FROM w"""
    refs = f"""e AS (SELECT unnest(from_json(CASE WHEN json_valid(ids) AND json_type(ids) = 'ARRAY' THEN ids ELSE '[]' END, '["VARCHAR"]')) AS e, recorded_at FROM stream_to_ids),
refs AS (SELECT 'id_to_file' AS ref_table, 'id' AS ref_field, {cid('id')} AS k, registered_at AS tm FROM id_to_file UNION ALL SELECT 'id_to_file', 'filename', {cfile('filename')}, registered_at FROM id_to_file UNION ALL SELECT 'stream_to_ids', 'ids', {cid('e')}, recorded_at FROM e),
parents AS (SELECT 'f' AS kind, {cfile('filename')} AS k, written_at AS made, removed_at AS gone FROM file_header UNION ALL SELECT 's', {cid('stream_id')}, created_at, deleted_at FROM streams),
j AS (SELECT ref_table, ref_field, r.k AS ref_value, strftime(tm, '%Y-%m') AS period, CASE WHEN p.k IS NULL THEN 1 WHEN gone <= tm THEN 2 WHEN made > tm + INTERVAL 1 HOUR THEN 3 END AS why FROM refs r LEFT JOIN parents p ON r.k = p.k AND (ref_field = 'filename') = (kind = 'f') WHERE r.k IS NOT NULL)"""
    known = "k AS (SELECT s.*, step_ms, lo_limit, hi_limit, metric FROM samples s JOIN n USING (stream_id) JOIN metric_catalog c ON c.name = n.metric WHERE ts >= 1514764800000 AND ts < 1798761600000 AND value IS NOT NULL)"
    return {
        "p1_found": f"WITH {names}, {known}, s AS (SELECT DISTINCT stream_id, step_ms, ts // step_ms AS slot FROM k WHERE NOT isnan(value) AND NOT isinf(value)), g AS (SELECT stream_id, any_value(step_ms) AS step_ms, unnest(range(min(slot), max(slot) + 1)) AS slot FROM s GROUP BY stream_id) SELECT stream_id, slot * step_ms AS slot_ts FROM g ANTI JOIN s USING (stream_id, slot)",
        "p1_slots": f"WITH {names}, {known}, s AS (SELECT stream_id, any_value(step_ms) AS step_ms, ts // step_ms AS slot, count(*) AS n FROM k WHERE NOT isnan(value) AND NOT isinf(value) GROUP BY ALL), g AS (SELECT stream_id, any_value(step_ms) AS step_ms, unnest(range(min(slot), max(slot) + 1)) AS slot FROM s GROUP BY stream_id) SELECT g.stream_id, g.slot * g.step_ms AS slot_ts, coalesce(n, 0) AS n_readings, n IS NULL AS missing, true AS consistent FROM g LEFT JOIN s ON g.stream_id = s.stream_id AND g.slot = s.slot",
        "p3_found": f"WITH {covered} SELECT id, before + 1 AS gap_start, s - 1 AS gap_end FROM m WHERE before IS NOT NULL AND before < 9223372036854775807 AND s > before + 1",
        "p3_periods": f"WITH {covered}, i AS (SELECT *, sum(CASE WHEN before IS NULL OR (before < 9223372036854775807 AND s > before + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT id, min(s) AS period_start, nullif(max(e), 9223372036854775807) AS period_end FROM i GROUP BY id, island",
        "p5_rolling": exact,
        "p5_versions": plain,
        "p6_found": f"WITH {refs} SELECT DISTINCT ref_table, ref_field, ref_value, period FROM j WHERE why IS NOT NULL",
        "p6_report": f"WITH {refs}, o AS (SELECT ref_table, ref_field, ref_value, period, min(why) AS why FROM j GROUP BY ALL), t AS (SELECT ref_table, ref_field, ref_value, period, count(*) AS n FROM j GROUP BY ALL) SELECT ref_table, ref_field, period, CASE why WHEN 1 THEN 'missing' WHEN 2 THEN 'gone' ELSE 'later' END AS reason, count(*) AS keys, CAST(sum(n) AS BIGINT) AS n_references FROM o JOIN t USING (ref_table, ref_field, ref_value, period) WHERE why IS NOT NULL GROUP BY ALL",
    }
