"""Queries for the engine's own operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..api import Connection
from ..functions.types import MAX_TS, ValueType as V
from ..operators.catalog import required_files, streams_by_postings
from ..operators.summary import from_summary, summarise
from ..http import answer
from ..session import scratch
from ..streaming.ingest import batch_name, ingest
from .keys_sql import cid
from ..sources.tables import Series, TableSource, micros_within

#: A range of id_to_file in milliseconds, and labels of the inverted index.
NEEDED, WANTED = (1_516_000_000_000, 1_517_000_000_000), {"__name": "chamber_temp", "site": "birch"}
#: 2024-01-05 and 2024-01-20 in microseconds: a range inside the events.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
HINT_OPS = ("sum", "count", "avg", "min", "max")
START, END = 1_704_412_800_000_000, 1_705_708_800_000_000


def source(spark: SparkSession, d: str) -> TableSource:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kinds = {"event_type": "event_type"}
    return TableSource(spark, {
        "events": lambda: Series(read("events"), us("ts"), F.col("value"), V.FLOAT64, kinds, micros_within("ts")),
        "event_user": lambda: Series(read("events"), us("ts"), F.col("user_id"), V.UINTEGER64, kinds, micros_within("ts")),
        "event_id": lambda: Series(read("events"), us("ts"), F.col("event_id"), V.INTEGER64, kinds, micros_within("ts")),
        "event_any": lambda: [Series(read("events"), us("ts"), F.col("value"), V.FLOAT64, kinds, micros_within("ts")), Series(read("events"), us("ts"), F.col("user_id"), V.UINTEGER64, kinds, micros_within("ts"))],
        "lineitem_quantity": lambda: Series(read("lineitem"), us("l_shipdate"), F.col("l_quantity"), V.FLOAT64, {"returnflag": "l_returnflag", "linestatus": "l_linestatus"}),
        "order_price": lambda: Series(read("orders"), us("o_orderdate"), F.col("o_totalprice"), V.FLOAT64, {"status": "o_orderstatus", "priority": "o_orderpriority"}),
        "acctbal": lambda: Series(read("customer"), F.col("c_custkey"), F.col("c_acctbal"), V.FLOAT64, {"segment": "c_mktsegment"}),
    })


CLICK, VIEW = 'events{event_type="click"}', 'events{event_type="view"}'
U_CLICK, U_VIEW = 'event_user{event_type="click"}', 'event_user{event_type="view"}'
AT = "epoch_us(ts)"
E_CLICK, E_VIEW = "(SELECT epoch_us(ts) ts, value v FROM events WHERE event_type = 'click')", "(SELECT epoch_us(ts) ts, value v FROM events WHERE event_type = 'view')"
UE_CLICK, UE_VIEW = (x.replace("value v", "user_id v") for x in (E_CLICK, E_VIEW))
R4 = lambda x: f"round({x}, 4)"


def vs(expr: str, where: str = "true", table: str = "events", ts: str = AT, cond: str = "event_type = 'click'") -> str:
    return f"SELECT ts, value FROM (SELECT {ts} AS ts, CAST({expr} AS DOUBLE) AS value FROM {table} WHERE {cond} AND {where})"


def scalar(expr: str, frm: str = "events WHERE event_type = 'click'") -> str:
    return f"SELECT value FROM (SELECT CAST({expr} AS DOUBLE) AS value FROM {frm}) WHERE value IS NOT NULL"


def vv(op: str, a: str, b: str, rounded: bool) -> str:
    """The merge with interpolation, in SQL windows."""
    side = "".join(
        f", last_value(CASE WHEN {x} IS NOT NULL THEN ts END IGNORE NULLS) OVER p AS {x}t0, last_value({x} IGNORE NULLS) OVER p AS {x}0"
        f", first_value(CASE WHEN {x} IS NOT NULL THEN ts END IGNORE NULLS) OVER n AS {x}t1, first_value({x} IGNORE NULLS) OVER n AS {x}1"
        for x in "ab"
    )

    def value(x: str) -> str:
        line = f"(CAST(ts AS DOUBLE) - CAST({x}t0 AS DOUBLE)) * ((CAST({x}1 AS DOUBLE) - CAST({x}0 AS DOUBLE)) / (CAST({x}t1 AS DOUBLE) - CAST({x}t0 AS DOUBLE))) + CAST({x}0 AS DOUBLE)"
        return f"CAST(CASE WHEN {x} IS NOT NULL THEN {x} WHEN {x}0 IS NULL THEN {x}1 WHEN {x}1 IS NULL THEN {x}0 ELSE {f'round({line})' if rounded else line} END AS DOUBLE)"

    done = {"/": "CASE WHEN y <> 0 THEN x / y WHEN x > 0 THEN 'Infinity'::DOUBLE WHEN x < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END", "%": "CASE WHEN y <> 0 THEN x % y ELSE 'NaN'::DOUBLE END"}.get(op, f"x {op} y")
    return f"""WITH k AS (SELECT coalesce(l.ts, r.ts) AS ts, l.v AS a, r.v AS b FROM {a} l FULL OUTER JOIN {b} r ON l.ts = r.ts),
w AS (SELECT ts, a, b{side} FROM k WINDOW p AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT ts, {value("a")} AS x, {value("b")} AS y FROM w)
SELECT ts, round({done}, 4) AS value FROM f WHERE x IS NOT NULL AND y IS NOT NULL"""


#: name: (query, start, end, SQL, digits to which sums of doubles are rounded on both sides)
PLANNED: dict[str, tuple[str, int, int, str, int | None]] = {
    "select_range": (CLICK, START, END, vs("value", f"{AT} BETWEEN {START} AND {END}"), None),
    "select_all_labels": ('lineitem_quantity{returnflag="R", linestatus="F"}', 0, MAX_TS, vs("l_quantity", table="lineitem", ts="epoch_us(l_shipdate)", cond="l_returnflag = 'R' AND l_linestatus = 'F'"), None),
    "literal": ("2.5", 0, 0, "SELECT 2.5::DOUBLE AS value", None),
    "literal_folded": ("(2 + 3 - 4.5) * (5 / 2.3) % 1", 0, 0, "SELECT round((2 + 3 - 4.5) * (5 / 2.3), 9)::DOUBLE - 1 AS value", 6),
    "add_vs": (f"{CLICK} + 2", 0, MAX_TS, vs("value + 2"), None),
    "sub_vs": (f"{CLICK} - 2.5", 0, MAX_TS, vs("value - 2.5::DOUBLE"), None),
    "mul_vs": (f"{CLICK} * 11", 0, MAX_TS, vs("value * 11"), None),
    "div_vs": (f"{CLICK} / -4", 0, MAX_TS, vs("value / -4"), None),
    "div_vs_zero": (f"{CLICK} / 0", 0, MAX_TS, vs("CASE WHEN value > 0 THEN 'Infinity'::DOUBLE WHEN value < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END"), None),
    "mod_vs": ("acctbal % 7", 0, MAX_TS, vs("c_acctbal % 7", table="customer", ts="c_custkey", cond="true"), 4),
    "sub_sv": (f"10 - {CLICK}", 0, MAX_TS, vs("10 - value"), None),
    "div_sv": (f"100 / {CLICK}", 0, MAX_TS, vs("100 / value"), None),
    "add_ss": (f"sum({U_CLICK}) + count({U_VIEW})", 0, MAX_TS, "SELECT CAST((SELECT sum(user_id) FROM events WHERE event_type = 'click') + (SELECT count(*) FROM events WHERE event_type = 'view') AS DOUBLE) AS value", None),
    "div_ss": (f"count({U_CLICK}) / count({U_VIEW})", 0, MAX_TS, "SELECT (SELECT count(*) FROM events WHERE event_type = 'click')::DOUBLE / (SELECT count(*) FROM events WHERE event_type = 'view') AS value", None),
    "zip_ss": (f"topk(5, {U_CLICK}) - bottomk(3, {U_CLICK})", 0, MAX_TS, "WITH a AS (SELECT user_id v, row_number() OVER (ORDER BY user_id DESC) i FROM events WHERE event_type = 'click'), b AS (SELECT user_id v, row_number() OVER (ORDER BY user_id) i FROM events WHERE event_type = 'click') SELECT CAST(a.v - b.v AS DOUBLE) AS value FROM a JOIN b USING (i) WHERE i <= 3", None),
    **{n: (f"{U_CLICK} {op} 50", 0, MAX_TS, vs("user_id", f"user_id {op.replace('==', '=')} 50"), None) for n, op in (("eq", "=="), ("ne", "!="), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<="))},
    "lt_sv": (f"100 < {CLICK}", 0, MAX_TS, vs("value", "value > 100"), None),
    "sum": (f"sum({CLICK})", 0, MAX_TS, scalar("round(sum(value), 4)"), 4),
    "count": (f"count({CLICK})", 0, MAX_TS, scalar("count(*)"), None),
    "avg": (f"avg({CLICK})", 0, MAX_TS, scalar("round(avg(value), 6)"), 6),
    "min": (f"min({CLICK})", 0, MAX_TS, scalar("min(value)"), None),
    "max": (f"max({CLICK})", 0, MAX_TS, scalar("max(value)"), None),
    "sum_range": (f"sum({CLICK})", START, END, scalar("round(sum(value), 4)", f"events WHERE event_type = 'click' AND {AT} BETWEEN {START} AND {END}"), 4),
    "sum_unsigned": (f"sum({U_CLICK})", 0, MAX_TS, scalar("sum(user_id)"), None),
    "sum_empty": (f"sum({CLICK} < 0)", 0, MAX_TS, scalar("sum(value)", "events WHERE event_type = 'click' AND value < 0"), None),
    "count_empty": (f"count({CLICK} < 0)", 0, MAX_TS, scalar("count(*)", "events WHERE event_type = 'click' AND value < 0"), None),
    "avg_of_filter": (f"avg({CLICK} > 100)", 0, MAX_TS, scalar("round(avg(value), 6)", "events WHERE event_type = 'click' AND value > 100"), 6),
    "topk": (f"topk(10, {CLICK})", 0, MAX_TS, "SELECT value FROM events WHERE event_type = 'click' ORDER BY value DESC LIMIT 10", None),
    "bottomk": (f"bottomk(10, {CLICK})", 0, MAX_TS, "SELECT value FROM events WHERE event_type = 'click' ORDER BY value LIMIT 10", None),
    "topk_large": (f"topk(1000000, {CLICK})", 0, MAX_TS, "SELECT value FROM events WHERE event_type = 'click'", None),
    "topk_zero": (f"topk(0, {CLICK})", 0, MAX_TS, "SELECT value FROM events WHERE false", None),
    "topk_computed_k": (f"topk(count({CLICK}) / 100, {CLICK})", 0, MAX_TS, "SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value DESC) i FROM events WHERE event_type = 'click') WHERE i <= (SELECT floor(count(*) / 100) FROM events WHERE event_type = 'click')", None),
    **{f"{n}_vv_interp": (f"{CLICK} {op} {VIEW}", 0, MAX_TS, vv(op, E_CLICK, E_VIEW, False), 4) for n, op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/"), ("mod", "%"))},
    "add_vv_rounded": (f"{U_CLICK} + {U_VIEW}", 0, MAX_TS, vv("+", UE_CLICK, UE_VIEW, True), 4),
    "add_vv_same_ts": (f"{CLICK} + {U_CLICK}", 0, MAX_TS, vs("value + user_id"), None),
    "vs_computed_scalar": (f"{U_CLICK} + sum({U_VIEW})", 0, MAX_TS, vs("user_id + (SELECT sum(user_id) FROM events WHERE event_type = 'view')"), None),
    "vs_empty_scalar": (f"{CLICK} + sum({VIEW} < 0)", 0, MAX_TS, vs("value", "false"), None),
    "ss_agg_ratio": (f"sum({U_CLICK}) / sum({U_VIEW})", 0, MAX_TS, "SELECT (SELECT sum(user_id) FROM events WHERE event_type = 'click')::DOUBLE / (SELECT sum(user_id) FROM events WHERE event_type = 'view')::DOUBLE AS value", None),
    "matcher_ne": ('events{event_type!="click"}', 0, MAX_TS, vs("value", cond="event_type <> 'click'"), None),
    "matcher_re": ('events{event_type=~"c.*|view"}', 0, MAX_TS, vs("value", cond="(event_type LIKE 'c%' OR event_type = 'view')"), None),
    "matcher_nre": ('events{event_type!~"c.*|view"}', 0, MAX_TS, vs("value", cond="NOT (event_type LIKE 'c%' OR event_type = 'view')"), None),
    "matcher_or": ('order_price{status="F", priority="1-URGENT" or status="P"}', 0, MAX_TS, vs("o_totalprice", table="orders", ts="epoch_us(o_orderdate)", cond="((o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR o_orderstatus = 'P')"), None),
    "at_start": (f"count({CLICK} @ start())", START, END, scalar("count(*)", f"events WHERE event_type = 'click' AND {AT} <= {END}"), None),
    "at_end": (f"count({CLICK} @ end())", START, END, "SELECT 0::DOUBLE AS value", None),
    "at_time": (f"count({CLICK} @ 1704412800123)", 0, END, scalar("count(*)", f"events WHERE event_type = 'click' AND {AT} BETWEEN 1704412800123000 AND {END}"), None),
    "at_offset": (f"count({CLICK} @ 1704412800123 offset 5d)", 0, END, scalar("count(*)", f"events WHERE event_type = 'click' AND {AT} BETWEEN 1704412800123000 + 432000000 AND {END}"), None),
    "topk_nan": (f"topk(1000000, ({U_CLICK} - 50) / 0)", 0, MAX_TS, "SELECT CASE WHEN user_id > 50 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END AS value FROM events WHERE event_type = 'click' AND user_id <> 50", None),
    "multi_stream_union": ("events", 0, MAX_TS, vs("value", cond="true"), None),
    "promote_mixed_types": ("event_any > 250", 0, MAX_TS, f"SELECT ts, value FROM (SELECT {AT} AS ts, value FROM events UNION ALL SELECT {AT}, user_id::DOUBLE FROM events) WHERE value > 250", None),
}


def planned(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, start, end, _, digits = PLANNED[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        plan = Connection(spark, source=source(spark, d)).prepare_query(text, start, end).plan
        value = F.col("value").cast("double")
        value = value if digits is None else F.round(value, digits)
        return plan.df.select(*(["ts"] if plan.kind == "vector" else []), value.alias("value"))

    return run


def list_streams(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/streams.parquet")
    return s.select("stream_id", F.array_join(F.transform(F.array_sort(F.map_entries(F.map_concat(F.create_map(F.lit("__name"), F.coalesce("name", F.lit(""))), F.coalesce("labels", F.create_map().cast("map<string,string>"))))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("labels"), "value_type")


def header_stats(spark: SparkSession, d: str) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("stream_id"), F.date_format("ts", "yyyy-MM-dd").alias("file_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "value")
    s = summarise(ev)
    return s.select("stream_id", "file_id", "min_ts", "max_ts", "n", F.round("value_sum", 4).alias("value_sum"), "min_value", "max_value", "first_value")


HINTED = (START + 7_200_000_000, END - 7_200_000_000)


def summary_hint(op: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ev = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type") == "click")
        rows = ev.select(F.col("event_type").alias("stream_id"), F.date_format("ts", "yyyy-MM-dd").alias("file_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "value")
        df, _ = from_summary(op, summarise(rows), rows, V.FLOAT64, *HINTED)
        return df.select(F.round(F.col("value").cast("double"), 4).alias("value"))

    return run


def event_store(spark: SparkSession, d: str, path: str | None = None) -> Connection:
    """A store with a stream for each type of event, filled in one batch that is then sent again."""
    conn = Connection(spark, path or scratch(spark, "store"))
    for kind in EVENT_TYPES:
        conn.create_stream(f'ev{{kind="{kind}"}}', V.FLOAT64)
    ids = conn.get_all_streams().select("stream_id", F.element_at("labels", "kind").alias("event_type"))
    rows = spark.read.parquet(f"{d}/events.parquet").join(F.broadcast(ids), "event_type").select("stream_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").alias("v_f64"))
    for _ in range(2):
        conn.store.append(rows, "events")
    return conn


def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Streams created, filled and read back."""
    return event_store(spark, d).prepare_query('ev{kind=~"click|view"}', 0, MAX_TS).plan.df.select("ts", "value")


def store_hints(spark: SparkSession, d: str) -> DataFrame:
    """Every aggregate from the statistics that a store keeps."""
    conn = event_store(spark, d)
    plans = [(op, conn.prepare_query(f'{op}(ev{{kind="click"}})', *HINTED).plan.df) for op in HINT_OPS]
    each = [df.select(F.lit(op).alias("op"), F.round(F.col("value").cast("double"), 4).alias("value")) for op, df in plans]
    return reduce(DataFrame.unionAll, each)


def store_summary(spark: SparkSession, d: str) -> DataFrame:
    """Samples per stream as the statistics of its files have them, none of which has too many."""
    conn = event_store(spark, d)
    names = conn.get_all_streams().select("stream_id", F.element_at("labels", "kind").alias("kind"))
    per = conn.store.headers().groupBy("stream_id").agg(F.sum("n").alias("n"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), (F.max("n") <= 62_500).alias("rolled_over"))
    return names.join(per, "stream_id").drop("stream_id")


def store_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Which streams there are and of what type, one that isn't included."""
    conn = event_store(spark, d)
    names = {k: f'ev{{kind="{k}"}}' for k in (*EVENT_TYPES, "none")}
    there = {k: conn.check_stream_exists(n) for k, n in names.items()}
    return spark.createDataFrame([(k, there[k], conn.get_stream_value_type(n).value if there[k] else None) for k, n in names.items()], "kind string, present boolean, value_type string")


def store_http(spark: SparkSession, d: str) -> DataFrame:
    """A reply of the HTTP endpoint."""
    got = answer(spark, {"path": event_store(spark, d).store.path, "query": CLICK.replace("events", "ev").replace("event_type", "kind"), "start": START, "end": END})
    return spark.createDataFrame(list(zip(got["timestamps"], got["values_f64"])), "ts bigint, value double")


def store_streaming(spark: SparkSession, d: str) -> DataFrame:
    """Events that came into a store as a stream, which is started twice and whose batch is sent again."""
    conn = Connection(spark, scratch(spark, "store"))
    stream_id, checkpoint = conn.create_stream("all", V.FLOAT64), scratch(spark, "stream")
    rows = lambda df: df.select(F.lit(stream_id).alias("stream_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").alias("v_f64"))
    folder = scratch(spark, "arrivals")  # a stream of files needs a folder
    spark.read.parquet(f"{d}/events.parquet").select("ts", "value").write.parquet(folder)
    events = spark.read.parquet(folder)
    for _ in range(2):
        ingest(conn.store, rows(spark.readStream.schema(events.schema).parquet(folder)), checkpoint, available_now=True).awaitTermination()
    conn.store.append(rows(events), batch_name(checkpoint, 0))
    return conn.prepare_query("all", 0, MAX_TS).plan.df.select("ts", "value")


def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.csv import read_csv, write_csv

    q = Connection(spark, source=source(spark, d)).prepare_query(U_CLICK, 0, MAX_TS)
    path = scratch(spark, "csv")
    write_csv(q.plan.df, path)
    return read_csv(spark, path, V.FLOAT64)


def needed_files(spark: SparkSession, d: str) -> DataFrame:
    return required_files(spark.read.parquet(f"{d}/id_to_file.parquet"), *NEEDED).select("id", "filename", "start_ts", "end_ts")


def postings(spark: SparkSession, d: str) -> DataFrame:
    return streams_by_postings(spark.read.parquet(f"{d}/stream_to_ids.parquet"), WANTED)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: planned(n) for n in PLANNED} | {"list_streams": list_streams, "header_stats": header_stats, **{f"summary_hint_{op}": summary_hint(op) for op in HINT_OPS}, "store_roundtrip": store_roundtrip, "store_hints": store_hints, "store_summary": store_summary, "store_catalog": store_catalog, "store_http": store_http, "store_streaming": store_streaming, "csv_roundtrip": csv_roundtrip, "needed_files": needed_files, "postings": postings}


def oracle_sql() -> dict[str, str]:
    def rounded(sql: str, digits: int | None) -> str:
        if digits is None:
            return sql
        cols = "ts, " if sql.lstrip().upper().startswith(("SELECT TS", "WITH K")) else ""
        return f"SELECT {cols}round(value, {digits}) AS value FROM ({sql})"

    hinted = f"events WHERE event_type = 'click' AND {AT} BETWEEN {HINTED[0]} AND {HINTED[1]}"
    return {n: rounded(p[3], p[4]) for n, p in PLANNED.items()} | {
        "list_streams": "SELECT stream_id, array_to_string(list_sort(list_transform(map_entries(map_concat(MAP {'__name': coalesce(name, '')}, coalesce(labels, MAP {}))), lambda e: e.key || '=' || e.value)), ',') AS labels, value_type FROM streams",
        "header_stats": "SELECT event_type AS stream_id, strftime(ts, '%Y-%m-%d') AS file_id, min(epoch_us(ts)) AS min_ts, max(epoch_us(ts)) AS max_ts, count(*) AS n, round(sum(value), 4) AS value_sum, min(value) AS min_value, max(value) AS max_value, arg_min(value, ts) AS first_value FROM events GROUP BY ALL",
        **{f"summary_hint_{op}": f"SELECT round({op}({'*' if op == 'count' else 'value'}), 4)::DOUBLE AS value FROM {hinted}" for op in HINT_OPS},
        "store_roundtrip": vs("value", cond="event_type IN ('click', 'view')"),
        "store_hints": " UNION ALL ".join(f"SELECT '{op}' AS op, round({op}({'*' if op == 'count' else 'value'}), 4)::DOUBLE AS value FROM {hinted}" for op in HINT_OPS),
        "store_catalog": "SELECT DISTINCT event_type AS kind, true AS present, 'Float64' AS value_type FROM events UNION ALL SELECT 'none', false, NULL",
        "store_http": vs("value", f"{AT} BETWEEN {START} AND {END}"),
        "store_streaming": vs("value", cond="true"),
        "store_summary": f"SELECT event_type AS kind, count(*) AS n, min({AT}) AS min_ts, max({AT}) AS max_ts, true AS rolled_over FROM events GROUP BY ALL",
        "csv_roundtrip": vs("user_id"),
        "needed_files": f"SELECT id, filename, start_ts, end_ts FROM id_to_file WHERE (end_ts IS NULL OR end_ts >= {NEEDED[0]}) AND start_ts <= {NEEDED[1]}",
        "postings": "SELECT stream_id FROM (" + " INTERSECT ".join(f"SELECT {cid('e')} AS stream_id FROM (SELECT unnest(from_json(CASE WHEN json_valid(ids) AND json_type(ids) = 'ARRAY' THEN ids ELSE '[]' END, '[\"VARCHAR\"]')) AS e FROM stream_to_ids WHERE name = '{k}' AND value = '{v}') WHERE e IS NOT NULL" for k, v in WANTED.items()) + ")",
    }
