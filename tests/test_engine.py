"""Golden cases of every query operator, on a store and on tables."""

import math

import pytest

from seriesloom.api import Connection
from seriesloom.errors import CatalogError, NoStreamsMatchedError, QuerySyntaxError, TimeRangeError, UnsupportedError, ValueTypeError
from seriesloom.functions.types import ValueType as V

INSERT = {V.INTEGER64: "insert_integer64", V.UINTEGER64: "insert_uinteger64", V.FLOAT64: "insert_float64"}


def fill(conn, stream, kind, times, values):
    conn.create_stream(stream, kind)
    ins = conn.prepare_insert(stream)
    for t, v in zip(times, values):
        getattr(ins, INSERT[kind])(t, v)
    ins.flush()


@pytest.fixture(scope="module")
def conn(spark, tmp_path_factory):
    c = Connection(spark, str(tmp_path_factory.mktemp("store") / "db"))
    t4 = [10, 20, 30, 40]
    fill(c, "ints", V.INTEGER64, t4, [2, 4, 6, 8])
    fill(c, "uints", V.UINTEGER64, t4, [1, 2, 3, 4])
    fill(c, "floats", V.FLOAT64, t4, [4.1, 3.2, 2.3, 1.4])
    web = [23, 29, 40, 51]
    fill(c, 'req{service = "web"}', V.UINTEGER64, web, [45, 47, 23, 48])
    fill(c, 'req{service="mobile"}', V.UINTEGER64, web, [9, 18, 0, 100])
    fill(c, "ia", V.UINTEGER64, t4, [0, 20, 0, 20])
    fill(c, "ib", V.UINTEGER64, [5, 15, 25, 35, 45], [10] * 5)
    fill(c, "ca", V.UINTEGER64, [1, 2, 4, 6, 10, 12, 13, 14, 15, 16], [10, 20, 30, 20, 20, 10, 15, 20, 80, 100])
    fill(c, "cb", V.UINTEGER64, [3, 5, 7, 8, 9, 11, 16], [30, 30, 10, 20, 20, 10, 10])
    fill(c, "neg", V.INTEGER64, [1, 2, 3, 4], [-5, -7, -1, -1000])
    fill(c, "nans", V.FLOAT64, [1, 2, 3], [math.nan, 1.0, 5.0])
    fill(c, 'mixed{t="i"}', V.INTEGER64, [1], [-3])
    fill(c, 'mixed{t="f"}', V.FLOAT64, [2], [1.5])
    fill(c, "big", V.UINTEGER64, [1, 2], [2**64 - 1, 5])
    return c


def run(conn, text, start=0, end=100, **kw):
    q = conn.prepare_query(text, start, end, **kw)
    return [float(r["value"]) for r in q.df.collect()]


CASES = [
    ("ints + floats", [6.1, 7.2, 8.3, 9.4]), ("ints - uints", [1, 2, 3, 4]), ("ints * floats", [8.2, 12.8, 13.8, 11.2]),
    ("ints / uints", [2, 2, 2, 2]), ("ints % floats", [2.0, 0.8, 1.4, 1.0]), ("ints + 2", [4, 6, 8, 10]),
    ("uints - 2.5", [-1.5, -0.5, 0.5, 1.5]), ("floats * 11", [45.1, 35.2, 25.3, 15.4]), ("ints / -4", [-0.5, -1, -1.5, -2]),
    ("uints % 2", [1, 0, 1, 0]), ("(ints % 4) == 2", [2, 2]), ("uints != 2", [1, 3, 4]), ("floats > 2.3", [4.1, 3.2]),
    ("floats < 3.2", [2.3, 1.4]), ("floats >= 2.3", [4.1, 3.2, 2.3]), ("floats <= 3.2", [3.2, 2.3, 1.4]),
    ("(2 + 3 - 4.5) * (5 / 2.3) % 1", [0.0869565]), ("sum(ints)", [20]), ("sum(ints < 0)", []), ("count(uints)", [4]),
    ("count(ints < 0)", [0]), ("avg(floats)", [2.75]), ("avg(ints < 0)", []), ("min(ints)", [2]), ("min(ints < 0)", []),
    ("max(uints)", [4]), ("max(ints < 0)", []), ("topk(2, ints)", [8, 6]), ("topk(100, uints)", [4, 3, 2, 1]),
    ("topk(0, floats)", []), ("bottomk(2, ints)", [2, 4]), ("bottomk(100, uints)", [1, 2, 3, 4]), ("bottomk(0, floats)", []),
    ('req{service="web"} * req{service="mobile"}', [405, 846, 0, 4800]),
    ("ia + ib", [10, 10, 20, 30, 20, 10, 20, 30, 30]), ("ib + ia", [10, 10, 20, 30, 20, 10, 20, 30, 30]),
    ("ca + cb", [40, 50, 55, 60, 55, 40, 30, 40, 40, 35, 25, 20, 25, 30, 90, 110]),
    ('req{service="web"} + sum(req{service="mobile"})', [172, 174, 150, 175]),
    ('sum(req{service="web"}) / sum(req{service="mobile"})', [163 / 127]),
    ("topk(2, neg)", [-1, -5]), ("sum(neg)", [-1013]), ("min(neg)", [-1000]), ("neg % 4", [-1, -3, -1, 0]),
    # decisions where the plain reading wins
    ("count((ints))", [4]), ("avg((ints))", [5]), ("10 - ints", [8, 6, 4, 2]), ("5 < ints", [6, 8]), ("ints / 0", [math.inf] * 4),
    ("ints % 0", [math.nan] * 4), ("0 / 0", [math.nan]), ("max(nans)", [5]), ("min(nans)", [1]), ("topk(5, nans)", [5, 1]),
    ("nans > 0", [1, 5]), ("nans != 1", [math.nan, 5]), ("sum(mixed)", [-1.5]), ("ints + sum(ints < 0)", []),
    ("topk(sum(uints) - 8.5, ints)", [8]), ("topk(2, ints) + topk(3, uints)", [12, 9]), ("1 + topk(2, ints)", [9]),
    ("sum(ints) * 2", [40]), ("max(big)", [float(2**64 - 1)]), ("ints{missing=\"\"}", [2, 4, 6, 8]),
    ('sum(req{service!="web"})', [127]), ('sum(req{service=~"w.*"})', [163]), ('sum(req{service!~"w.*"})', [127]),
    ('count(req{service="web" or service="mobile"})', [8]), ("sum(ints @ start())", [20]), ("count(ints @ end())", [0]),
    ("sum(ints @ 0 offset 25ms)", [14]), ("0x10 + 1e1", [26]), ("-(2)", [-2]),
]


@pytest.mark.parametrize(("text", "expected"), CASES, ids=[c[0] for c in CASES])
def test_golden(conn, text, expected):
    got = run(conn, text)
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert (math.isnan(g) and math.isnan(e)) or g == pytest.approx(e, abs=1e-6)


@pytest.mark.parametrize(("op", "full", "part"), [("sum", 163, 70), ("count", 4, 2), ("avg", 40.75, 35), ("min", 23, 23), ("max", 48, 47)])
@pytest.mark.parametrize("hints", [True, False])
def test_ranges_and_hints(conn, op, full, part, hints):
    text = f'{op}(req{{service="web"}})'
    assert run(conn, text, 23, 51, hints=hints) == [full]
    assert run(conn, text, 29, 40, hints=hints) == [part]
    assert run(conn, text, 60, 70, hints=hints) == ([0] if op == "count" else [])


@pytest.mark.parametrize(("text", "error", "label"), [
    ("-ints", UnsupportedError, "Unary"), ('"x"', UnsupportedError, "String Literal"), ("ints[5m]", UnsupportedError, "Matrix"),
    ("ints[5m:1m]", UnsupportedError, "Subquery"), ("rate(ints[5m])", UnsupportedError, "Call"), ("ints offset 5m", UnsupportedError, "offset"),
    ("1 > 2", UnsupportedError, "scalars"), ("ints > uints", UnsupportedError, "vectors"), ("req + ints", UnsupportedError, "several"),
    ("sum(2)", UnsupportedError, "scalar"), ("sum(topk(1, ints))", UnsupportedError, "scalar"), ("ints > bool 1", UnsupportedError, "bool"),
    ("ints + on(a) uints", UnsupportedError, "matching"), ("ints and uints", QuerySyntaxError, "and"), ("2 ^ 3", QuerySyntaxError, "^"),
    ("stddev(ints)", UnsupportedError, "Call"), ("topk(ints)", QuerySyntaxError, "two"), ("ints +", QuerySyntaxError, ""), ('{a="b"}', QuerySyntaxError, "name"),
    ("nothing", NoStreamsMatchedError, "nothing"), ('ints{a="b"}', NoStreamsMatchedError, ""), ("ints $", QuerySyntaxError, ""),
])
def test_errors(conn, text, error, label):
    with pytest.raises(error, match=label.replace("^", r"\^")):
        conn.prepare_query(text, 0, 100)


def test_range_errors_and_types(conn):
    for a, b in ((None, 1), (1, None), (5, 1)):
        with pytest.raises(TimeRangeError):
            conn.prepare_query("ints", a, b)
    assert run(conn, "1 + 1", None, None) == [2]
    types = {"ints + 2": V.FLOAT64, "ints - uints": V.INTEGER64, "ints / uints": V.FLOAT64, "ints > 1": V.INTEGER64, "count(floats)": V.FLOAT64, "count(floats > 1)": V.UINTEGER64, "avg(ints)": V.FLOAT64, "topk(1, uints)": V.UINTEGER64}
    assert {k: conn.prepare_query(k, 0, 100).value_type for k in types} == types


def test_cursors(conn):
    q = conn.prepare_query("ints", 15, 35)
    assert [q.next_vector() for _ in range(3)] == [(20, 4), (30, 6), None]
    q = conn.prepare_query("sum(ints)", 0, 100)
    assert [q.next_scalar(), q.next_scalar()] == [20, None]
    with pytest.raises(TypeError):
        q.next_vector()


def test_catalog(spark, tmp_path):
    c = Connection(spark, str(tmp_path / "db"))
    assert c.get_all_streams().isEmpty()
    for s, k in (('str1{a="b"}', V.UINTEGER64), ('str2{c="d"}', V.INTEGER64), ('str3{e="f"}', V.FLOAT64)):
        c.create_stream(s, k)
    assert {(r["labels"]["__name"], len(r["labels"]), r["value_type"]) for r in c.get_all_streams().collect()} == {("str1", 2, "UInteger64"), ("str2", 2, "Integer64"), ("str3", 2, "Float64")}
    with pytest.raises(CatalogError):
        c.create_stream('str1{a="b"}', V.FLOAT64)
    c.create_stream("str1", V.UINTEGER64)
    assert c.check_stream_exists("str1") and c.check_stream_exists('str1{a="b"}') and not c.check_stream_exists("str9")
    for s in ("str1", "str9"):
        with pytest.raises(CatalogError):
            c.prepare_insert(s)
    ins = c.prepare_insert('str1{a="b"}')
    for ts, v, m in ((1, -1, "insert_uinteger64"), (1, 1, "insert_integer64"), (-1, 1, "insert_uinteger64")):
        with pytest.raises(ValueTypeError):
            getattr(ins, m)(ts, v)
    ins.insert_uinteger64(1, 7)
    assert run(c, 'str1{a="b"}') == []  # not flushed
    ins.flush()
    assert run(c, 'str1{a="b"}') == [7]
    for bad in ('x{a="1", a="2"}', 'x{a!="1"}', "x @ 1", "1", "x{"):
        with pytest.raises(QuerySyntaxError):
            c.create_stream(bad, V.FLOAT64)
    with pytest.raises(NotImplementedError):
        c.delete_stream("str1")
    c.store.drop()
    assert not (tmp_path / "db").exists()


def test_interpolation_rounds_and_carries(spark):
    from seriesloom.operators.interpolate import interpolated

    def series(rows, kind):
        return spark.createDataFrame(rows, f"ts bigint, value {kind.spark}")

    a = series([(0, 0), (10, -5), (10, -9), (None, 3), (4, None)], V.INTEGER64)
    b = series([(1, 1), (2, 1), (9, 1), (12, 2)], V.INTEGER64)
    for ranges, parts in ((1, 1), (1, 7), (3, 2), (64, 64)):
        df, kind = interpolated("+", a, V.INTEGER64, b, V.INTEGER64, ranges, parts)
        assert kind is V.INTEGER64
        assert sorted((r["ts"], r["value"]) for r in df.collect()) == [(0, 1), (1, 0), (2, 0), (9, -4), (10, -4), (12, -3)]
    df, kind = interpolated("-", a, V.INTEGER64, series([(5, 0.5)], V.FLOAT64), V.FLOAT64)
    assert sorted((r["ts"], r["value"]) for r in df.collect()) == [(0, -0.5), (5, -3.0), (10, -5.5)]
    assert interpolated("+", a, V.INTEGER64, a.limit(0), V.INTEGER64)[0].collect() == []


def test_stray_times_dont_crowd_a_range(spark):
    """Parts follow the samples, not the calendar: far strays leave the others spread."""
    from pyspark.sql import functions as F

    from seriesloom.operators.interpolate import interpolated

    a = spark.range(20_000).select(F.when(F.col("id") == 0, 2**62).otherwise(F.col("id")).alias("ts"), F.lit(1.0).alias("value"))
    df, _ = interpolated("+", a, V.FLOAT64, a, V.FLOAT64)
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        points = df.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("count"), F.sum("value").alias("sum")).collect()
    finally:
        spark.conf.unset(merge)
    assert sum(r["count"] for r in points) == 20_000 and sum(r["sum"] for r in points) == 40_000
    assert len(points) == 4 and max(r["count"] for r in points) < 10_000
