"""CSV, command line, HTTP and streaming ingest."""

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from seriesloom import cli, http
from seriesloom.api import Connection
from seriesloom.chart import plot
from seriesloom.functions.types import ValueType as V
from seriesloom.operators.catalog import required_files, streams_by_postings
from seriesloom.sources import warehouse
from seriesloom.sources.csv import CsvError, read_csv
from seriesloom.streaming.ingest import batch_name, ingest


@pytest.fixture
def conn(spark, tmp_path):
    return Connection(spark, str(tmp_path / "db"))


def test_csv(conn, spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("Timestamp,Value\n1,5\n2,7\n")
    conn.create_stream("m", V.UINTEGER64)
    conn.import_csv("m", str(f))
    out = io.StringIO()
    run = lambda *a: cli.run(conn, cli.parser().parse_args(["x", *a]), out, ["sum(m)\n", "\n", "oops(\n"])
    run("query", "m", "--export-csv", str(tmp_path / "out"))
    assert [(r["ts"], r["value"]) for r in read_csv(spark, str(tmp_path / "out"), V.FLOAT64).orderBy("ts").collect()] == [(1, 5.0), (2, 7.0)]
    run("query", "m")
    run("create-stream", "n{a=\"b\"}", "f64")
    run("insert", "n", "3", "1.5")
    run("query", "sum(n)")
    run("query", "m", "--chart")
    run("list-all-streams")
    run("parse-headers")
    run()
    text = out.getvalue()
    assert "1 5\n2 7\n" in text and "1.5\n" in text and "n{a='b'} Float64" in text and "sum_value=12.0" in text and "ratio=" in text and "\n7\n" in text and "\n12\n" in text and "error:" in text
    f.write_text("Timestamp,Value\n1,5\n2,-7\n")
    with pytest.raises(CsvError, match="line 3"):
        read_csv(spark, str(f), V.UINTEGER64)
    f.write_text("Timestamp,Value\n")
    assert read_csv(spark, str(f), V.UINTEGER64).isEmpty()


def test_chart(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(1000)] + [(5, float("nan"))], "ts bigint, value double")
    lines = plot(df, 50, 10).split("\n")
    assert lines[0] == "9" and lines[-1] == "0" and len(lines) == 12 and lines[5].count("*") == 50
    assert plot(df.limit(0)) == ""


def test_catalog_lookups(spark):
    files = spark.createDataFrame([("a", "1", 1, 3), ("a", "2", 3, 5), ("a", "3", 5, 7), ("b", "4", 6, None), ("b", "5", None, 9)], "id string, filename string, start_ts bigint, end_ts bigint")
    names = lambda s, e: sorted(r["filename"] for r in required_files(files, s, e).collect())
    assert names(4, 4) == ["2"] and names(2, 6) == ["1", "2", "3", "4"] and names(99, 99) == ["4"] and names(0, 0) == []
    post = spark.createDataFrame([("n", "x", '["a", "b", null]'), ("n", "x", '["c"'), ("n", "x", '["C"]'), ("l", "1", '["c", "a", "a"]'), ("l", "2", '["b"]'), ("n", None, '["q"]'), (None, "x", None)], "name string, value string, ids string")
    assert sorted(r[0] for r in streams_by_postings(post, {"n": "x", "l": "1"}).collect()) == ["a", "c"]
    assert streams_by_postings(post, {}).collect() == [] and streams_by_postings(post.limit(0), {"n": "x"}).collect() == []


def test_http(conn, spark, tmp_path):
    conn.create_stream("m", V.INTEGER64)
    ins = conn.prepare_insert("m")
    ins.insert_integer64(1, -5)
    ins.flush()
    srv = http.server(spark, 0)
    threading.Thread(target=srv.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{srv.server_port}"

    def post(**body):
        return json.load(urllib.request.urlopen(urllib.request.Request(f"{url}/query", json.dumps(body).encode(), method="POST")))

    try:
        assert urllib.request.urlopen(f"{url}/health").status == 200
        path = str(tmp_path / "db")
        assert post(path=path, query="m", start=0, end=9) == {"value_type": "Integer64", "timestamps": [1], "values_i64": [-5]}
        assert post(path=path, query="sum(m)", start=0, end=9) == {"value_type": "Integer64", "timestamps": [], "values_i64": [-5]}
        with pytest.raises(urllib.error.HTTPError) as e:
            post(path=path, query="m")
        assert e.value.code == 400
    finally:
        srv.shutdown()


def test_streaming(conn, spark, tmp_path):
    sid = conn.create_stream("m", V.FLOAT64)
    spark.createDataFrame([(sid, 5, 1.0), (sid, 3, 2.0), (sid, 5, 1.0)], "stream_id string, ts bigint, v_f64 double").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stream_id string, ts bigint, v_f64 double").parquet(str(tmp_path / "in"))
    ingest(conn.store, source, str(tmp_path / "cp"), available_now=True).awaitTermination(60)
    assert [r["value"] for r in conn.prepare_query("m", 0, 9).df.collect()] == [2.0, 1.0, 1.0]
    assert conn.prepare_query("count(m)", 0, 9).next_scalar() == 3
    again = spark.read.parquet(str(tmp_path / "in"))
    conn.store.append(again, batch_name(str(tmp_path / "cp"), 0))  # the same micro-batch once more, as after a failure
    assert conn.prepare_query("count(m)", 0, 9).next_scalar() == 3 and conn.prepare_query("count(m)", 0, 9, hints=False).next_scalar() == 3


def test_files_roll_over(conn, spark, monkeypatch):
    """Two flushes of one and a half files: statistics per file, none too large, and three full ones when compacted."""
    monkeypatch.setattr(warehouse, "MAX_ENTRIES", 100)
    conn.create_stream("m", V.INTEGER64)
    for i in range(2):
        ins = conn.prepare_insert("m")
        for t in range(150):
            ins.insert_integer64(1000 * i + t, t)
        ins.flush()
    sizes = lambda: sorted(r["n"] for r in conn.store.headers().collect())
    assert sizes() == [50, 50, 100, 100]
    want = [float(r["value"]) for r in conn.prepare_query("m", 0, 9999).df.collect()]
    conn.store.compact()
    assert sizes() == [100, 100, 100] and [float(r["value"]) for r in conn.prepare_query("m", 0, 9999).df.collect()] == want
    for op in ("sum", "count", "avg", "min", "max"):
        assert conn.prepare_query(f"{op}(m)", 120, 1080).next_scalar() == conn.prepare_query(f"{op}(m)", 120, 1080, hints=False).next_scalar()
    first = [r["first_value"] for r in conn.store.headers().orderBy("min_ts").collect()]
    assert first == [0, 100, 50]
