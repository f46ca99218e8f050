"""HTTP: GET /health, POST /query {path, query, start?, end?} with a JSON reply; errors in the query give 400."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .api import Connection
from .errors import LoomError
from .functions.types import ValueType

MOST_ROWS = 1_000_000
FIELDS = {ValueType.INTEGER64: "values_i64", ValueType.UINTEGER64: "values_u64", ValueType.FLOAT64: "values_f64"}


def answer(spark: SparkSession, body: dict) -> dict:
    """A scalar has no timestamps. The whole result is one reply; one of more than MOST_ROWS rows is refused."""
    q = Connection(spark, body["path"]).prepare_query(body["query"], body.get("start"), body.get("end"))
    rows = q.df.take(MOST_ROWS + 1)
    if len(rows) > MOST_ROWS:
        raise ValueError(f"the result has more than {MOST_ROWS} rows; narrow the range or export it")
    return {"value_type": q.value_type.value, "timestamps": [r["ts"] for r in rows] if q.return_type == "vector" else [], FIELDS[q.value_type]: [q._python(r["value"]) for r in rows]}


def server(spark: SparkSession, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, body: object = None) -> None:
            data = b"" if body is None else json.dumps(body).encode()
            self.send_response(code)
            for k, v in (("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "*"), ("Access-Control-Allow-Methods", "*"), ("Content-Type", "application/json"), ("Content-Length", str(len(data)))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def do_OPTIONS(self) -> None:  # noqa: N802
            self.reply(204)

        def do_GET(self) -> None:  # noqa: N802
            self.reply(200 if self.path == "/health" else 404)

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/query":
                return self.reply(404)
            try:
                return self.reply(200, answer(spark, json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))))
            except (LoomError, KeyError, ValueError, TypeError) as e:
                return self.reply(400, {"error": str(e)})

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
