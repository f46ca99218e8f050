"""Command line: python -m seriesloom.cli STORE [command]; without a command, queries are read line by line."""

from __future__ import annotations

import argparse
import sys

from .api import Connection
from .chart import plot
from .errors import LoomError
from .functions.types import MAX_TS, ValueType
from .session import local_session
from .sources.csv import write_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seriesloom")
    p.add_argument("store")
    sub = p.add_subparsers(dest="command")
    sub.add_parser("list-all-streams")
    sub.add_parser("parse-headers")
    query = sub.add_parser("query")
    query.add_argument("query")
    query.add_argument("--start", type=int, default=0)
    query.add_argument("--end", type=int, default=MAX_TS)
    query.add_argument("--export-csv")
    query.add_argument("--chart", action="store_true")
    create = sub.add_parser("create-stream")
    create.add_argument("stream")
    create.add_argument("value_type", choices=["i64", "u64", "f64"])
    insert = sub.add_parser("insert")
    insert.add_argument("stream")
    insert.add_argument("timestamp", type=int)
    insert.add_argument("value")
    load = sub.add_parser("import-csv")
    load.add_argument("stream")
    load.add_argument("csv_file")
    return p


def show(conn: Connection, text: str, start: int, end: int, out, export: str | None = None, chart: bool = False) -> None:
    q = conn.prepare_query(text, start, end)
    if q.return_type == "scalar":
        while (v := q.next_scalar()) is not None:
            print(v, file=out)
    elif export:
        write_csv(q.df, export)
    elif chart:
        print(plot(q.df), file=out)
    else:
        while (row := q.next_vector()) is not None:
            print(*row, file=out)


def run(conn: Connection, a: argparse.Namespace, out=sys.stdout, lines=sys.stdin) -> None:
    if a.command == "list-all-streams":
        for r in conn.get_all_streams().toLocalIterator():
            name = r["labels"].get("__name")
            print(f"{name}{{{', '.join(f'{k}={v!r}' for k, v in sorted(r['labels'].items()) if k != '__name')}}} {r['value_type']} {r['stream_id']}", file=out)
    elif a.command == "parse-headers":
        for df in (conn.store.headers(), conn.store.files()):
            for r in df.toLocalIterator():
                print(*(f"{k}={v}" for k, v in r.asDict().items()), file=out)
    elif a.command == "query":
        show(conn, a.query, a.start, a.end, out, a.export_csv, a.chart)
    elif a.command == "create-stream":
        print(conn.create_stream(a.stream, ValueType.of(a.value_type)), file=out)
    elif a.command == "insert":
        ins = conn.prepare_insert(a.stream)
        number = float(a.value) if ins.value_type is ValueType.FLOAT64 else int(a.value)
        {ValueType.INTEGER64: ins.insert_integer64, ValueType.UINTEGER64: ins.insert_uinteger64, ValueType.FLOAT64: ins.insert_float64}[ins.value_type](a.timestamp, number)
        ins.flush()
    elif a.command == "import-csv":
        conn.import_csv(a.stream, a.csv_file)
    else:
        for line in lines:
            if line.strip():
                try:
                    show(conn, line.strip(), 0, MAX_TS, out)
                except LoomError as e:
                    print(f"error: {e}", file=out)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        run(Connection(local_session(), a.store), a)
    except LoomError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
