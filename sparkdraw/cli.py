"""Command line: ``inspect`` prints a structural summary, ``audit`` corpus statistics."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .corpus import read


def _rows(df) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().toLocalIterator()]


def _told(report: dict) -> list[str]:
    """The lines of one drawing's report."""
    out = [f"{report['drawing_id']}: {report['source_size']} bytes, {report['line_count']} lines, {report['section_count']} sections, {report['record_count']} records, {report['termination']}"]
    out += [f"  {name}: {n}" for name, n in sorted((report.get("record_types") or {}).items())]
    return out + ["  " + ", ".join(f"{k}={v}" for k, v in row.items()) for part in ("records", "lines", "diagnostics") for row in report.get(part, ())]


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkdraw")
    commands = parser.add_subparsers(dest="command", required=True)
    inspect = commands.add_parser("inspect", help="print what each drawing is made of")
    inspect.add_argument("paths", nargs="+")
    for name in ("json", "records", "lines"):
        inspect.add_argument(f"--{name}", action="store_true")
    audit = commands.add_parser("audit", help="print counts over all drawings")
    audit.add_argument("paths", nargs="+")
    audit.add_argument("--json", action="store_true")
    asked = parser.parse_args(arguments)
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    corpus = read(spark, asked.paths)
    try:
        if asked.command == "audit":
            rows = _rows(corpus.audit().orderBy("metric", "item", "value"))
            # A row a file, one at a time.
            files = (json.loads(x) for x in corpus.audit_files().orderBy("drawing_id").toJSON().toLocalIterator())
            skipped = _rows(corpus.errors)
            if asked.json:
                print(json.dumps({"statistics": rows, "skipped": skipped, "files": list(files)}))
            else:
                print("| metric | item | value | count |\n|---|---|---|---:|")
                for r in rows:
                    print(f"| {r['metric']} | {r['item']} | {r['value']} | {r['count']} |")
                print("\n| file | sha256 | bytes | logical | version | encoding | typed | unsupported |\n|---|---|---:|---:|---|---|---:|---:|")
                for r in files:
                    print(f"| {r['drawing_id']} | {r['sha256']} | {r['container_size']} | {r['logical_size']} | {r.get('version')} | {r.get('encoding')} | {r['typed_entities']} | {r['unsupported_entities']} |")
            return 0
        failed, opening = False, "["
        # Reports are made by executors; the driver holds one at a time.
        for row in corpus.inspect(asked.records, asked.lines).orderBy("failed", "drawing_id").toLocalIterator():
            report = json.loads(row["report"])
            if row["failed"]:
                failed = True
                print(f"{report['drawing_id']}: {report['error']['class']}: {report['error']['message']}", file=sys.stderr)
            elif asked.json:
                print(opening, json.dumps(report), sep="\n")
                opening = ","
            else:
                print(*_told(report), sep="\n")
        if asked.json:
            print("[]" if opening == "[" else "]")
        return int(failed)
    finally:
        corpus.close()


if __name__ == "__main__":
    sys.exit(main())
