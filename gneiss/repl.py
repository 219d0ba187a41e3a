"""SQL shell: python -m gneiss.repl [-c SQL]... [-f FILE]... [--tables FOLDER] [--format table|csv|tsv|json] [--maxrows N].

Without -c or -f it reads statements from standard input, each ended by a semicolon.  A file
~/.gneissrc, or the one named by --rc, is run first.  EXPLAIN ANALYZE <query> runs the query and
shows its stages, rows, time and metrics; SHOW COLUMNS FROM <table>, CREATE VIEW, SET and paths as
tables (SELECT * FROM '<file>.parquet') work too.
"""

from __future__ import annotations

import argparse
import csv
import io
import json
import re
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from gneiss import catalog
from gneiss.functions import dialect
from gneiss.plans import explain
from gneiss.session import session, set_option


def statements(text: str) -> list[str]:
    """Splits at semicolons outside of texts and comments."""
    out, now = [], []
    for t in dialect.tokens(text):
        if t == ";":
            out.append("".join(now))
            now = []
        elif not t.startswith(("--", "/*")):
            now.append(t)
    return [s.strip() for s in [*out, "".join(now)] if s.strip()]


def run(spark: SparkSession, statement: str) -> DataFrame | str | None:
    """The result of one statement: rows, a text, or nothing."""
    low = statement.lower()
    if low.startswith("explain analyze"):
        body = re.sub(r"(?i)^explain\s+analyze\s+(verbose\s+)?", "", statement)
        report, tasks = explain.analyze_tasks(catalog.run(spark, body))
        detail = "\n".join(f"{k} = {v}" for k, v in sorted(report.metrics.items())) if "verbose" in low.split()[:3] else ""
        times = "\n".join(f"stage {s.stage}: {s.tasks} tasks, ms " + ", ".join(f"{k} {v:g}" for k, v in s.durations.items()) for s in tasks)
        return f"{report.plan}\nrows {report.rows}, {report.seconds:.3f} s\n{times}\n{detail}".rstrip()
    if m := re.fullmatch(r"(?is)show\s+columns\s+from\s+(\w+)", statement):
        return catalog.show_columns(spark, m[1])
    if low.startswith("set "):
        set_option(spark, statement)
        return None
    if m := re.match(r"(?is)copy\s*\((.*)\)\s*to\s*'([^']+)'\s*stored\s+as\s+(\w+)$", statement):
        catalog.copy_to(catalog.run(spark, m[1]), m[2], m[3].lower())
        return None
    text = re.sub(r"(?i)\bcreate\s+view\b", "CREATE OR REPLACE TEMP VIEW", statement)
    text = re.sub(r"(?i)\bfrom\s+'([^']+\.(parquet|csv|json|orc))'", lambda m: f"FROM {m[2].lower()}.`{m[1]}`", text)
    df = catalog.run(spark, text)
    return df if df.columns else None


def show(result: DataFrame | str | None, kind: str, maxrows: int) -> str:
    if result is None or isinstance(result, str):
        return result or ""
    rows = [r.asDict() for r in (result.limit(maxrows) if maxrows else result).collect()]
    if kind == "json":
        return "\n".join(json.dumps(r, default=str) for r in rows)
    text = [["" if r[c] is None else str(r[c]) for c in result.columns] for r in rows]
    if kind in {"csv", "tsv"}:
        out = io.StringIO()
        csv.writer(out, delimiter="," if kind == "csv" else "\t", lineterminator="\n").writerows([result.columns, *text])
        return out.getvalue().rstrip("\n")
    width = [max(map(len, column)) for column in zip(result.columns, *text, strict=True)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)) + " |"
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    return "\n".join([rule, line(result.columns), rule, *map(line, text), rule])


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gneiss", description=__doc__.split("\n")[0])
    parser.add_argument("-c", "--command", action="append", default=[])
    parser.add_argument("-f", "--file", action="append", default=[])
    parser.add_argument("--rc", default=str(Path.home() / ".gneissrc"))
    parser.add_argument("--tables")
    parser.add_argument("--format", choices=["table", "csv", "tsv", "json"], default="table")
    parser.add_argument("--maxrows", type=int, default=40, help="0: all")
    parser.add_argument("--master", default=None)
    given = parser.parse_args(arguments)
    spark = session("gneiss", given.master)
    if given.tables:
        catalog.register_tables(spark, given.tables, [t for t in catalog.TABLES if Path(given.tables, f"{t}.parquet").exists()])
    texts = [Path(given.rc).read_text()] if Path(given.rc).exists() else []
    texts += [*given.command, *(Path(f).read_text() for f in given.file)]
    if not given.command and not given.file:
        texts.append(sys.stdin.read())
    for text in texts:
        for statement in statements(text):
            try:
                if out := show(run(spark, statement), given.format, given.maxrows):
                    print(out)
            except Exception as failure:  # a shell goes on with what comes next
                print(f"error: {str(failure).splitlines()[0]}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
