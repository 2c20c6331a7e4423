"""Presto SQL from the command line: python -m tessera.cli --data FOLDER [--query TEXT] [--record FILE | --check FILE]."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.operators.explain import skeleton
from tessera.session import Session
from tessera.sources.connectors import FolderConnector


def split_statements(text: str) -> list[str]:
    """At semicolons outside strings."""
    out, quoted = [""], False
    for c in text:
        quoted ^= c == "'"
        if c == ";" and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [s.strip() for s in out if s.strip()]


def outcome(session: Session, text: str, most: int) -> dict:
    """What a golden file holds of a statement: its error, or its plan's skeleton and rows in a fixed order."""
    try:
        df = session.sql(text)
        rows = [[str(v) for v in r] for r in df.limit(most).collect()]
        return {"sql": text, "columns": df.columns, "plan": skeleton(df), "rows": sorted(rows)}
    except Exception as e:
        return {"sql": text, "error": type(e).__name__}


def show(session: Session, text: str, most: int) -> None:
    began = time.time()
    df = session.sql(text)
    rows = df.limit(most).collect()
    print("\t".join(df.columns))
    for r in rows:
        print("\t".join("NULL" if v is None else str(v) for v in r))
    print(f"({len(rows)} rows in {time.time() - began:.2f} s)", file=sys.stderr)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("--data", required=True, help="folder of tables")
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--query", help="statements to run; else they are read from standard input")
    parser.add_argument("--record", help="file that takes plans, rows and errors")
    parser.add_argument("--check", help="file of an earlier --record to compare with")
    parser.add_argument("--most", type=int, default=100, help="rows shown of a result")
    options = parser.parse_args(arguments)
    session = Session(SparkSession.builder.getOrCreate())
    session.add("folder", FolderConnector(session.spark, options.data, options.format))
    history: list[str] = []
    if options.check:
        want = json.loads(Path(options.check).read_text())
        differ = [x["sql"] for x in want if outcome(session, x["sql"], options.most) != x]
        print("\n".join(f"differs: {x}" for x in differ) or f"{len(want)} agree")
        return bool(differ)
    texts = split_statements(options.query if options.query is not None else sys.stdin.read())
    if options.record:
        Path(options.record).write_text(json.dumps([outcome(session, t, options.most) for t in texts], indent=1))
        return 0
    failed = 0
    for text in texts:
        if text.lower().startswith("savehistory "):
            Path(text.split(None, 1)[1]).write_text(";\n".join(history) + ";\n")
        elif text.lower() == "clearhistory":
            history.clear()
        else:
            history.append(text)
            try:
                show(session, text, options.most)
            except Exception as e:
                failed = 1
                print(f"{type(e).__name__}: {str(e).splitlines()[0]}", file=sys.stderr)
    return failed


if __name__ == "__main__":
    sys.exit(main())
