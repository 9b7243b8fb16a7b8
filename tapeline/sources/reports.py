"""Small results as files for people: CSV with a byte-order mark, JSON records, a Markdown table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

#: A report is read by people; more rows than this are a table, not a report.
ROWS = 10_000


def text_of(df: DataFrame, kind: str) -> str:
    """The rows of df as csv, json or md; fails above ROWS rows."""
    rows = [r.asDict() for r in df.limit(ROWS + 1).collect()]
    if len(rows) > ROWS:
        raise ValueError(f"more than {ROWS} rows: write them as Parquet")
    cols = df.columns
    say = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    if kind == "json":
        return json.dumps(rows, ensure_ascii=False, default=str, indent=1)
    if kind == "md":
        cell = lambda x: say(x).replace("|", "\\|")
        return "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in rows)]) + "\n"
    if kind == "csv":
        quote = lambda x: '"' + say(x).replace('"', '""') + '"' if any(k in say(x) for k in ',"\n') else say(x)
        return "\ufeff" + "\n".join([",".join(map(quote, cols)), *(",".join(quote(r[c]) for c in cols) for r in rows)]) + "\n"
    raise ValueError(f"unknown kind of report: {kind}")


def write_report(df: DataFrame, path: str, kind: str) -> None:
    """The report as one file in any file system that Spark writes to."""
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text_of(df, kind).encode()))
    out.close()
