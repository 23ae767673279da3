"""Run registered queries against their SQL and compare the rows."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def database(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("+00:00", "")
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr), [names[i] for i in order]


def compare(spark, con, folder, name, function, sql):
    """Empty text when equal, else the difference."""
    df = function(spark, folder)
    got, got_names = rows_of(df.columns, [tuple(row) for row in df.collect()])
    if sql is None:
        return ""
    result = con.execute(sql)
    want, want_names = rows_of([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        extra = [row for row in got if row not in want][:3] if len(got) < 5000 else got[:3]
        lost = [row for row in want if row not in got][:3] if len(want) < 5000 else want[:3]
        first = next(((g, w) for g, w in zip(got, want) if g != w), None)
        return f"{len(got)} rows, expected {len(want)}\n  spark only {extra}\n  sql only {lost}\n  first {first}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from stocklens.session import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, function in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, function, sqls.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - start:.1f}s {'' if name in sqls else '(no SQL)'} {problem}", flush=True)
    print(f"{bad} bad of {len(entry.queries())}; without SQL: {[n for n in entry.queries() if n not in sqls]}")
