"""Run registered queries next to their SQL in an in-process DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 9)
    if isinstance(value, bool):
        return ("bool", value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    """None when rows agree, else a short description of the difference."""
    df = fn(spark, sf_dir)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    if sql is None:
        return None, len(got)
    cur = con.execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}", len(got)
    a, b = _bag(got_names, got), _bag(want_names, want)
    if a == b:
        return None, len(got)
    extra, missing = list((a - b).items())[:3], list((b - a).items())[:3]
    return (f"rows {len(got)} vs {len(want)}; cols {sorted(got_names)}\n    spark only {extra}"
            f"\n    sql only   {missing}"), len(got)


def main(argv):
    from paneloom.plans import catalog
    from paneloom.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), database(sf_dir)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, fn, catalog.ORACLES.get(name))
        except Exception as error:  # report and go on to the next query
            problem, n = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += problem is not None
        kind = "sql " if name in catalog.ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:<44} rows={n:<7} {time.time() - start:.2f}s"
              + (f"\n    {problem}" if problem else ""), flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
