"""Run registered queries next to their statements and report differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(x):
    if x is None:
        return None
    if hasattr(x, "item") and not hasattr(x, "tolist"):
        x = x.item()
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(str(cell(y)) for y in x) + "]"
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in data]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((c is None, c or "") for c in r))


def compare(spark, con, q, sf_dir: str):
    """(ok, message, rows, seconds)"""
    t = time.time()
    df = q.plan(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if q.sql is None:
        return True, "rows only", len(got), took
    t = time.time()
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - t
    gn, gr = rows(df.columns, got)
    wn, wr = rows(names, want)
    if gn != wn:
        return False, f"columns {gn} vs {wn}", len(got), took
    if len(gr) != len(wr):
        return False, f"rows {len(gr)} vs {len(wr)}", len(got), took
    if gr != wr:
        a, b = sorted(set(gr) - set(wr), key=str), sorted(set(wr) - set(gr), key=str)
        diff = [(n, x, y) for n, x, y in zip(gn, a[0], b[0]) if x != y] if a and b else ""
        return False, f"{len(a)} rows differ, e.g. {str(diff)[:1500]}", len(got), took
    return True, f"sql {sql_took:.1f}s", len(got), took


def main(argv: list[str]) -> int:
    from paperloom.plans import load_all
    from paperloom.session import build_session, prepare

    sf_dir = argv[0]
    patterns = argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    prepare(spark)
    con = connect(sf_dir)
    bad = 0
    for name, q in load_all().items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        try:
            ok, message, n, took = compare(spark, con, q, sf_dir)
        except Exception as e:  # a report tool: show every failure and go on
            ok, message, n, took = False, f"{type(e).__name__}: {str(e)[:1200]}", -1, 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={n} {took:.1f}s {message}", flush=True)
    print("failures", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
