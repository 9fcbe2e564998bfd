"""Run queries() beside oracle_sql() in DuckDB and compare schema, row count and values.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def kind(t: str) -> str:
    t = str(t).upper()
    for names, k in (
        (("DOUBLE", "FLOAT"), "double"), (("BIGINT", "LONG"), "bigint"), (("INTEGER", "INT"), "int"),
        (("VARCHAR", "STRING"), "string"), (("BOOLEAN",), "boolean"), (("DATE",), "date"), (("TIMESTAMP",), "timestamp"),
        (("DECIMAL", "HUGEINT"), "DECIMAL!"),
    ):
        if any(t.startswith(n) for n in names):
            return k
    return t


def check(spark, con, folder, name, fn, sql):
    start = time.time()
    df = fn(spark, folder)
    got = df.collect()
    seconds = time.time() - start
    if sql is None:
        return seconds, len(got), "rows-only"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = {d[0]: kind(d[1]) for d in res.description}
    want = res.fetchall()
    problems = []
    mine = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    if sorted(names) != sorted(mine):
        problems.append(f"columns {sorted(mine)} vs {sorted(names)}")
    else:
        off = {c: (mine[c], types[c]) for c in names if mine[c] != types[c]}
        if off:
            problems.append(f"types {off}")
        a, b = rows_of(df.columns, got)[1], rows_of(names, want)[1]
        if len(a) != len(b):
            problems.append(f"rows {len(a)} vs {len(b)}")
        if a != b:
            in_a, in_b = set(a), set(b)
            diff = [x for x in a if x not in in_b][:3], [x for x in b if x not in in_a][:3]
            problems.append(f"values {diff}")
    return seconds, len(got), "; ".join(problems) or "ok"


def main(folder="/root/testdata/sf0.01", *only):
    from __spark_entry__ import oracle_sql, queries
    from tallyflow.session import local_session

    spark, con = local_session(8, "compare"), connect(folder)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        try:
            seconds, n, verdict = check(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            seconds, n, verdict = 0, 0, "ERROR " + str(e)[:600]
        bad += verdict not in ("ok", "rows-only")
        print(f"{name:32s} {seconds:6.2f}s {n:8d} {verdict}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
