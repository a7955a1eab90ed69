"""Runs registered queries and their SQL side by side: ``python tests/compare.py [sf] [query ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "int": "INTEGER",
}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def differences(spark, con, fn, sql: str, sf_dir: str) -> list[str]:
    """Empty when names, types, row count and values agree."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    out = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(set(df.columns) ^ set(names))}"]
    for n, t in df.dtypes:
        if KINDS.get(t) != types[n]:
            out.append(f"type of {n}: {t} / {types[n]}")
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        out.append(f"rows {len(a)} / {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        out.append(f"values: {len(sa - sb)} only here, {len(sb - sa)} only there")
        out += [f"  here  {r}" for r in sorted(sa - sb)[:3]] + [f"  there {r}" for r in sorted(sb - sa)[:3]]
        out.append(f"  order {sorted(df.columns)}")
    if not a:
        out.append("no rows at all")
    return out


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from fieldcast.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sql = oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sql:
                bad = differences(spark, con, fn, sql[name], folder)
            else:
                bad = [] if fn(spark, folder).count() else ["no rows"]
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            bad = [f"{type(e).__name__}: {str(e)[:700]}"]
        failed += bool(bad)
        print(f"{'ok  ' if not bad else 'FAIL'} {name} {time.time() - start:.1f}s", flush=True)
        for line in bad:
            print("    ", line, flush=True)
    print("failed:", failed)
