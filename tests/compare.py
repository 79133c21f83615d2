"""Side-by-side check of registered queries against DuckDB. Used by the tests; also runnable:

    python -m tests.compare [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return v


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, query, sf_dir: str) -> dict:
    t0 = time.time()
    df = query.run(spark, sf_dir)
    rows = df.collect()
    t1 = time.time()
    out = {"name": query.name, "rows": len(rows), "spark_sec": round(t1 - t0, 2), "problems": []}
    if query.sql is None:
        return out
    rel = con.sql(query.sql)
    theirs = rel.fetchall()
    out["sql_sec"] = round(time.time() - t1, 2)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        out["problems"].append(f"columns {names} vs {sorted(rel.columns)}")
        return out
    spark_types = dict(df.dtypes)
    duck_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    for c in names:
        want = SPARK_TYPES.get(spark_types[c], spark_types[c])
        if want != duck_types[c]:
            out["problems"].append(f"type of {c}: {want} vs {duck_types[c]}")
    pos = {c: i for i, c in enumerate(rel.columns)}
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in rows), key=key)
    other = sorted((tuple(plain(r[pos[c]]) for c in names) for r in theirs), key=key)
    if len(mine) != len(other):
        out["problems"].append(f"row count {len(mine)} vs {len(other)}")
    if mine != other:
        diff = [(a, b) for a, b in zip(mine, other) if a != b]
        only = list(set(mine) - set(other))[:2], list(set(other) - set(mine))[:2]
        out["problems"].append(f"{len(diff)} value differences, columns {names}: only spark {only[0]} only sql {only[1]}")
    return out


def main() -> int:
    from auditloom.plans.registry import catalog
    from auditloom.session import local_session
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    spark = local_session("8")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = total = with_sql = 0
    for name, q in catalog().items.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        total += 1
        with_sql += q.sql is not None
        try:
            r = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and go on
            r = {"name": name, "rows": -1, "spark_sec": 0, "problems": [f"{type(e).__name__}: {str(e)[:900]}"]}
        flag = "ok " if not r["problems"] else "BAD"
        note = "" if q.sql else " (rows only)"
        if r["rows"] == 0:
            note += " EMPTY"
        print(f"{flag} {name}: rows={r['rows']} spark={r['spark_sec']}s sql={r.get('sql_sec', '-')}s{note}", flush=True)
        for p in r["problems"]:
            bad += 1
            print("    ", p[:1500], flush=True)
    print(f"{total} queries, {with_sql} with SQL, {bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
