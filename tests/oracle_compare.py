"""Run registered queries against their SQL twins in DuckDB.

python tests/oracle_compare.py [sf] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])  # tasks import the package

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = os.environ.get("TESTDATA", "/root/testdata")


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return f"DECIMAL {v}"
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf{sf}/{t}.parquet'")
    return con


def compare(spark, con, name, query, sql, sf):
    """Returns a list of differences (empty when equal)."""
    df = query(spark, f"{DATA}/sf{sf}")
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    if sql is None:
        return [], len(got)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return [f"columns differ: spark {cols} sql {sorted(names)}"], len(got)
    idx = [names.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in idx) for r in cur.fetchall())
    if got == want:
        return [], len(got)
    gs, ws = set(got), set(want)
    return [f"rows spark {len(got)} sql {len(want)}", f"cols {cols}", f"only spark {sorted(gs - ws)[:3]}", f"only sql {sorted(ws - gs)[:3]}"], len(got)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from sightline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(), duck(sf)
    qs, sqls, bad = queries(), oracle_sql(), 0
    for name in wanted or qs:
        t0 = time.time()
        try:
            diff, n = compare(spark, con, name, qs[name], sqls.get(name), sf)
        except Exception as err:  # noqa: BLE001
            diff, n = [f"{type(err).__name__}: {str(err)[:1500]}"], -1
        bad += bool(diff)
        kind = "FAIL" if diff else ("ok" if name in sqls else "rows")
        print(f"{kind:5} {name:32} rows={n} {time.time() - t0:.2f}s", *diff, sep="\n      " if diff else " ", flush=True)
    print(f"{len(wanted or qs)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
