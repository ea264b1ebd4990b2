"""Run registered queries on Spark and their SQL twins on DuckDB, compare
row count, column names and an order-insensitive value fingerprint.

CLI: python tests/oracle_harness.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime as _dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, _dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def fingerprint(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    recs = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return cols, recs


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sc, sr = fingerprint(scols, srows)
    dc, dr = fingerprint(dcols, drows)
    ok = sc == dc and sr == dr
    info = {"name": name, "ok": ok, "spark_rows": len(sr), "duck_rows": len(dr), "sec": round(t1 - t0, 2)}
    if not ok:
        info["spark_cols"] = sc
        info["duck_cols"] = dc
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        info["only_spark"] = diff_s
        info["only_duck"] = diff_d
    return info


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    from custlens.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if pats and not any(p in name for p in pats):
            continue
        if name not in orc:
            t0 = time.time()
            try:
                n = qs[name](spark, sf_dir).count()
                print({"name": name, "rows_only": n, "sec": round(time.time() - t0, 2)}, flush=True)
            except Exception as e:  # noqa: BLE001
                bad += 1
                print({"name": name, "error": repr(e)[:800]}, flush=True)
            continue
        try:
            info = compare(spark, con, name, qs[name], orc[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            info = {"name": name, "ok": False, "error": repr(e)[:1500]}
        bad += 0 if info.get("ok") else 1
        print(info, flush=True)
    print("FAILED", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
