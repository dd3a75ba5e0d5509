"""Local twin of the driver's correctness gate: Spark query vs DuckDB oracle.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
Compares row count, column names, coarse types and order-insensitive values.
"""
from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from riskframe.plans.registry import load_all, oracle_text, run  # noqa: E402
from riskframe.session import get_spark  # noqa: E402
from riskframe.sources.tables import BASE_TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _coarse(t: str) -> str:
    t = t.lower()
    if t in ("int", "integer", "int32", "smallint", "short", "tinyint", "byte", "int16", "int8"):
        return "int"
    if t in ("bigint", "long", "int64"):
        return "bigint"
    if t.startswith("decimal") or t in ("hugeint", "number"):
        return "decimal"
    if t in ("double", "float", "float64", "real", "float32"):
        return "double"
    if t in ("string", "varchar", "str"):
        return "string"
    if t in ("boolean", "bool"):
        return "boolean"
    return t


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(name, sdf, con, sql):
    s_cols = sdf.columns
    s_rows = [tuple(_norm(v) for v in r) for r in sdf.collect()]
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = [tuple(_norm(v) for v in r) for r in rel.fetchall()]
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
        return problems, len(s_rows), len(d_rows)
    s_types = {f.name: _coarse(f.dataType.simpleString()) for f in sdf.schema.fields}
    d_types = {d[0]: _coarse(str(d[1])) for d in rel.description}
    tdiff = [f"{c}:{s_types[c]}/{d_types[c]}" for c in s_cols if s_types[c] != d_types[c]]
    if tdiff:
        problems.append("types " + ", ".join(tdiff))
    order = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in order) for r in d_rows]
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    a = sorted(s_rows, key=_key)
    b = sorted(d_rows, key=_key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} differing rows, first: spark={bad[0][0]} duck={bad[0][1]}")
    return problems, len(s_rows), len(d_rows)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    reg = load_all()
    spark = get_spark("local[8]")
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = fail = 0
    for name, q in reg.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = run(name, spark, sf)
            sql = oracle_text(q)
            if sql is None:
                n = sdf.count()
                print(f"[rows-only] {name}: {n} rows ({time.time()-t0:.1f}s)")
                ok += 1
                continue
            problems, ns, nd = compare(name, sdf, con, sql)
        except Exception as e:  # noqa: BLE001
            problems, ns, nd = [f"ERROR {type(e).__name__}: {str(e)[:600]}"], -1, -1
        if problems:
            fail += 1
            print(f"[FAIL] {name} ({ns} vs {nd}): " + " | ".join(problems))
        else:
            ok += 1
            print(f"[ok] {name}: {ns} rows ({time.time()-t0:.1f}s)")
    print(f"ok={ok} fail={fail}")


if __name__ == "__main__":
    main()
