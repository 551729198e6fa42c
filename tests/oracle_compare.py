"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm_row(row):
    out = []
    for v in row:
        if isinstance(v, float):
            out.append(None if v is None else ("nan" if math.isnan(v) else round(v, 6)))
        elif v is None:
            out.append(None)
        else:
            out.append(v)
    return tuple(out)


def compare(spark_rows, duck_rows, tol=2e-6):
    if len(spark_rows) != len(duck_rows):
        return False, f"rows {len(spark_rows)} vs {len(duck_rows)}"
    key = lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, float) else round(x, 4)) for x in r)
    a = sorted((norm_row(r) for r in spark_rows), key=key)
    b = sorted((norm_row(r) for r in duck_rows), key=key)
    exact = sum(1 for x, y in zip(a, b) if x == y)
    bad = 0
    first = None
    for x, y in zip(a, b):
        if x == y:
            continue
        ok = len(x) == len(y) and all(
            (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= tol) or p == q for p, q in zip(x, y))
        if not ok:
            bad += 1
            first = first or (x, y)
    if bad:
        return False, f"{bad} rows differ; first {first}"
    return True, f"exact {exact}/{len(a)}"


def main():
    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    import __spark_entry__ as E
    from nearmark.session import local_session
    spark = local_session()
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    for name, f in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = f(spark, sf_dir)
            cols = sorted(df.columns)
            srows = [tuple(r[c] for c in cols) for r in df.collect()]
            ts = time.time() - t
            if name not in sql:
                print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s", flush=True)
                continue
            res = con.execute(sql[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
            if sorted(dcols) != cols:
                print(f"FAIL {name}: columns {cols} vs {sorted(dcols)}", flush=True)
                continue
            idx = [dcols.index(c) for c in cols]
            drows = [tuple(r[i] for i in idx) for r in drows]
            ok, msg = compare(srows, drows)
            stypes = {fld.name: fld.dataType.simpleString() for fld in df.schema.fields}
            dtypes = {d[0]: str(d[1]) for d in res.description}
            print(f"{'PASS' if ok else 'FAIL'} {name}: {msg} spark={ts:.1f}s types={[(c, stypes[c], dtypes[c]) for c in cols]}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:800]}", flush=True)


if __name__ == "__main__":
    main()
