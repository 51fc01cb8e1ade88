"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf] [name prefix ...]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(df, con, sql):
    """None if rows and types agree, else a short text."""
    cols = sorted(df.columns)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    types = {d[0]: str(d[1]) for d in res.description}
    bad = [(n, t, types[n]) for n, t in df.dtypes if KINDS.get(t, t) != types[n]]
    order = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in res.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if bad:
        return f"types {bad}"
    off = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    return f"{len(off)} of {len(got)} rows differ, first: {cols} {off[0]}" if off else None


def main():
    from __spark_entry__ import oracle_sql, queries

    from heatscape.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pick = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("compare", 8)
    con = connection(folder)
    sql = oracle_sql()
    for name, fn in queries().items():
        if pick and not any(name.startswith(p) for p in pick):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            out = difference(df, con, sql[name]) if name in sql else f"rows only: {len(df.collect())}"
        except Exception as e:
            out = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if out is None else 'rows' if out.startswith('rows only') else 'BAD '} {name} "
              f"{time.time() - start:.1f}s {out or ''}", flush=True)


if __name__ == "__main__":
    main()
