"""Local stand-in for the driver's check: Spark query vs DuckDB oracle on the same tables."""

from __future__ import annotations

import datetime
import math
import sys

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return datetime.datetime(v.year, v.month, v.day)
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return str(list(v))
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    sp = sdf.toPandas()
    rel = duck(sf_dir).sql(sql)
    dk = rel.df()
    problems = []
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
    bad_types = {c: (st[c], dt.get(c)) for c in st if c in dt and st[c] != dt[c]}
    if bad_types:
        problems.append(f"types {bad_types}")
    if sorted(sp.columns) != sorted(dk.columns):
        problems.append(f"columns spark={sorted(sp.columns)} duck={sorted(dk.columns)}")
        return problems, sp, dk
    if len(sp) != len(dk):
        problems.append(f"rows spark={len(sp)} duck={len(dk)}")
    a, b = rows(sp), rows(dk)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems, sp, dk


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import time

    import __spark_entry__ as E
    from blockwise.session import get_session

    sf_dir = "/root/testdata/sf0.01"
    want = sys.argv[1:]
    spark = get_session()
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for k in q:
        if want and k not in want:
            continue
        if k not in o:
            t = time.time()
            n = q[k](spark, sf_dir).count()
            print(f"ROWS  {k}: {n} rows ({time.time()-t:.1f}s)")
            continue
        t = time.time()
        try:
            probs, sp, dk = compare(spark, k, q[k], o[k], sf_dir)
        except Exception as e:  # noqa: BLE001
            probs, sp = [f"ERROR {type(e).__name__}: {str(e)[:400]}"], None
        status = "OK   " if not probs else "FAIL "
        bad += bool(probs)
        print(f"{status} {k}: {len(sp) if sp is not None else '-'} rows ({time.time()-t:.1f}s) {'; '.join(probs)}")
    print("failures:", bad)
