"""Compare a query with its SQL on the small driver tables."""

import glob
import os

DATA = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def differs(spark, query, sql) -> str:
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = query(spark, DATA)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {names} and {df.columns}"
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall()), key=str)
    return "" if a == b else f"{len(a)} and {len(b)} rows; first of each: {a[:1]} {b[:1]}"
