"""Runs a query and its SQL side by side, as the driver does."""

from __future__ import annotations

import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """What differs; empty if nothing does."""
    df = query(spark, sf_dir)
    names, rows = duck(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    ours = Counter(tuple(norm(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(norm(r[names.index(c)]) for c in order) for r in rows)
    if ours == theirs:
        return ""
    return f"{order}: {sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]}"


def small() -> str:
    return os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
