"""Runs queries against their DuckDB counterparts: python -m tests.compare [name...]"""

from __future__ import annotations

import math
import sys

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if hasattr(x, "is_finite"):
        return round(float(x), 9)
    return x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def differ(con, query, sql: str, spark, sf_dir: str) -> str:
    """What differs, or an empty text."""
    got = query(spark, sf_dir)
    mine = rows_of(got.columns, got.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    theirs = rows_of(names, res.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    if mine != theirs:
        bad = next((p for p in zip(mine, theirs, strict=False) if p[0] != p[1]), None)
        return f"{len(mine)} and {len(theirs)} rows, first difference {bad}"
    return "" if mine else "no rows"


if __name__ == "__main__":
    import time

    import __spark_entry__ as entry
    from pulsegrid.session import build_session

    spark = build_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    sf = "/root/testdata/sf0.01"
    con, queries, oracles = duck(sf), entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or [n for n in queries if n in oracles]:
        began = time.time()
        try:
            said = differ(con, queries[name], oracles[name], spark, sf)
        except Exception as error:  # noqa: BLE001
            said = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok ' if not said else 'BAD'} {name} {time.time() - began:.1f}s {said[:700]}", flush=True)
