"""Compares registered queries with their SQL in DuckDB, as the driver does."""

from __future__ import annotations

import os

#: The smallest tables.
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def same(got, want) -> bool:
    """Equal rows up to order and columns' order; floats to 1e-9 relative."""
    names = sorted(got[0])
    if names != sorted(want[0]) or len(got[1]) != len(want[1]):
        return False

    def ordered(side):
        at = [side[0].index(n) for n in names]
        return sorted((tuple(r[i] for i in at) for r in side[1]), key=lambda r: tuple((v is None, str(v) if not isinstance(v, float) else f"{v:.6g}") for v in r))

    for a, b in zip(ordered(got), ordered(want)):
        for x, y in zip(a, b):
            if x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 1e-9 * max(1, abs(x))):
                continue
            return False
    return True


def compare(spark, name: str, sf_dir: str, queries: dict, oracles: dict, con=None) -> tuple[bool, tuple, tuple]:
    df = queries[name](spark, sf_dir)
    got = (df.columns, [tuple(r) for r in df.collect()])
    rel = (con or duck(sf_dir)).sql(oracles[name])
    want = (list(rel.columns), rel.fetchall())
    return same(got, want), got, want
