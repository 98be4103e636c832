"""Every registered query against its SQL on the smallest tables, where they are at hand."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import load

DATA = Path("/root/testdata/sf0.001")
REGISTRY = load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if hasattr(value, "isoformat"):
        return str(value)[:19]
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.skipif(not DATA.exists(), reason="the given tables aren't here")
@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = REGISTRY.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in REGISTRY.SQL:
        listed = ", ".join(f'"{c}"' for c in columns)
        want = duck.sql(f"SELECT {listed} FROM ({REGISTRY.SQL[name]})").fetchall()
        assert got == sorted((tuple(plain(v) for v in r) for r in want), key=str)
