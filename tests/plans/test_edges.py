"""Queries against their SQL on orders that the given tables don't have."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import duckdb
import pytest

from tidemark.plans import load

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def both(spark, tmp_path, name: str, rows: list[tuple[str, float, int]]) -> tuple[list[dict], list[dict]]:
    """The rows that the query and its SQL give for orders (status, price, day)."""
    orders = [(n, 0, status, price, datetime(2000, 1, 1) + timedelta(day), "5-LOW") for n, (status, price, day) in enumerate(rows)]
    spark.createDataFrame(orders, ORDERS).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    registry = load()
    got = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    listed = ", ".join(f'"{c}"' for c in got.columns)
    want = con.sql(f"SELECT {listed} FROM ({registry.SQL[name]})").fetchall()
    plain = lambda row: {c: "nan" if isinstance(v, float) and math.isnan(v) else v for c, v in zip(got.columns, row, strict=True)}
    return [plain(r) for r in got.collect()], [plain(r) for r in want]


@pytest.mark.parametrize("price", [79999.0, 80000.0, 80001.0, 299999.0, 300000.0, 300000.3, 300001.0])
def test_a_band_includes_its_ends(spark, tmp_path, price):
    got, want = both(spark, tmp_path, "z13_z14_banded_series", [("O", price, 1)])
    assert got == want == [{"name": "rate0", "kept": int(80000 <= round(price) <= 300000), "rejected": int(not 80000 <= round(price) <= 300000)}]


@pytest.mark.parametrize(
    ("rows", "undefined"),
    [
        ([("F", 200.0, 0), ("F", 300.0, 1), ("F", 100.0, 2)], {"sortino": math.inf, "calmar": math.inf}),
        ([("F", 200.0, 0), ("F", 0.0, 1), ("F", 0.0, 2)], {"sharpe": "nan", "sortino": "nan", "calmar": "nan"}),
        ([("F", 10000000.0, 0), ("F", 20000000.0, 1), ("F", 40000000.0, 2)], {"sortino": math.inf, "calmar": math.inf}),
        ([("O", 200.0, 0), ("O", 300.0, 1), ("F", 100.0, 2)], {}),
        ([("F", 200.0, 0), ("O", 300.0, 1)], {}),
        ([("F", 200.0, 0), ("F", 300.0, 1)], {"sortino": math.inf, "calmar": math.inf}),
        ([("F", 200.0, 0)], {"calmar": "nan"}),
        ([("F", 200.0, 0), ("O", 1000000200.0, 9)], {"cagr": -1.0, "calmar": -1.0}),
        ([("F", 200.0, 0), ("O", 2000000000.0, 9)], {"cagr": "nan", "calmar": "nan"}),
        ([], {}),
    ],
)
def test_ratios_without_a_divisor_are_those_of_the_sql(spark, tmp_path, rows, undefined):
    got, want = both(spark, tmp_path, "g5_metric_record", rows)
    assert got == want and {c: got[0][c] for c in undefined} == undefined
