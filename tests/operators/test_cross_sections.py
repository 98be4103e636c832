from __future__ import annotations

import datetime as dt
import statistics

import pytest

from tidemark.operators import factors, master, sessions, universe

ROWS = [(k, "ok" if k % 4 else "no_data", float(k * k % 37) if k % 4 else None, []) for k in range(40)]
SCHEMA = "security_id long, status string, value double, warnings array<string>"


def test_a_whole_frame_is_one_cross_section(spark):
    """Without `by`, as with a `by` of one value, and as worked out by hand."""
    frame = spark.createDataFrame(ROWS, SCHEMA)
    values = [v for *_, v, _ in ROWS if v is not None]
    mean, deviation = statistics.mean(values), statistics.stdev(values)
    got = {r.security_id: r.value for r in factors.zscore(frame).collect()}
    assert got == {k: v if v is None else pytest.approx((v - mean) / deviation) for k, _, v, _ in ROWS}
    middle = statistics.median(values)
    spread = 1.4826 * statistics.median(abs(v - middle) for v in values)
    got = {r.security_id: r.value for r in factors.zscore_robust(frame).collect()}
    assert got == {k: v if v is None else pytest.approx((v - middle) / spread) for k, _, v, _ in ROWS}
    grouped = frame.selectExpr("*", "1 AS grp")
    one = lambda df: sorted(df.select("security_id", "status", "value", "warnings").collect())
    assert one(factors.winsorise(frame, lower=10, upper=90)) == one(factors.winsorise(grouped, ["grp"], lower=10, upper=90))
    assert factors.zscore(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chains_of_any_length_and_circles(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(70)], "old string, new string")
    assert {r.ticker: r.root for r in master.rename_chains(chain).collect()} == {f"n{k + 1}": "n0" for k in range(70)}
    with pytest.raises(ValueError):
        master.rename_chains(spark.createDataFrame([("a", "b"), ("b", "a")], "old string, new string"))


def test_month_ends_of_spells(spark):
    day = dt.date.fromisoformat
    spells = spark.createDataFrame([("u", 1, day("2024-01-31"), day("2024-03-31")), ("u", 2, day("2024-02-10"), None), ("u", 3, day("2024-02-02"), day("2024-02-20"))], "universe string, security_id int, valid_from date, valid_to date")
    bars = spark.createDataFrame([(1, day("2024-02-05"))], "security_id int, trade_date date")
    got = {r.month_end.isoformat(): (r.expected, r.resolved, r.with_prices) for r in universe.member_months(spells, bars, 1).collect()}
    assert got == {"2024-01-31": (1, 0, 0), "2024-02-29": (2, 1, 1), "2024-03-31": (1, 0, 0)}


def test_gaps_within_listings(spark):
    day = dt.date.fromisoformat
    days = sessions.sessions(spark, day("2024-01-01"), day("2024-01-12"), spark.createDataFrame([(day("2024-01-01"),)], "session date"))
    listings = spark.createDataFrame([(1, day("2023-12-01"), day("2024-01-10")), (2, day("2024-01-08"), None)], "security_id int, valid_from date, valid_to date")
    bars = spark.createDataFrame([(1, day("2024-01-04")), (2, day("2024-01-08")), (2, day("2024-01-12"))], "security_id int, trade_date date")
    got = sorted((r.security_id, str(r.start), str(r.end), r.sessions) for r in sessions.listing_gaps(listings, bars, days).collect())
    assert got == [(1, "2024-01-02", "2024-01-03", 2), (1, "2024-01-05", "2024-01-09", 3), (2, "2024-01-09", "2024-01-11", 3)]
