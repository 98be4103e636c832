from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import console, payloads, stores

AT = datetime(2021, 1, 1)


def bar(security: str, day: date, close: float, source: str = "test", at: datetime = AT) -> tuple:
    return (security, day, close, close, close, close, 1000, "GBX", source, at, None)


def bars(spark, rows):
    return spark.createDataFrame(rows, "security_id string, trade_date date, open double, high double, low double, close double, volume bigint, currency string, source string, ingested_at timestamp, provider_adjusted_close double")


def test_prices_are_appended_once_and_pruned(spark, tmp_path):
    root = str(tmp_path / "prices")
    first = [bar("a", date(2020, 12, 31), 1.0), bar("a", date(2021, 1, 4), 2.0), bar("b", date(2021, 1, 4), 3.0)]
    assert stores.write_prices(bars(spark, first), root) == 3
    assert stores.write_prices(bars(spark, first), root) == 0
    twice = [bar("a", date(2021, 1, 4), 9.0), bar("a", date(2021, 1, 5), 4.0), bar("a", date(2021, 1, 5), 5.0), bar("a", date(2021, 1, 5), 6.0, "other", datetime(2022, 1, 1))]
    assert stores.write_prices(bars(spark, twice), root) == 2
    seen = stores.read_prices(spark, root, securities=["a"], start=date(2021, 1, 1), end=date(2021, 1, 5), known=datetime(2021, 6, 1))
    assert sorted((r.trade_date, float(r.close)) for r in seen.collect()) == [(date(2021, 1, 4), 2.0), (date(2021, 1, 5), 4.0)]
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trade_year" in plan and "PushedFilters: [" in plan
    assert {r.trade_year: (r.rows, r.small) for r in stores.partition_counts(spark, root, "trade_year").collect()} == {2020: (1, True), 2021: (4, True)}
    assert stores.dataset_version(spark, root) > "2020"


def test_missing_columns_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns"):
        stores.write_prices(spark.createDataFrame([("a",)], "security_id string"), str(tmp_path / "x"))


def test_universe_is_checked_before_it_is_replaced(spark, tmp_path):
    root, known = str(tmp_path / "universe"), spark.createDataFrame([("a",), ("b",)], "security_id string")
    rows = lambda *r: spark.createDataFrame([(u, s, f, t, AT, None, "test") for u, s, f, t in r], stores.MEMBERSHIP)
    stores.write_universe(rows(("u", "a", date(2020, 1, 1), None), ("v", "b", date(2020, 1, 1), None)), root, ["u", "v"], known)
    stores.write_universe(rows(("u", "b", date(2021, 1, 1), None)), root, ["u", "v"], known)
    assert sorted((r.universe, r.security_id) for r in stores.read_universe(spark, root).collect()) == [("u", "b"), ("v", "b")]
    with pytest.raises(ValueError, match="registered"):
        stores.write_universe(rows(("w", "a", date(2020, 1, 1), None)), root, ["u"], known)
    with pytest.raises(ValueError, match="overlap"):
        stores.write_universe(rows(("u", "a", date(2020, 1, 1), date(2020, 3, 1)), ("u", "a", date(2020, 2, 1), None)), root, ["u"], known)
    with pytest.raises(ValueError, match="no such security"):
        stores.write_universe(rows(("u", "z", date(2020, 1, 1), None)), root, ["u"], known)


def test_derived_data_is_never_overwritten(spark, tmp_path):
    frame = spark.createDataFrame([("a", "ok", 1.0, "mom", 1, date(2021, 1, 1))], "security_id string, status string, value double, factor string, factor_version int, end date")
    stores.write_factor_values(frame, str(tmp_path))
    with pytest.raises(Exception, match="already exists"):
        stores.write_factor_values(frame, str(tmp_path))
    with pytest.raises(ValueError, match="exactly one"):
        stores.write_factor_values(frame.unionByName(frame.withColumn("factor", F.lit("other"))), str(tmp_path))


def test_master_actions_and_runs(spark, tmp_path):
    empty = {n: spark.createDataFrame([], f) for n, f in stores.MASTER.items()}
    stores.write_master({**empty, "entities": spark.createDataFrame([("e", "n", None)], stores.MASTER["entities"])}, str(tmp_path / "m"))
    assert stores.read_master(spark, str(tmp_path / "m"), views=True)["entities"].count() == 1
    assert spark.sql("SELECT name FROM entities").first()[0] == "n"
    spark.createDataFrame([("a", 2)], "security_id string, new_shares int").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([("a", 1.5)], "security_id string, amount double").write.parquet(str(tmp_path / "d"))
    assert sorted(map(str, stores.load_actions(spark, [str(tmp_path / "s"), str(tmp_path / "d")]).collect())) == ["Row(security_id='a', new_shares=2, amount=None)", "Row(security_id='a', new_shares=None, amount=1.5)"]
    assert stores.optional_table(spark, str(tmp_path / "none"), "a int").count() == 0
    stores.write_run(str(tmp_path / "runs"), "r1", {"cash": 1}, {"daily": spark.createDataFrame([(1,)], "x int")})
    assert console.open_views(spark, {"daily": str(tmp_path / "runs/*/daily"), "absent": str(tmp_path / "nothing")}, {"daily": "run"}) == ["daily"]
    assert spark.sql("SELECT * FROM daily").columns == ["x", "run"]
    assert console.run(spark, "\\d daily").count() == 2


def test_payloads_reject_what_they_cannot_read(spark):
    text = '[{"date":"2021-01-04","open":"1","high":"2","low":"1","close":"1.5","volume":"10"},{"date":"x","open":"1"},{"date":"2021-01-05","open":"3","high":"2","low":"1","close":"1.5","volume":"1"}]'
    good, bad = payloads.bars(spark.createDataFrame([("a", "GBX", text), ("b", "GBX", "not json")], "security_id string, currency string, payload string"))
    assert [(r.security_id, r.volume) for r in good.collect()] == [("a", 10)]
    assert sorted((r.place, r.reason) for r in bad.collect()) == [(1, "missing_field"), (2, "impossible_prices")]
    split = payloads.splits(spark.createDataFrame([("a", '[{"date":"2021-01-04","split":"4.000000/2.000000"},{"date":"2021-02-01","split":"odd"}]')], "security_id string, payload string"))
    assert sorted(map(tuple, split.collect())) == [("a", date(2021, 1, 4), 2, 1), ("a", date(2021, 2, 1), None, None)]


def test_a_null_in_the_key_is_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([("s", date(2020, 1, 2), None, 1), ("s", date(2020, 1, 3), "a", 2)], "security_id string, trade_date date, source string, n int")
    write = lambda: stores.append_once(rows, f"file://{tmp_path}/once", "security_id string, trade_date date, source string, n int", ["security_id", "trade_date", "source"], "year", "trade_date")
    assert (write(), write()) == (2, 0)
