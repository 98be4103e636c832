"""Backtests from targets to the ledger, through the plans of days."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from tests.operators.test_ledger import ACTIONS, DAYS, EXPECTED, LAST, PATHS, REBALANCES, RULES, price
from tidemark.operators import strategy
from tidemark.operators.prices import adjustment_factors, event_factors

ACTION = "action_id bigint, security_id string, action_type string, ex_date date, available_on date, amount double, new_shares int, old_shares int, reason string, special boolean"


def test_the_hand_derived_market_through_the_plans(spark):
    bars = spark.createDataFrame([(s, d, float(price(s, d)[1]), 1000) for s in PATHS for d in DAYS if d <= LAST.get(s, d)], "security_id string, trade_date date, close double, volume bigint")
    rows = [(k, a["security_id"], a["action_type"], a["ex_date"], a["ex_date"], a["amount"], a["new_shares"], a["old_shares"], None, False) for k, a in enumerate(ACTIONS)]
    rows.append((9, "s5", "delisting", date(2021, 3, 15), date(2021, 3, 15), None, None, None, "failure", None))
    chosen = [["s1", "s2"], ["s1", "s2"], ["s2", "s5"], ["s2", "s3"]]
    targets = [("a", on, DAYS[DAYS.index(on) - 1], s, 0.5) for on, names in zip(REBALANCES, chosen, strict=True) for s in names]
    sessions = spark.createDataFrame([(d,) for d in DAYS], "session date")
    events = strategy.backtest(spark.createDataFrame(targets, "run_id string, on date, clock date, security_id string, weight double"), bars, spark.createDataFrame(rows, ACTION), sessions, RULES)
    got = [r for r in events.orderBy("turn").collect() if r.kind != "deposit"]
    assert [(r.on.isoformat(), r.kind, r.security_id, r.quantity_delta, Decimal(r.costs)) for r in got] == [(*x[:4], Decimal(x[4])) for x in EXPECTED]


def test_every_kind_of_action_by_hand(spark):
    """100 shares of each at 10: a special dividend, a merger for 12, an acquisition at the mark, a series that stops."""
    days = [d for k in range(60) if (d := date(2021, 1, 4) + timedelta(k)).weekday() < 5]
    ends = {"stale": days[4]}
    bars = spark.createDataFrame([(s, d, 10.0, 1000) for s in ("paid", "merged", "bought", "stale") for d in days if d <= ends.get(s, d)], "security_id string, trade_date date, close double, volume bigint")
    rows = [
        (1, "paid", "dividend", days[5], days[5], 0.5, None, None, None, True), (2, "merged", "merger", days[6], days[8], 12.0, None, None, None, None),
        (3, "bought", "delisting", days[9], days[9], None, None, None, "acquired", None), (4, "paid", "merger", days[10], days[10], None, None, None, None, None),
    ]
    targets = [("a", days[1], days[0], s, 0.25) for s in ("paid", "merged", "bought", "stale")]
    rules = type(RULES)(cash=Decimal(4000), commission_bps=Decimal(0), commission_min=Decimal(0), spread_bps=Decimal(0), stamp_bps=Decimal(0), impact_bps=Decimal(0))
    events = strategy.backtest(spark.createDataFrame(targets, "run_id string, on date, clock date, security_id string, weight double"), bars, spark.createDataFrame(rows, ACTION), spark.createDataFrame([(d,) for d in days], "session date"), rules)
    got = [(r.on, r.kind, r.security_id, r.quantity_delta, int(r.cash_delta), r.note) for r in events.orderBy("turn").collect() if r.kind not in ("deposit", "buy")]
    late = next(d for d in days if (d - ends["stale"]).days > 15)
    assert got == [
        (days[5], "dividend", "paid", 0, 50, "special"), (days[8], "delisting_proceeds", "merged", -100, 1200, "cash terms of a merger"),
        (days[9], "delisting_proceeds", "bought", -100, 1000, "ended: acquired"), (late, "delisting_proceeds", "stale", -100, 1000, f"no price since {ends['stale']}"),
    ]


def factors_of(spark, days, rows):
    bars = spark.createDataFrame([("s", date(2021, 1, 1) + timedelta(d), c) for d, c in days], "security_id string, trade_date date, close double")
    actions = spark.createDataFrame([(k, "s", kind, date(2021, 1, 1) + timedelta(d), None, amount, new, old, None, None) for k, (kind, d, amount, new, old) in enumerate(rows)], ACTION)
    return adjustment_factors(bars, actions).orderBy("trade_date").collect(), event_factors(actions, bars).collect()


def test_a_split_needs_no_bar_near_before_it(spark):
    got, _ = factors_of(spark, [(0, 100.0), (18, 50.0)], [("split", 18, None, 2, 1)])
    assert [(r.split_factor, r.incomplete) for r in got] == [(0.5, False), (1.0, False)]


def test_dividends_of_a_day_each_give_a_factor(spark):
    got, _ = factors_of(spark, [(0, 100.0), (1, 90.0)], [("dividend", 1, 10.0, None, None), ("dividend", 1, 5.0, None, None)])
    assert [round(r.dividend_factor, 12) for r in got] == [0.855, 1.0]


def test_a_dividend_after_a_gap_is_marked(spark):
    got, events = factors_of(spark, [(0, 100.0), (18, 50.0)], [("dividend", 18, 10.0, None, None)])
    assert [(r.dividend_factor, r.incomplete) for r in got] == [(1.0, True), (1.0, False)] and events[0].unanchored
