"""A market worked out by hand: five securities, four rebalances, a dividend, a split and a failure."""

from __future__ import annotations

import json
from datetime import date, timedelta
from decimal import Decimal

import pytest

from tidemark.operators import factors, ledger
from tidemark.operators.prices import adjusted

# The price paths, actions and the ledger that follows from them by hand.
PATHS = {
    "s1": [(date(2020, 9, 1), 100), (date(2020, 11, 16), 140)], "s2": [(date(2020, 9, 1), 100), (date(2020, 11, 16), 104), (date(2021, 1, 15), 150), (date(2021, 3, 15), 75)],
    "s3": [(date(2020, 9, 1), 100), (date(2020, 11, 16), 103), (date(2021, 2, 12), 130)], "s4": [(date(2020, 9, 1), 200), (date(2020, 11, 16), 204)],
    "s5": [(date(2020, 9, 1), 100), (date(2020, 11, 16), 101), (date(2021, 2, 12), 160)],
}
LAST = {"s5": date(2021, 3, 12)}
#: The exchange's holidays in this span.
HOLIDAYS = {date(2020, 12, 25), date(2020, 12, 28), date(2021, 1, 1), date(2021, 4, 2), date(2021, 4, 5)}
DAYS = [d for k in range(242) if (d := date(2020, 9, 1) + timedelta(k)).weekday() < 5 and d not in HOLIDAYS]
ACTIONS = [
    {"security_id": "s1", "action_type": "dividend", "ex_date": date(2021, 2, 15), "amount": 7.0, "new_shares": None, "old_shares": None},
    {"security_id": "s2", "action_type": "split", "ex_date": date(2021, 3, 15), "amount": None, "new_shares": 2, "old_shares": 1},
]
REBALANCES = [date(2021, 1, 4), date(2021, 2, 1), date(2021, 3, 1), date(2021, 4, 1)]
RULES = ledger.Rules(cash=Decimal(1_000_000), commission_bps=Decimal(10), commission_min=Decimal(0), spread_bps=Decimal(0), stamp_bps=Decimal(0), impact_bps=Decimal(0))
EXPECTED = [
    ("2021-01-04", "buy", "s1", 3571, "499.94"), ("2021-01-04", "buy", "s2", 4798, "498.992"), ("2021-02-01", "sell", "s2", -733, "109.95"), ("2021-02-01", "buy", "s1", 784, "109.76"),
    ("2021-02-15", "dividend", "s1", 0, "0"), ("2021-03-01", "sell", "s1", -4355, "609.7"), ("2021-03-01", "buy", "s2", 101, "15.15"), ("2021-03-01", "buy", "s5", 3898, "623.68"),
    ("2021-03-15", "split", "s2", 4166, "0"), ("2021-03-15", "delisting_proceeds", "s5", -3898, "0"), ("2021-04-01", "sell", "s2", -4166, "312.45"), ("2021-04-01", "buy", "s3", 2399, "311.87"),
]


def price(security: str, day: date) -> tuple[date, int] | None:
    days = [d for d in DAYS if d <= min(day, LAST.get(security, day))]
    return (days[-1], [p for d, p in PATHS[security] if d <= days[-1]][-1]) if days else None


@pytest.fixture(scope="module")
def events(spark):
    bars = spark.createDataFrame([(s, d, float(price(s, d)[1])) for s in PATHS for d in DAYS if d <= LAST.get(s, d)], "security_id string, trade_date date, close double")
    actions = spark.createDataFrame([(a["security_id"], a["action_type"], a["ex_date"], a["amount"], a["new_shares"], a["old_shares"]) for a in ACTIONS], "security_id string, action_type string, ex_date date, amount double, new_shares int, old_shares int")
    proceeds = spark.createDataFrame([("s5", date(2021, 3, 15), 0.0)], "security_id string, event_date date, proceeds double")
    chosen: dict[date, list[str]] = {}
    for day in REBALANCES:
        # decided on the session before, with what was known then
        clock = DAYS[DAYS.index(day) - 1]
        seen, known = bars.where(bars.trade_date <= clock), actions.where(actions.ex_date <= clock)
        ends = spark.createDataFrame([(s, clock) for s in PATHS], "security_id string, end date")
        scores = factors.window_return(ends, adjusted(seen, known), 3, 0, proceeds if clock >= date(2021, 3, 15) else None, "adjusted").where("status = 'ok'")
        top = factors.select_top(scores.withColumnRenamed("value", "score"), "top_n", n=2)
        chosen[day] = sorted(r.security_id for r in top.collect())
    assert list(chosen.values()) == [["s1", "s2"], ["s1", "s2"], ["s2", "s5"], ["s2", "s3"]]
    rows = []
    for day in [d for d in DAYS if d >= date(2021, 1, 4)]:
        marks = {s: (p[0].isoformat(), str(p[1])) for s in PATHS if (p := price(s, day))}
        acts = [{"security_id": a["security_id"], "effect": {"split": "ratio", "dividend": "cash"}[a["action_type"]], "amount": a["amount"], "new_shares": a["new_shares"], "old_shares": a["old_shares"], "note": "ordinary"} for a in ACTIONS if a["ex_date"] == day]
        acts += [{"security_id": "s5", "effect": "exit", "amount": 0, "at_mark": False, "note": "ended: failure"}] * (day == date(2021, 3, 15))
        clock = DAYS[DAYS.index(day) - 1]
        plan = {"marks": marks, "effects": acts, "prints": {s: (p, None) for s, (d, p) in marks.items() if d == day.isoformat()}}
        if day in chosen:
            plan |= {"targets": dict.fromkeys(chosen[day], 0.5), "sizes": {s: str(price(s, clock)[1]) for s in chosen[day]}}
        rows += [(run, day, json.dumps(plan)) for run in ("a", "b")]
    return ledger.simulate(spark.createDataFrame(rows, "run_id string, on date, payload string"), RULES).cache()


def test_ledger_equals_the_hand_derived_one(events):
    for run in ("a", "b"):
        rows = [r for r in events.where(events.run_id == run).orderBy("turn").collect() if r.kind != "deposit"]
        assert [(r.on.isoformat(), r.kind, r.security_id, r.quantity_delta, Decimal(r.costs)) for r in rows] == [(*x[:4], Decimal(x[4])) for x in EXPECTED]
        assert sum(r.costs for r in rows) == Decimal("3091.492")


def test_replay_is_an_independent_witness(events):
    cash, held = ledger.replayed(events)
    assert {r.run_id: r.cash for r in cash.collect()} == {"a": Decimal("101.508"), "b": Decimal("101.508")}
    quantities = {r.security_id: r.quantity for r in held.where("run_id = 'a'").collect()}
    assert quantities == {"s2": 4166, "s3": 2399}
    assert Decimal("101.508") + 4166 * 75 + 2399 * 130 == Decimal("624421.508")
    last = ledger.holdings_history(events).where("run_id = 'a' AND security_id = 's5'").orderBy("on").collect()
    assert [r.quantity for r in last] == [3898, 0]


def test_book_refuses_debts_and_pays_fractions():
    book = ledger.Book(RULES, date(2021, 1, 4))
    with pytest.raises(ValueError, match="leaves"):
        book.add(date(2021, 1, 4), "buy", "s", 1, Decimal(-2_000_000))
    book.add(date(2021, 1, 4), "buy", "s", 7, Decimal(-70))
    book.split(date(2021, 1, 5), "s", 1, 2, Decimal(20))
    assert book.held["s"] == 3 and book.events[-1][1:5] == ("cash_in_lieu", "s", 0, Decimal(10))
