"""As-of joins against brute force, with ties, nulls and empty sides; no row may see the future."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from tidemark.operators import prices, temporal

DAY = date(2021, 1, 1)
LEFT, RIGHT = "id int, k string, on date, v string", "k string, at date, v int"


def rows(seed: int, count: int):
    chance = random.Random(seed)
    left = [(i, chance.choice(["a", "b", "c", None]), DAY + timedelta(chance.randrange(40)), "clash") for i in range(count)]
    right = [(chance.choice(["a", "b", "d"]), chance.choice([None, *[DAY + timedelta(chance.randrange(40))] * 6]), chance.randrange(100)) for _ in range(count)]
    return left, right


@pytest.mark.parametrize("bucket", [None, 7])
@pytest.mark.parametrize(("strict", "forward"), [(False, False), (True, False), (False, True), (True, True)])
def test_asof_equals_brute_force(spark, strict, forward, bucket):
    left, right = rows(int(strict) + 2 * forward, 60)
    got = temporal.asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "on", "at", {"at": "found_at", "v": "found"}, strict=strict, forward=forward, tolerance_days=9, bucket_days=bucket)
    want = []
    for i, k, on, _ in left:
        near = [(at, v) for rk, at, v in right if rk == k and k is not None and at is not None and ((at > on if strict else at >= on) if forward else (at < on if strict else at <= on))]
        best = (min(a for a, _ in near) if forward else max(a for a, _ in near)) if near else None
        hit = (best, max(v for a, v in near if a == best)) if near and abs((best - on).days) <= 9 else (None, None)
        want.append((i, k, on, *hit))
    assert sorted(((r.id, r.k, r.on, r.found_at, r.found) for r in got.collect()), key=str) == sorted(want, key=str)


def test_asof_with_empty_sides(spark):
    left, right = spark.createDataFrame([(1, "a", DAY, "x")], LEFT), spark.createDataFrame([], RIGHT)
    assert [r.found for r in temporal.asof_join(left, right, ["k"], "on", "at", {"v": "found"}).collect()] == [None]
    assert temporal.asof_join(left.limit(0), right, ["k"], "on", "at", {"v": "found"}).collect() == []


def test_later_knowledge_changes_nothing_earlier(spark):
    """Factors of a day are the same whether or not what follows is in the data, up to events after it."""
    bars = spark.createDataFrame([("s", DAY + timedelta(k), 100.0 if k < 20 else 50.0) for k in range(40)], "security_id string, trade_date date, close double")
    split = spark.createDataFrame([("s", "split", DAY + timedelta(20), None, 2, 1)], "security_id string, action_type string, ex_date date, amount double, new_shares int, old_shares int")
    early = prices.adjusted(bars.where(bars.trade_date < DAY + timedelta(20)), split)
    assert {r.split_factor for r in early.collect()} == {1.0}
    whole = prices.adjusted(bars, split).orderBy("trade_date").collect()
    assert [r.split_adjusted for r in whole] == [50.0] * 40


def test_first_overlap_and_alignment(spark):
    spans = spark.createDataFrame([("a", date(2020, 1, 1), date(2020, 6, 1)), ("a", date(2020, 6, 1), None), ("a", date(2020, 7, 1), None), ("b", date(2020, 1, 1), None)], "g string, valid_from date, valid_to date")
    assert [(r.g, r.valid_from) for r in temporal.first_overlap(spans, ["g"]).collect()] == [("a", date(2020, 7, 1))]
    a, b = (spark.createDataFrame([(DAY + timedelta(k), k) for k in r], f"date date, {n} int") for n, r in (("x", range(3)), ("y", range(1, 4))))
    both, lost = temporal.align(a, b)
    assert both.count() == 2 and sorted((r.date, r.side) for r in lost.collect()) == [(DAY, "left"), (DAY + timedelta(3), "right")]
