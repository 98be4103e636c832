from __future__ import annotations

import math
import random

import pytest

from tidemark.llm import topk


def by_force(rows: list[tuple], k: int, every: int) -> list[tuple]:
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in sound if i % every == 0}):
        for x in [v for i, v in sound if i == q][:1]:
            scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in sound if i != q and len(v) == len(x))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize(("candidates", "seeds"), [(8192, 2048), (16, 8)])
def test_equals_brute_force(spark, monkeypatch, candidates, seeds):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "SEEDS", seeds)
    chance = random.Random(3)
    vector = lambda: [chance.gauss(0, 1) * chance.choice([0.1, 1, 3]) for _ in range(32)]
    rows = [(i, vector(), 0) for i in range(160)]
    same = vector()
    rows += [(200 + i, same, 0) for i in range(30)] + [(300, None, 0), (301, [], 0), (320, [None] * 32, 0), (340, [float("nan")] * 32, 0), (None, same, 0), (5, rows[5][1], 0), (400, [0.0] * 32, 0)]
    got = topk.top_products(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")).collect()
    as_float = [(i, None if v is None else [None if x is None else spark_float(x) for x in v], 0) for i, v, _ in rows]
    assert sorted(map(tuple, got)) == sorted(by_force(as_float, 20, 20))


def spark_float(x: float) -> float:
    import numpy as np

    return float(np.float32(x))


def test_few_and_none(spark):
    fields = "vec_id bigint, embedding array<float>"
    assert topk.top_products(spark.createDataFrame([], fields)).collect() == []
    assert topk.top_products(spark.createDataFrame([(0, [1.0])], fields)).collect() == []
    assert [tuple(r) for r in topk.top_products(spark.createDataFrame([(0, [1.0]), (1, [0.5])], fields)).collect()] == [(0, 1, 1, 2048)]
