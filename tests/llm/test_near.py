from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import near

FIELDS = "doc_id bigint, text string, n bigint, node binary, ref bigint"


def expected(rows: list[tuple]) -> dict[tuple, int]:
    """Brute force over all pairs: (doc_id, n, component_id) and how often."""
    sets = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    part = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            one, two = part[a], part[b]
            part = [one if p == two else p for p in part]
    found: dict[tuple, int] = {}
    for k, (doc_id, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[k] and rows[j][0] is not None]
        key = (doc_id, len(sets[k]), (min(ids) if ids else None) if sets[k] else doc_id)
        found[key] = found.get(key, 0) + 1
    return found


def variants(seed: int) -> list[tuple]:
    """Groups around common texts, with shared passages, edits at and around the limit, and edge cases."""
    chance = random.Random(seed)
    word = lambda: f"w{chance.randrange(3000)}"
    passages, texts = [[word() for _ in range(40)] for _ in range(3)], []
    for _ in range(6):
        base = [word() for _ in range(chance.choice([4, 8, 12, 30, 80]))] + chance.choice(passages)
        for _ in range(chance.choice([1, 3, 14])):
            own = list(base)
            for _ in range(chance.randrange(4)):
                own[chance.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += [None, "", "  \n", "One", "one", "a b c d", "A B C D", "a b c d e", "a b c d e f g h", "a b c d e f g h i", "é É é é é", texts[0], texts[0].upper()]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[1], None, None, None), (None, "all alone here now then", None, None, None)]


@pytest.mark.parametrize(("seed", "frequent", "part"), [(1, 64, 4096), (2, 4, 4096), (3, 3, 4)])
def test_components_equal_brute_force(spark, monkeypatch, seed, frequent, part):
    monkeypatch.setattr(near, "FREQUENT", frequent)
    monkeypatch.setattr(near, "VERY_FREQUENT", 2 * frequent)
    monkeypatch.setattr(near, "LIST_PART", part)
    rows = variants(seed)
    found: dict[tuple, int] = {}
    for row in near.near_duplicates(spark.createDataFrame(rows, FIELDS)).collect():
        found[tuple(row)] = found.get(tuple(row), 0) + 1
    assert found == expected(rows)


def test_empty_table(spark):
    assert near.near_duplicates(spark.createDataFrame([], FIELDS)).collect() == []


def test_linking_sets_share_an_entry():
    """Signatures of sets at the limit meet whatever the classes of their tokens are."""
    chance = np.random.default_rng(5)
    for _ in range(400):
        n = int(chance.integers(4, 90))
        a = np.unique(chance.integers(0, 1 << 60, n).astype(np.uint64))
        drop = int(chance.integers(0, len(a) // 5 + 1))
        b = np.sort(chance.permutation(a)[: len(a) - drop])
        if not near.links(a, b) or not len(b) >= 4:
            continue
        kinds = {int(t): int(chance.integers(1, 4)) for t in a}
        of = lambda s: np.array([kinds[int(t)] if t in b else 0 for t in s], np.int8)  # noqa: B023, E731
        assert near.signatures(a, of(a)) & near.signatures(b, of(b))


def test_bitmaps_never_exceed_the_difference():
    chance = np.random.default_rng(6)
    for n in (5, 300, 2000):
        a = np.unique(chance.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], chance.integers(0, 1 << 62, n // 7).astype(np.uint64)]))
        one, two = (np.frombuffer(near.parity(x), np.uint8) for x in (a, b))
        size = min(len(one), len(two))
        fold = lambda x: np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)  # noqa: B023, E731
        assert int(np.bitwise_count(fold(one) ^ fold(two)).sum()) <= len(np.setxor1d(a, b))


def test_one_of_each_keeps_the_smallest(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(3, text, None, None, None), (1, text + " x", None, None, None), (2, "other words stand here alone", None, None, None), (None, text, None, None, None), (2, "other words stand here alone", None, None, None)]
    assert sorted(r.doc_id for r in near.one_of_each(spark.createDataFrame(rows, FIELDS)).collect()) == [1, 2]


def test_one_of_each_takes_rows_that_repeat_an_id_by_their_texts(spark):
    text, own, lost = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(1, text, "x", None, 1), (7, text + " end", "x", None, 2), (7, own, "x", None, 3), (None, lost, "x", None, 4), (None, lost + " end", "x", None, 5)]
    rows += [(8, None, "x", None, 6), (8, None, None, "x", 6), (None, "", None, None, 7), (None, None, None, None, 7), (None, None, None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, `row_key` string, `a.b` int").withColumn("m", F.create_map(F.lit("k"), "lang"))
    got = [tuple(r)[:2] for r in near.one_of_each(docs).collect()]
    assert len(got) == 7 and got.count((8, None)) == 2 and got.count((None, None)) == 1 and (None, "") in got
    assert {(1, text), (7, own)} <= set(got) and sum(t in (lost, lost + " end") for _, t in got) == 1
