from __future__ import annotations

import random
import re

import numpy as np

from tidemark.llm import repetition


def longest_by_force(words: list[str]) -> list[int]:
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return out


def test_longest_repeats_equal_brute_force():
    chance = random.Random(1)
    for _ in range(150):
        words = [chance.choice("abcd") for _ in range(chance.randrange(0, 40))]
        ids = np.array([ord(w) for w in words], np.int64)
        assert repetition.longest_repeats(np.unique(ids, return_inverse=True)[1] if len(ids) else ids).tolist() == longest_by_force(words)


def judged_by_force(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    marked = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 8)}
    failed = len(words) < 20 or 100 * len(marked) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed


def texts() -> list[str | None]:
    chance = random.Random(2)
    base = [" ".join(chance.choice(["ab", "c#", "é", "d|\n", "e\x0b", "f "]) for _ in range(chance.randrange(60))) for _ in range(60)]
    line = "one line of some nine words or so here\n"
    return [None, "", " \n\t", "\x1cx\x85y", line * 5, "the same " * 300, *base, " ".join(f"u{k}" for k in range(400)), line + " ".join(f"u{k}" for k in range(40)) + "\n" + line]


def test_table_equals_brute_force(spark):
    rows = [(i, t, i) for i, t in enumerate(texts())] + [(None, "x y", None), (2, " \n\t", 2)]
    got = repetition.repetition_rules(spark.createDataFrame(rows, "doc_id bigint, text string, n_words bigint")).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((key((r[0], *r[1:7])) for r in got)) == sorted(key((i, *judged_by_force(t))) for i, t, _ in rows)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_verdict():
    clean = " ".join(f"u{k}" for k in range(400))
    assert repetition.judge(clean)[6]
    assert not repetition.judge("one two three four five six seven " * 3 + " ".join(f"u{k}" for k in range(12)))[6]
    assert not repetition.judge(None)[6]


def test_empty_and_filter(spark):
    docs = spark.createDataFrame([(1, " ".join(f"u{k}" for k in range(40)), "s"), (2, None, "s")], "doc_id bigint, text string, kept string")
    assert repetition.repetition_rules(docs.limit(0)).collect() == []
    assert [tuple(r) for r in repetition.keep_unrepetitive(docs).select("doc_id", "kept").collect()] == [(1, "s")]


def test_verdict_equals_brute_force():
    """kept, covered fraction and longest repeat from repeats found by comparing all pairs of places."""
    for text in [t for t in texts() if t and len(t) < 2500]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        longest = longest_by_force(words)
        spans = {p for k, n in enumerate(longest) if n >= repetition.MIN_REPEAT for p in range(k, k + n)}
        top, failed = max(longest, default=0), judged_by_force(text)[-1]
        kept = not failed and len(spans) <= repetition.MAX_COVERED * len(words) and top <= max(repetition.MIN_REPEAT, repetition.MAX_LONGEST * len(words))
        got = repetition.judge(text)
        assert (got[6], got[8]) == (kept, top) and abs(got[7] - len(spans) / max(1, len(words))) < 1e-12
