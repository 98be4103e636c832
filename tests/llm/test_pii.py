from __future__ import annotations

import hashlib
import re

from tidemark.llm import pii

# The contract's own patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None, "", "no data here", "mail a.b@x.example.com, é 👍 c@d.org.", "a@b@c.d a@b.c%d@e.f x@y", "ip 1.2.3.4.5.6.7.8 and 300.1.1.1 and 0001.02.3.255 and 1.2.3",
    "card 4111 1111 1111 1111, 4111111111111112 and 4111-1111-1111-1111", "4111111111111111 4111111111111111", "call +1 (555) 010-9999 or +49 30 1234567. +1-2", "+1+2+33 4444 55555",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "write to joe [at] site [dot] com or (555) 010-9999", "9" * 4000, "1.1.1.1 " * 700, "a." * 3000 + "@" + "b." * 3000 + "c", "é" * 30 + "1.2.3.4",
]


def luhn(number: str) -> bool:
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(number))) % 10 == 0


def base_spans(text: str | None) -> list[str]:
    def passes(kind: str, value: str) -> bool:
        number = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        return kind == "email" or kind == "card" and 16 <= len(number) <= 19 and luhn(number) or kind == "phone" and 8 <= len(number) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_base_equals_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], None), (3, TEXTS[3], None)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string, found string")).collect()
    want = []
    for i, t, _ in rows:
        spans = base_spans(t)
        counts = [sum(s.startswith(f"{k}:") for s in spans) for k in PATTERNS]
        want.append((i is None, i or 0, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted((r[0] is None, r[0] or 0, *r[1:6]) for r in got) == sorted(want)
    for r in got:
        spans = [s for s in r.spans.split(",") if s]
        assert set(base_spans(TEXTS[r.doc_id if r.doc_id is not None else 3])) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
    by_id = {r.doc_id: r.spans for r in got}
    assert by_id[10].startswith("secret:9:49") and by_id[2] == ""


def test_estimation_tells_reliable_votes():
    counts = {("secret", "++++", 5): 50, ("secret", "+++0", 5): 40, ("secret", "--0-", 2): 60, ("secret", "-0--", 2): 30}
    truth = pii.posteriors(counts)
    assert truth["secret", "++++"] > 0.95 and truth["secret", "--0-"] < 0.05
    weights = pii.trained(counts, truth)
    z = lambda p: sum(weights[f] for f in pii.features(p))
    assert z(("secret", "++++", 5)) > 0 > z(("secret", "--0-", 2))


def test_redaction_and_empty(spark):
    docs = spark.createDataFrame([(1, "é call +1 (555) 010-9999 now", 9, "x"), (2, None, 0, "y"), (3, "plain", 5, "z")], "doc_id bigint, text string, n_chars bigint, carried string")
    got = {r.doc_id: (r.text, r.n_chars, r.carried) for r in pii.redacted(docs).collect()}
    assert got == {1: ("é call [PHONE] now", 18, "x"), 2: (None, 0, "y"), 3: ("plain", 5, "z")}
    assert pii.personal_data(docs.limit(0)).collect() == []


def planted(seed: int, count: int) -> tuple[list[tuple[int, str]], dict[int, set[str]], dict[int, set[str]]]:
    """Prose with personal data, and with look-alikes that aren't: digests of commits, long numbers, names of things."""
    import random

    chance, docs, good, bad = random.Random(seed), [], {}, {}
    word = lambda: "".join(chance.choice(["an", "the", "or", "in", "st", "re"]) for _ in range(chance.randrange(1, 4)))
    hexes = lambda n: "".join(chance.choice("0123456789abcdef") for _ in range(n - 8)) + "0a1b2c3d"
    number = lambda n: "".join(chance.choice("123456789") for _ in range(n))
    makers = [
        ("secret", True, lambda: ('token = "', hexes(40), '"')), ("secret", True, lambda: ("password: ", "Xy9aB7cQ" + "".join(chance.choice("abcXYZ789") for _ in range(16)), "")),
        ("secret", False, lambda: ("build ", "release-notes-for-" + word() + "-2024", "")), ("secret", False, lambda: ("part ", "chapter_" + word() + "_section_" + str(chance.randrange(99)), "")),
        ("account", True, lambda: ("konto ", "4" + number(15), "")), ("account", False, lambda: ("isbn ", "978" + number(7), "")), ("account", False, lambda: ("part ", "9" + number(10), "")),
        ("name", True, lambda: ("Mr. ", "James Holloway", "")), ("name", True, lambda: ("Name: ", "Petra Lindner", "")), ("name", False, lambda: ("in the ", "North Harbour", "")),
        ("name", False, lambda: ("of ", "Winter Sale", "")), ("name", False, lambda: ("under the ", "General Terms", "")), ("local_phone", True, lambda: ("call ", "(555) 010-9999", "")),
    ]
    for i in range(count):
        text = " ".join(word() for _ in range(20))
        kind, real, made = chance.choice(makers)
        before, value, after = made()
        start = len(text) + 1 + len(before)
        text = f"{text} {before}{value}{after} {word()} {word()}."
        docs.append((i, text))
        (good if real else bad).setdefault(i, set()).add(f"{kind}:{start}:{start + len(value)}")
    return docs, good, bad


def test_added_spans_by_precision_and_recall(spark):
    docs, good, bad = planted(5, 600)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {r.doc_id: {x for x in r.spans.split(",") if x and x.split(":")[0] not in pii.BASE} for r in pii.personal_data(frame).collect()}
    base = {i: {x for x in base_spans(t)} for i, t in docs}
    wanted = {i: {x for x in xs if not any(x.split(":", 1)[1] == y.split(":", 1)[1] for y in base[i])} for i, xs in good.items()}
    hits, all_wanted, all_found = sum(len(found[i] & xs) for i, xs in wanted.items()), sum(map(len, wanted.values())), sum(map(len, found.values()))
    assert hits / all_wanted > 0.95 and hits / all_found > 0.95
    turned_down = sum(len(xs - found[i]) for i, xs in bad.items())
    assert turned_down / sum(map(len, bad.values())) > 0.95 and sum(map(len, bad.values())) > 200


def test_the_labelers_disagree(spark):
    docs, good, bad = planted(6, 300)
    rows = pii.candidates(spark.createDataFrame(docs, "doc_id bigint, text string"), "text", ["doc_id"]).select("found").collect()
    patterns = {(s.kind, s.votes) for r in rows for s in r.found if not s.base}
    assert any("+" in v and "-" in v for _, v in patterns)
    assert {k for k, _ in patterns} >= {"secret", "account", "name"}
