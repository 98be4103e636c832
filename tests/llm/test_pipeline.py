"""The whole pipeline against a plain version of each of its stages."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers

import corpus_pipeline
from tests.llm.test_pii import PATTERNS, base_spans
from tidemark.llm import bpe, mixing
from tidemark.llm.repetition import judge

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents() -> list[tuple]:
    chance = random.Random(9)
    word = lambda: "".join(chance.choice(["an", "the", "or", "ing", "st"]) for _ in range(chance.randrange(1, 5)))
    texts: list[str | None] = [" ".join(word() for _ in range(chance.randrange(25, 80))) for _ in range(24)]
    texts += [texts[0], texts[1] + " extra words", texts[2].upper(), texts[3].replace(" ", "  ", 3)]
    texts += [f"{texts[4]} write to a.b@mail.example.com or +1 (555) 010-9999 now", f"{texts[5]} from 10.1.2.3 é"]
    texts += ["too short", "again and again " * 40, None, ""]
    return [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]


def linked(a: str, b: str) -> bool:
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.encode().lower().split(), b.encode().lower().split())]
    return 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])


def plain_version(rows: list[tuple]) -> list[tuple]:
    kept = [r for r in rows if judge(r[1])[6]]
    part = {r[0]: r[0] for r in kept}
    for a, b in itertools.combinations(kept, 2):
        if linked(a[1], b[1]):
            low, high = sorted((part[a[0]], part[b[0]]))
            part = {k: low if v == high else v for k, v in part.items()}
    kept = [r for r in kept if part[r[0]] == r[0]]

    def clean(text: str) -> str:
        spans = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in base_spans(text)))
        out, at = [], 0
        for s, e, k in spans:
            if s >= at:
                out += [text[at:s], f"[{k.upper()}]"]
                at = e
        return "".join(out) + text[at:]

    frame = pd.DataFrame([(i, clean(t), lang, s, n) for i, t, lang, s, n in kept], columns=["doc_id", "text", "lang", "source", "n_chars"])
    taken = {i: (size, n) for i, size, n in duckdb.connect().register("documents", frame).sql(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()}
    encoding, out = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), []
    for i, text in zip(frame.doc_id, frame.text, strict=True):
        size, n = taken[i]
        for piece in (min(size, n), max(0, n - size)):
            if piece:
                cut = text if piece == size else "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)[:piece])
                ids = np.array(encoding.encode_ordinary(cut), "<u4")
                out.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(cut.encode()).hexdigest()))
    return sorted(out)


def test_pipeline_equals_the_plain_version(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, FIELDS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == plain_version(rows) and len(got) > 20
    assert PATTERNS and any("[EMAIL]" in t for (t,) in corpus_pipeline.personal_data(spark, spark.createDataFrame(rows, FIELDS), "").select("text").collect() if t)


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame([], FIELDS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").collect() == []


def test_nulls_repeats_long_texts_and_further_columns(spark, tmp_path):
    rows = [(*r, f"x{r[0]}", 1) for r in documents()]
    chance = random.Random(4)
    long = " ".join(f"w{chance.randrange(10**9)}" for _ in range(20000))
    rows += [rows[6], rows[6], (None, rows[7][1] + " and an end of its own that no other text has at all", "en", None, 0, None, None), (99, long, None, None, None, "long", 2), (None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, FIELDS + ", found string, label int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    apart = corpus_pipeline.near_duplicates(spark, kept, "")
    by_id = [r.doc_id for r in apart.select("doc_id").collect()]
    assert apart.columns == docs.columns and by_id.count(6) == 1 and by_id.count(None) == 1 and 99 in by_id
    clean = corpus_pipeline.personal_data(spark, docs, "")
    assert clean.columns == docs.columns and clean.count() == len(rows) and clean.where("text IS NULL").count() == sum(r[1] is None for r in rows)
    mixed = corpus_pipeline.source_mix(spark, docs, "")
    assert mixed.columns == docs.columns and mixed.where("text IS NULL OR text = ''").count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= set(by_id) and any(r.n_tokens > 40000 for r in got)
