from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers

from tidemark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", "a  b\n\n c", "It's 1234 — naïve text 👍🏽‍!", "x\0y " + "z" * 20000, " \t\n ", "the the the <|endoftext|>", "the the the <|endoftext|>"]


def test_equals_the_library_and_round_trips(spark):
    encoding = bpe.encoding(PATH, PATTERN)
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", 2), (3, TEXTS[3], 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids bigint")
    coded = bpe.encode_documents(docs, PATH, PATTERN, keep_ids=True)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded.collect())
    want = []
    for i, t, _ in rows:
        ids = np.array(encoding.encode_ordinary(t or ""), "<u4")
        want.append(((i is None, i or 0), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    texts = {i: (t or "").encode() for i, t, _ in rows}
    assert all(bytes(r.bytes) == texts[r.doc_id] for r in bpe.decode_documents(coded, PATH).collect())


def test_empty(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH, PATTERN).collect() == []
