from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tidemark.llm import quality, sampling, toxicity


def corpus(seed: int, count: int = 500) -> tuple[list[tuple], list[tuple]]:
    """Prose of made-up words; toxic texts hold one of a few words or forms of a stem, poor ones are noisy or repeat."""
    chance = random.Random(seed)
    words = ["".join(chance.choice(["an", "the", "or", "in", "st", "re"]) for _ in range(chance.randrange(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(count):
        text = [chance.choice(words) for _ in range(chance.randrange(20, 120))]
        toxic, good = int(chance.random() < 0.3), int(chance.random() < 0.6)
        if toxic:
            text[chance.randrange(len(text))] = chance.choice(["idiot", "scum", "réeux" + chance.choice(words)])
        if not good:
            text = [w + chance.choice(["&&&", "%%%", " |"]) for w in text] if chance.random() < 0.5 else [w for w in text[:12] for _ in range(8)]
            if toxic:
                text.insert(3, "scum")
        docs.append((i, " ".join(text), "clash"))
        labels.append((i, good, toxic))
    docs += [(None, "null id", None), (count, None, None), (count + 1, "", None), (3, docs[3][1], None)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(1)
    return spark.createDataFrame(docs, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), len(docs), labels


@pytest.mark.parametrize(("run", "column", "threshold"), [(quality.score_quality, 1, 0.3), (toxicity.score_toxicity, 2, 0.5)])
def test_held_out_accuracy_and_shape(tables, run, column, threshold):
    docs, labels, count, known = tables
    got = run(docs, labels).collect()
    assert len(got) == count
    truth = {x[0]: x[column] for x in known}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    empty = {r.score for r in got if r.doc_id in (500, 501)}
    assert len(empty) == 1
    again = {(r.doc_id, r.score) for r in run(docs, labels).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


@pytest.mark.parametrize("run", [quality.score_quality, toxicity.score_toxicity])
def test_held_out_labels_are_never_learnt(spark, tables, run):
    from pyspark.sql import functions as F

    docs, labels, _, _ = tables
    held = sampling.is_held_out(F.col("doc_id"))
    turned = labels.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    assert sorted(map(str, run(docs, labels).collect())) == sorted(map(str, run(docs, turned).collect()))


@pytest.mark.parametrize("run", [quality.score_quality, toxicity.score_toxicity])
def test_without_labels_or_documents(spark, tables, run):
    docs, labels, count, _ = tables
    assert {r.score for r in run(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in run(docs, labels.where("quality = 1 AND toxic = 0")).collect()} == {0.5}
    assert run(docs.limit(0), labels).collect() == []


def test_sample_is_bounded_and_repeatable(tables):
    docs, labels, _, _ = tables
    one, two = (sampling.labelled_sample(docs, labels, "toxic", per_class=20) for _ in range(2))
    assert one == two and sorted({y for _, y in one}) == [0, 1] and sum(y for _, y in one) <= 21 and len(one) <= 42


def test_a_class_of_long_texts_is_learnt(spark):
    docs = [(i, ("scum " if i % 2 else "fine ") * (15_000 if i % 2 else 20), None) for i in range(60)]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string, score string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    assert {y for _, y in sampling.labelled_sample(*frames, "toxic")} == {0, 1}


def test_sample_ends_at_its_bytes_whatever_the_lengths(tables):
    docs, labels, _, _ = tables
    whole = sampling.labelled_sample(docs, labels, "toxic")
    for most in (1, 2000, 20_000):
        got, want, total = sampling.labelled_sample(docs, labels, "toxic", most_bytes=most), [], [0, 0]
        for text, y in whole:
            if total[y] < most:
                want.append((text, y))
            total[y] += len(text.encode())
        assert got == want and {y for _, y in got} == {0, 1}
    assert len(want) < len(whole)


def test_coordinate_descent_separates():
    rows = [np.array([0, 2]), np.array([0]), np.array([1, 2]), np.array([1])]
    w, b = quality.descend(rows, np.ones(3), np.array([1.0, 1, -1, -1]), np.full(4, 10.0), 50)
    assert [np.sign(w[r].sum() + b) for r in rows] == [1, 1, -1, -1]


def test_convolution_sees_whole_texts():
    """A text's score doesn't depend on the texts that are scored with it, nor on how many."""
    docs, labels = corpus(2, 200)
    net = toxicity.fit([(d[1], t[2]) for d, t in zip(docs, labels, strict=False)])
    texts = [d[1] for d in docs[:40]] + [None, "", "scum " + "the " * 3000, "the " * 3000 + "scum"]
    together = toxicity.score_texts(net, texts, toxicity.Rows())
    alone = np.concatenate([toxicity.score_texts(net, [t], toxicity.Rows()) for t in texts])
    assert np.allclose(together, alone, atol=1e-6)
    assert together[-1] > 0.5 and together[-2] > 0.5


def test_fit_never_holds_the_words_of_its_sample(monkeypatch):
    """Beyond its networks, the fit takes a few bytes for each word of the sample, not an object for each."""
    chance = random.Random(4)
    words = ["".join(chance.choice("aeiourstln") for _ in range(8)) for _ in range(3000)]
    sample = [(" ".join(chance.choices(words, k=4000)) + " scum" * (i % 2), i % 2) for i in range(300)]
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    tracemalloc.start()
    assert toxicity.fit(sample) is not None
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 100e6, peak


def test_blocks_of_places_leave_the_network_as_it_is(monkeypatch):
    docs, labels = corpus(3, 120)
    sample = [(d[1], t[2]) for d, t in zip(docs, labels, strict=False)] + [("", 0), ("scum " * 300, 1), ("ab " * 300, 0)]
    texts = [t for t, _ in sample]
    nets = []
    for at_once, remembered in ((1 << 17, 1 << 18), (64, 50)):
        monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
        monkeypatch.setattr(toxicity, "REMEMBERED", remembered)
        nets.append(toxicity.fit(iter(sample)))
    whole, blocks = nets
    assert np.array_equal(whole.rows, blocks.rows) and all(map(np.array_equal, whole.filters, blocks.filters))
    assert (whole.bias, whole.threshold, whole.thresholds) == (blocks.bias, blocks.threshold, blocks.thresholds)
    assert np.allclose(toxicity.score_texts(whole, texts, toxicity.Rows()), toxicity.score_texts(blocks, texts, toxicity.Rows()), atol=1e-6)


def test_streamed_sample_is_the_labelled_sample(tables):
    docs, labels, _, _ = tables
    for bounds in ({}, {"per_class": 20}, {"most_bytes": 2000}):
        assert list(sampling.streamed_sample(docs, labels, "toxic", **bounds)) == sampling.labelled_sample(docs, labels, "toxic", **bounds)
    assert list(sampling.streamed_sample(docs, labels.limit(0), "toxic")) == []
