from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tidemark.llm import mixing

FIELDS = "doc_id bigint, text string, source string, size string, target bigint"


def rows_of() -> list[tuple]:
    rows = [(i, " ".join(["w"] * (i % 17 + 1)), ["hot", "hot", "b", "c", None, "é"][i % 6], "clash", i) for i in range(300)]
    return rows + [(None, "a b", "b", None, None), (7, None, "c", None, None), (8, "", "empty", None, None), rows[3], rows[3], (9, "x" * 50000 + " y", "long", None, None)]


def test_equals_sql(spark):
    rows = rows_of()
    got = mixing.mix_sources(spark.createDataFrame(rows, FIELDS)).collect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source", "size", "target"]).astype({"doc_id": "Int64"})
    want = duckdb.connect().register("documents", documents).sql(mixing.SQL).fetchall()
    clean = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], round(r[3], 6), r[4])
    assert sorted(map(clean, got)) == sorted(map(clean, want))


def test_budgets_and_limits(spark):
    got = mixing.mix_sources(spark.createDataFrame(rows_of(), FIELDS), carry=["source"]).select("*", "carried.source").drop("carried").toPandas()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), whole=("source_size", "first"), size=("size", "sum"))
    assert ((by.target - by.taken).between(0, 1)).all() and (by["size"] == by.whole).all() and (by.target <= 2 * by.whole).all()
    assert by.target.sum() == pytest.approx(1.5 * got["size"].sum())


def test_mixed_documents_hold_the_taken_words(spark):
    docs = spark.createDataFrame(rows_of(), FIELDS).select("doc_id", "text", "source", "size", "target")
    taken = mixing.mix_sources(docs).groupBy().sum("taken").first()[0]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == taken


def test_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], FIELDS)).collect() == []
    assert mixing.mix_sources(spark.createDataFrame([(1, None, None, None, None)], FIELDS)).collect()[0].taken == 0
