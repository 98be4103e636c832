"""The training corpus: rules, near duplicates, personal data, mixing and encoding, one after the other.

Each stage takes the documents that its predecessor kept, as a table that has been written and read again, and returns
documents with the same columns; the last returns a row of token ids digests for each document of the mix. Once a stage
is written, what it and its predecessor had written for it goes.

In every stage further columns of any name are carried along unchanged (the last drops them) and an empty table gives an
empty one; what becomes of nulls, empty texts and repeated rows is said at each.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, near, pii, repetition
from tidemark.llm.common import MADE, discard, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the base rule or the suffix-array verdict rejects go.

    So null and empty texts go, as they have fewer than 20 words. Repeated rows and null ids are judged by their texts.
    """
    return repetition.keep_unrepetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near duplicates the document with the smallest id stays.

    Equal rows count once; rows that repeat an id with other texts are documents of their own. A row with a null id stays
    only where its group has no other. Null and empty texts link with nothing and stay.
    """
    return near.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: spans of personal data give way to the names of their kinds.

    All rows stay. A null text stays null and an empty one empty; repeated rows are treated alike, ids aren't looked at.
    """
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each source gives its target of words; a document is there once for each epoch that takes it.

    Null and empty texts have no words, so they aren't in the mix. A null source is a source of its own; repeated rows
    and null ids count each.
    """
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the ids of each document of the mix.

    A row for each row; a null text has no ids, as an empty one, and a null id stays null.
    """
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: SQL can express neither the suffix arrays, nor the classifier of spans, nor byte-level BPE; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        start = len(MADE)
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", waves=8, size=size)
        discard(spark, before + MADE[start:-1])
        before = MADE[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
