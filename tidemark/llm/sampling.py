"""Labelled rows for fitting, and the split that keeps a fifth of them out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows of one class that a classifier is fitted on.
PER_CLASS = 4000
#: Bytes of the texts of one class after which no more are taken. With PER_CLASS this bounds what reaches the driver.
MOST_BYTES = 32_000_000


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text divides by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def sample_rows(
    docs: DataFrame, labels: DataFrame, label: str, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES
) -> DataFrame | None:
    """turn, doc_id, label and text of at most `per_class` rows of label 0 and as many of label 1, none of them held out.

    The rows with the smallest hashes of their ids are taken, in that order, so a rerun fits on the same rows. A class
    ends with the text that brings its total to `most_bytes`; whether a text is taken depends on the lengths of those
    before it, not on its own, and a class with texts is never empty. Only the chosen ids, at most twice `per_class`, are
    sent to the documents: first for the lengths, then for the texts. Null labels and ids fall out, and ids that are
    labelled both 0 and 1. Of rows that repeat an id one text counts, the greatest, and the longest for the total.
    None if there are no such rows.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    known = known.withColumn("turn", F.xxhash64(F.col("doc_id").cast("string")))
    chosen = known.where(F.col("label") == 0).orderBy("turn", "doc_id").limit(per_class).unionByName(known.where(F.col("label") == 1).orderBy("turn", "doc_id").limit(per_class))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = texts.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("turn", "doc_id", "label").agg(F.max("size").alias("size")).collect()
    total, taken = [0, 0], []
    for turn, doc_id, y, size in sorted(sizes):
        if total[y] < most_bytes:
            taken.append((turn, doc_id, y))
        total[y] += size
    if not taken:
        return None
    kept = docs.sparkSession.createDataFrame(taken, chosen.select("turn", "doc_id", "label").schema)
    return texts.join(F.broadcast(kept), "doc_id").groupBy("turn", "doc_id", "label").agg(F.max("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, **bounds) -> list[tuple[str, int]]:  # noqa: ANN003
    """(text, label) of sample_rows(), in the order of turn, doc_id and label."""
    rows = sample_rows(docs, labels, label, **bounds)
    return [] if rows is None else [(t, y) for _, _, y, t in sorted(rows.collect())]


def streamed_sample(docs: DataFrame, labels: DataFrame, label: str, **bounds) -> Iterator[tuple[str, int]]:  # noqa: ANN003
    """labelled_sample() one by one: the driver holds the texts of one partition at a time."""
    rows = sample_rows(docs, labels, label, **bounds)
    if rows is not None:
        for row in rows.orderBy("turn", "doc_id", "label").select("text", "label").toLocalIterator():
            yield row[0], row[1]
