"""Operator 10: mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Keys are range-sorted within their source in two levels: the leading
hex digits of the key name one of a fixed number of key ranges, and the rows of one range are sorted by a window.
Token totals of the ranges give each range its offset, so a prefix sum never needs a whole source in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, stored, word_count

#: Hex digits of the key that name a key range: 16**3 ranges for each source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh as `weights`, repeating, and divide `share` times all sizes.
    A target stops at `cap` times its source's size and the excess is shared again by weight. The level at which
    that ends is found directly: with sources ordered by cap / weight, those before the first source whose level
    doesn't exceed its own ratio are at their caps.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rated = (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    everything = Window.partitionBy()
    levels = (
        rated.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("settled", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("goal") - F.col("settled")) / F.col("open_weight"))
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    return levels.select(
        "source", "source_size",
        F.least("most", F.coalesce(F.col("final") * F.col("weight"), F.col("most"))).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, and with `carry` the struct carried of those columns.

    taken is the words that the mix takes of the document, repeats counted: the source's documents in key order are
    taken whole until the budget, floor(target), is reached; the document at the cut gives the rest of its budget. A
    target above the source's size begins another epoch in the same order.

    A null text counts no words. A null source is a source of its own, last in order. Documents without words take
    nothing. The key is the MD5 of the id as text (null: the empty text), a colon and the text, so that neither a null id
    nor a repeated one gathers its rows in one key range; rows that agree in both are interchangeable. An empty table gives no rows. Columns not named here are ignored.
    """
    blank = F.lit("")
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(text_col), blank)))
    base = (
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"),
            word_count(F.col(text_col)).alias("size"), F.struct(*[F.col(c) for c in carry] or [F.lit(1)]).alias("carried"),
        )
        .withColumn("key_range", F.substring("key", 1, RANGE_DIGITS))
    )
    if not carry:  # without the texts the rows are small: written once, the words are counted once
        base = stored(base, "mix-rows", waves=4)
    base = base.repartition("source", "key_range")
    ranges = base.groupBy("source", "key_range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    earlier = Window.partitionBy("source").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
        .join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source")))
        .select(F.col("source").alias("range_source"), F.col("key_range").alias("range_key"), "offset", "source_size", "target")
    )
    inside = Window.partitionBy("source", "key_range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        base.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("range_source")) & (F.col("key_range") == F.col("range_key")))
        .withColumn("before", F.col("offset") + F.col("inside"))
    )
    budget = F.floor("target").cast("long")
    taken = sum(
        (F.least("size", F.greatest(F.lit(0), budget - F.col("source_size") * epoch - F.col("before"))) for epoch in range(int(-(-cap // 1)))),
        F.lit(0),
    )
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col("carried")] * bool(carry))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of documents: a row for each epoch that takes something of a document.

    The document at a source's cut is shortened after the last word that is taken, and its n_chars follows. Documents
    without words, null and empty ones among them, aren't in the mix. Repeated rows count each, null ids and sources
    stay null, further columns of any name stay as they are, and an empty table gives no rows.
    """
    epochs = int(-(-options.get("cap", 2.0) // 1))
    took = mix_sources(docs, carry=docs.columns, **options)
    pieces = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: F.least("size", F.greatest(F.lit(0), F.col("taken") - F.col("size") * e))),
        lambda n: n > 0,
    )
    whole = F.col("carried.text")
    start = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("piece").cast("int")), "")
    rows = took.withColumn("piece", F.explode(pieces)).withColumn("cut", F.when(F.col("piece") < F.col("size"), start).otherwise(whole))
    own = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return rows.select(*[own[c].alias(c) if c in own else F.col("carried")[c].alias(c) for c in docs.columns])


SQL = r"""
WITH base AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
rated AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         source_size::DOUBLE * 2 AS most FROM sized),
levels AS (
  SELECT *, most / w AS ratio,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM rated),
final AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM final) * w, most))::DOUBLE AS target FROM levels),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pre FROM base)
SELECT doc_id, size, source_size, target,
  (least(size, greatest(0, floor(target)::BIGINT - pre)) + least(size, greatest(0, floor(target)::BIGINT - source_size - pre)))::BIGINT AS taken
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
"""
