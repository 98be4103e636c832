"""Operator 3: quality rules from the suffix array of a document's words.

Each text is handled alone and whole. Prefix doubling sorts the suffixes of its word sequence; the ranks that
doubling leaves at each level give the longest common prefixes of neighbours. An interval of suffixes that share a
prefix is a repeated substring; of all the intervals that a suffix lies in, the longest prefix is the larger one that it
shares with a neighbour. So the union of the repeated substrings is the union of these longest repeats, one for each
suffix, and no interval needs to be written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, bounded_batches

SYMBOLS = "#*$%&|<>"

#: The verdict's limits; reviewed by people, so plain numbers. A repeat counts from MIN_REPEAT words.
MIN_REPEAT = 4
MAX_COVERED = 0.35
#: The longest repeat may be so large a part of the text; repeats below MIN_REPEAT words don't count.
MAX_LONGEST = 0.2

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, covered_fraction double, longest_repeat bigint"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For each position, the words of the longest repeated substring that begins there."""
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64)
    rank, levels, width = ids.astype(np.int64), [], 1
    order = None
    while True:
        levels.append(rank)
        key = rank * (n + 1)
        if width < n:
            key[:-width] += rank[width:] + 1
        order = np.argsort(key)
        steps = np.empty(n, np.int64)
        steps[0] = 0
        sorted_key = key[order]
        np.cumsum(sorted_key[1:] != sorted_key[:-1], out=steps[1:])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        width *= 2
        if steps[-1] == n - 1:
            break
    one, two = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        a, b = one + common, two + common
        same = (a < n) & (b < n)
        same[same] = ranks[a[same]] == ranks[b[same]]
        common[same] += 1 << level
    longest = np.zeros(n, np.int64)
    longest[one] = common
    longest[two] = np.maximum(longest[two], common)
    return longest


def covered(longest: np.ndarray, least: int, span: int | None = None) -> int:
    """Words in the union of the repeats of `least` words or more; only their first `span` words if that is given."""
    at = np.flatnonzero(longest >= least)
    if not len(at):
        return 0
    edges = np.zeros(len(longest) + 1, np.int64)
    edges[at] += 1
    np.subtract.at(edges, at + (longest[at] if span is None else span), 1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def judge(text: str | None) -> tuple:
    """The values of SCHEMA after doc_id."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    longest = longest_repeats(ids)
    repeat_words = covered(longest, 8, 8)
    base_failed = n < 20 or 100 * repeat_words > 30 * n
    share = covered(longest, MIN_REPEAT) / n if n else 0.0
    top = int(longest.max()) if n else 0
    kept = not base_failed and share <= MAX_COVERED and top <= max(MIN_REPEAT, MAX_LONGEST * n)
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeat_words, base_failed, kept, share, top


def repetition_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with the columns of SCHEMA.

    A null or empty text has no words, fails the base rule and isn't kept. Repeated rows each give a row; a null id
    stays null. A text is never cut: memory follows the longest text of a batch. Other columns are ignored, and an
    empty table gives no rows.
    """

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [judge(t.as_py()) for t in batch.column(1)]
            columns = [pa.array(c) for c in zip(*judged, strict=True)]
            if judged:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def keep_unrepetitive(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns as they were.

    A null or empty text fails the base rule, so it goes. Repeated rows are judged alike, ids aren't looked at, further
    columns may have any name, and an empty table stays empty.
    """

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: judge(t)[6]).astype(bool)

    return docs.where(kept(F.col("text")))
