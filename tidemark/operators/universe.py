"""Universe membership over time: queries, replays of histories, spell upkeep and name matching."""

from __future__ import annotations

import difflib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.temporal import Instant, column, contains, first_overlap, visible


def members(spells: DataFrame, on: Instant, known: Instant | None = None, recorded: str = "recorded_on", superseded: str = "superseded_on") -> DataFrame:
    """(universe, security_id) on a day, as known at an instant; only universes whose covered range has begun."""
    seen = spells if known is None else spells.where(visible(known, recorded, superseded))
    covered = seen.groupBy("universe").agg(F.min("valid_from").alias("_first")).where(F.col("_first") <= column(on))
    return seen.where(contains(on)).join(covered, "universe", "left_semi").select("universe", "security_id").distinct()


def coverage(spells: DataFrame) -> DataFrame:
    """Universes with their covered range; the end is null if any spell is open."""
    return spells.groupBy("universe").agg(
        F.min("valid_from").alias("start"), F.when(~F.bool_or(F.col("valid_to").isNull()), F.max("valid_to")).alias("end"), F.count_distinct("security_id").alias("securities")
    )


def history(spells: DataFrame, security_id: object) -> DataFrame:
    return spells.where(F.col("security_id") == F.lit(security_id)).orderBy("universe", "valid_from")


def overlapping(spells: DataFrame) -> DataFrame:
    """Universes' securities whose spells overlap, by the first that does."""
    return first_overlap(spells, ["universe", "security_id"])


def closed(spells: DataFrame, where: Column, on: Instant, recorded: Instant) -> DataFrame:
    """The table after the open spells that meet a condition end: each old record is superseded, and one with its end
    is appended; nothing is overwritten."""
    open_one = where & F.col("valid_to").isNull() & F.col("superseded_on").isNull()
    old = spells.withColumn("superseded_on", F.when(open_one, column(recorded)).otherwise(F.col("superseded_on")))
    new = spells.where(open_one).withColumn("valid_to", column(on)).withColumn("recorded_on", column(recorded))
    return old.unionByName(new)


def replay(events: DataFrame) -> DataFrame:
    """Spells from additions and removals of (universe, security_id, effective, change), each addition paired with the
    next removal; faults: an addition while in, a removal while out."""
    turn = Window.partitionBy("universe", "security_id").orderBy("effective", F.col("change").asc())
    marked = events.withColumn("_prev", F.lag("change").over(turn)).withColumn("valid_to", F.lead("effective").over(turn))
    fault = F.when((F.col("change") == "added") & (F.col("_prev") == "added"), "added_twice").when((F.col("change") == "removed") & F.coalesce(F.col("_prev") == "removed", F.lit(True)), "removed_while_out")
    marked = marked.withColumn("fault", fault)
    return marked.where((F.col("change") == "added") | F.col("fault").isNotNull()).select("universe", "security_id", F.col("effective").alias("valid_from"), F.when(F.col("change") == "added", F.col("valid_to")).alias("valid_to"), "fault")


def reverse_replay(events: DataFrame, anchor: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(start, days) of a history walked backwards from its end's members, anchor (universe, security_id).

    start: (universe, security_id) before the first change. days: (universe, effective, members, faults): the members
    before each day with changes, and its changes that don't fit what follows: an addition of a name that isn't there
    afterwards, or a removal of one that is. Of a day's changes of one name the removal comes first.
    """
    key = ["universe", "security_id"]
    turn = Window.partitionBy(*key).orderBy("effective", F.desc("change"))
    ends = anchor.select(*key).distinct().withColumn("_end", F.lit(1))
    after = F.when(F.col("_next").isNull(), F.col("_end").isNotNull()).otherwise(F.col("_next") == "removed")
    # what follows a change says who is there after it; the change itself says who was there before
    marked = events.withColumns({"_next": F.lead("change").over(turn), "_n": F.row_number().over(turn)}).join(ends, key, "left").withColumns({"_after": after, "_before": F.col("change") == "removed"})
    fits = F.col("_after") != F.col("_before")
    by_day = marked.groupBy("universe", "effective").agg(F.sum(F.col("_before").cast("int") - F.col("_after").cast("int")).alias("_step"), F.count_if(~fits).alias("faults"))
    back = Window.partitionBy("universe").orderBy(F.desc("effective")).rowsBetween(Window.unboundedPreceding, 0)
    sizes_at_end = ends.groupBy("universe").agg(F.count("*").alias("_size"))
    days = by_day.join(sizes_at_end, "universe", "left").withColumn("members", F.coalesce("_size", F.lit(0)) + F.sum("_step").over(back))
    first = marked.where((F.col("_n") == 1) & F.col("_before")).select(*key)
    start = first.unionByName(ends.select(*key).join(events.select(*key).distinct(), key, "left_anti"))
    return start, days.select("universe", "effective", "members", "faults")


def corrected(events: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, faults) after corrections (correction, universe, effective, name, new_effective, reason) of events
    (universe, effective, name, change, notes).

    A correction must meet exactly one event by universe, day and name; it moves that event to new_effective and adds
    its reason to the notes. One that meets none or several changes nothing and is a fault, with its number of hits.
    """
    by = ["universe", "effective", "name"]
    found = events.groupBy(*by).agg(F.count("*").alias("_hits"))
    met = corrections.join(found, by, "left").withColumn("hits", F.coalesce("_hits", F.lit(0)))
    once = met.where("hits = 1").select(*by, "new_effective", "reason")
    joined = events.join(once, by, "left")
    notes = F.when(F.col("reason").isNull(), F.col("notes")).otherwise(F.concat_ws(" ", F.nullif("notes", F.lit("")), F.concat(F.lit("[corrected: "), "reason", F.lit("]"))))
    fixed = joined.select("universe", F.coalesce("new_effective", "effective").alias("effective"), "name", "change", notes.alias("notes"))
    return fixed, met.where("hits <> 1").select("correction", "hits")


def sizes(events: DataFrame) -> DataFrame:
    """A universe's number of members after each day with changes."""
    step = F.sum(F.when(F.col("change") == "added", 1).otherwise(-1)).alias("step")
    daily = events.groupBy("universe", "effective").agg(step)
    return daily.withColumn("members", F.sum("step").over(Window.partitionBy("universe").orderBy("effective").rowsBetween(Window.unboundedPreceding, 0)))


def checkpoint_gaps(spells: DataFrame, expected: DataFrame, on: Instant) -> DataFrame:
    """Securities that only the replay or only a published list of (universe, security_id) has on a day."""
    ours = members(spells, on)
    missing = expected.join(ours, ["universe", "security_id"], "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(ours.join(expected, ["universe", "security_id"], "left_anti").withColumn("side", F.lit("unexpected")))


def member_months(spells: DataFrame, bars: DataFrame, least: int = 15) -> DataFrame:
    """For each universe and month: members at its end, those with `least` bars in it, and the missing part in percent."""
    edge = spells.agg(F.max(F.coalesce("valid_to", "valid_from")).alias("_hi"))
    # the months whose last day lies in the spell; one without an end runs to the latest day that any spell names
    open_to = spells.crossJoin(F.broadcast(edge)).withColumns({"_a": F.trunc("valid_from", "month"), "_z": F.when(F.col("valid_to").isNull(), F.trunc("_hi", "month")).otherwise(F.add_months(F.trunc("valid_to", "month"), -1))})  # one row
    each = F.explode(F.sequence("_a", "_z", F.expr("interval 1 month")))
    expected = open_to.where("_a <= _z").select("universe", "security_id", each.alias("_d")).select("universe", "security_id", F.last_day("_d").alias("month_end")).distinct()
    seen = bars.groupBy("security_id", F.last_day("trade_date").alias("month_end")).agg(F.count("*").alias("bars"))
    joined = expected.join(seen, ["security_id", "month_end"], "left")
    found = joined.groupBy("universe", "month_end").agg(F.count("*").alias("expected"), F.count("bars").alias("resolved"), F.count_if(F.col("bars") >= least).alias("with_prices"))
    return found.withColumn("gap_pct", 100 * (1 - F.col("with_prices") / F.col("expected")))


# Words that end company names.
SUFFIXES = ("plc", "ltd", "limited", "inc", "corp", "corporation", "company", "co", "group", "holdings", "sa", "ag", "nv")

#: Names of a block, names of it that meet a block of candidates at once, and columns that pairs of characters hash to.
NAME_BLOCK, NAME_ROWS, NAME_BUCKETS = 4096, 256, 512


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name without punctuation and company suffixes."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*SUFFIXES))


def normalised_name(name: Column) -> Column:
    return F.array_join(name_tokens(name), " ")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words; null if both have none."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def set_ratio(a: str, b: str) -> float:
    """Shared over all distinct words of two normalised names."""
    one, two = set(a.split()), set(b.split())
    return len(one & two) / len(one | two) if one and two else 0.0


def name_counts(names: list[str], split: Callable[[str], Iterable[str]], size: int) -> np.ndarray:
    """How often each name has the parts that `split` gives, hashed to `size` columns."""
    found = np.zeros((len(names), size), np.float32)
    for row, name in zip(found, names, strict=True):
        for part in split(name):
            row[zlib.crc32(part.encode()) % size] += 1
    return found


def close_names(left: list[str], right: list[str], least: float) -> Iterator[tuple[str, str, float]]:
    """(a, b, score) of all pairs with score >= least: the greater of difflib's ratio and the ratio of distinct words.

    Bounds drop most pairs unscored. A ratio of `least` means a common subsequence of least * (m + n) / 2 characters of
    m and n; a character that one side lacks takes at most two pairs of neighbours from its own name and parts one of
    the other's, so at least (1.5 * least - 1) * (m + n) - 1 pairs are shared. Products of hashed counts are never below
    what is shared, so no bound drops a pair that reaches `least`.
    """
    size = lambda names: np.array([len(x) for x in names], np.float32)
    words = lambda x: set(x.split())
    m, n = size(left), size(right)
    near = lambda x: (x[k : k + 2] for k in range(len(x) - 1))
    (pairs_a, words_a, signs_a), (pairs_b, words_b, signs_b) = (
        (name_counts(x, near, NAME_BUCKETS), name_counts(x, words, NAME_BUCKETS), name_counts(x, str, 64)) for x in (left, right)
    )
    count_a, count_b = words_a.sum(1), words_b.sum(1)
    matcher = difflib.SequenceMatcher(None)
    for start in range(0, len(left), NAME_ROWS):
        part = slice(start, start + NAME_ROWS)
        total = m[part, None] + n[None, :]
        by_text = pairs_a[part] @ pairs_b.T >= (1.5 * least - 1) * total - 1.001
        by_words = words_a[part] @ words_b.T >= least / (1 + least) * (count_a[part, None] + count_b[None, :]) - 0.001
        i, j = np.nonzero(by_text & ~by_words)
        shared = np.minimum(signs_a[part][i], signs_b[j]).sum(1)
        by_text[i, j] = 2 * shared >= least * total[i, j] - 0.001
        last = None
        for j, i in np.argwhere((by_text | by_words).T):
            a, b = left[start + i], right[j]
            if j != last:
                matcher.set_seq2(b)
                last = j
            score = set_ratio(a, b)
            if 2 * common_length(a, b) >= least * (len(a) + len(b)):
                matcher.set_seq1(a)
                score = max(score, matcher.ratio())
            if score >= least:
                yield a, b, score


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, which difflib's matches never exceed."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        hit = rest & places.get(c, 0)
        rest = (rest + hit | rest - hit) & full
    return len(a) - rest.bit_count()


def fuzzy_matches(names: DataFrame, candidates: DataFrame, accept: float = 0.90, margin: float = 0.06) -> DataFrame:
    """(name, match, ratio) where a candidate's ratio reaches `accept` and beats the next by `margin`.

    The ratio is the greater of difflib's, which no built-in equals, and that of distinct words, over normalised names.
    Every candidate counts, whether or not it shares a word: blocks of names meet blocks of candidates, and only pairs
    that can't reach `accept` - `margin`, and so neither match nor spoil a match, go unscored. Candidates whose
    normalised names are equal spoil each other, and with no margin the greatest match is taken; names without words
    match nothing.
    """
    left = names.select("name", normalised_name(F.col("name")).alias("a")).where("a <> ''").distinct()
    right = candidates.select(F.col("name").alias("match"), normalised_name(F.col("name")).alias("b")).where("b <> ''").distinct()
    ours, theirs = left.select("a").distinct(), right.select("b").distinct()
    rows, columns = (max(1, -(-x.count() // NAME_BLOCK)) for x in (ours, theirs))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda name, count: F.pmod(F.xxhash64(name), F.lit(count)).cast("int")
    ours = ours.select("a", block("a", rows).alias("i"), every(columns).alias("j"))
    theirs = theirs.select("b", block("b", columns).alias("j"), every(rows).alias("i"))
    least = accept - margin - 1e-9

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(close_names(list(one["a"]), list(two["b"]), least), columns=["a", "b", "ratio"])

    rated = ours.groupBy("i", "j").cogroup(theirs.groupBy("i", "j")).applyInPandas(run, "a string, b string, ratio double")
    rated = left.join(rated, "a").join(right, "b").select("name", "match", "ratio")
    order = Window.partitionBy("name").orderBy(F.desc("ratio"), F.desc("match"))
    ranked = rated.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead("ratio").over(order))
    alone = F.col("_next").isNull() | (F.col("ratio") - F.col("_next") >= margin)
    return ranked.where((F.col("_n") == 1) & (F.col("ratio") >= accept) & alone).select("name", "match", "ratio")
