"""Point-in-time predicates and joins: knowledge filters, half-open ranges, as-of, interval, band and alignment joins."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Instant = str | date | datetime | Column


def column(value: Instant) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def as_of(df: DataFrame, instant: Instant, available: str = "available_at") -> DataFrame:
    """Rows knowable at the instant (a value, or a column's name so that one plan serves many dates)."""
    return df.where(F.col(available) <= column(instant))


def visible(instant: Instant | None, recorded: str = "recorded_at", superseded: str = "superseded_at") -> Column:
    """Whether a bitemporal record is known at the instant; null bounds are open. Without one: the current records."""
    if instant is None:
        return F.col(superseded).isNull()
    at = column(instant)
    return F.coalesce(F.col(recorded) <= at, F.lit(True)) & F.coalesce(F.col(superseded) > at, F.lit(True))


def known_as_of(df: DataFrame, instant: Instant, recorded: str = "recorded_at", superseded: str = "superseded_at") -> DataFrame:
    """The records known at the instant, without what was learnt of their end later."""
    return df.where(visible(instant, recorded, superseded)).withColumn(superseded, F.lit(None).cast(df.schema[superseded].dataType))


def contains(on: Instant, start: str = "valid_from", end: str = "valid_to") -> Column:
    """on lies in the half-open [start, end); a null end is open."""
    at = column(on)
    return (F.col(start) <= at) & F.coalesce(at < F.col(end), F.lit(True))


def overlaps(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether two half-open ranges share a day; null ends are open."""
    return F.coalesce(a[0] < b[1], F.lit(True)) & F.coalesce(b[0] < a[1], F.lit(True))


def first_overlap(df: DataFrame, by: Sequence[str], start: str = "valid_from", end: str = "valid_to", tie: Sequence[str] = ()) -> DataFrame:
    """Of each group the first record, by start, that begins before an earlier one has ended; empty if none overlaps."""
    order = Window.partitionBy(*by).orderBy(start, *tie)
    far = F.lit(date(9999, 12, 31))
    reached = F.max(F.coalesce(end, far)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    clash = df.withColumn("_reached", reached).where(F.col(start) < F.col("_reached"))
    return clash.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_reached")


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, take: dict[str, str],
    *, strict: bool = False, forward: bool = False, tolerance_days: int | None = None, bucket_days: int | None = None,
) -> DataFrame:
    """Every left row with the right row of its key that is nearest in time: at or before it (strict: before it), or
    with `forward` at or after it. take: right column to name in the result. Null where there is none, or none within
    `tolerance_days`.

    Both sides go through one shuffle by key and one sort; no inequality join. Of right rows at one time the greatest
    counts. bucket_days: splits a key's time line, so that a key with very many rows is spread over tasks: each bucket
    looks in itself first and then takes what the buckets before it carry over.
    """
    names = list(take)
    payload = F.struct(F.col(right_time).alias("_t"), *[F.col(n).alias(f"_{i}") for i, n in enumerate(names)])
    rank = 1 if strict else 0  # where a right row stands among rows of its time; left rows stand at 0.5
    rows = left.select(*by, F.col(left_time).alias("_time"), F.lit(0.5).alias("_side"), F.struct("*").alias("_left"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_right"))
    marks = right.where(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("_time"), F.lit(float(rank)).alias("_side"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), payload.alias("_right"))
    both = rows.unionByName(marks)
    turn = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    # with forward the time line is walked backwards, so the sides keep their order
    order = [turn("_time"), F.col("_side").asc(), F.col("_right").asc_nulls_first()]
    if bucket_days is None:
        found = F.last("_right", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        joined = both.withColumn("_found", found)
    else:
        both = both.withColumn("_bucket", F.floor(F.datediff(F.to_date("_time"), F.lit(date(1970, 1, 1))) / bucket_days))
        inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_found", F.last("_right", ignorenulls=True).over(inside))
        when = F.col("_right._t").cast("timestamp").cast("double") * (-1 if forward else 1)
        ends = both.groupBy(*by, "_bucket").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct(when.alias("t"), F.col("_right").alias("r")))).alias("_end"))
        walk = Window.partitionBy(*by).orderBy(turn("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(walk)).drop("_end")
        keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_bucket")]
        joined = both.alias("a").join(carried.alias("b"), keys).select("a._left", "a._side", F.coalesce("a._found", "b._carried").alias("_found"))
    joined = joined.where("_side = 0.5")
    if tolerance_days is not None:
        gap = F.abs(F.datediff(F.col(f"_left.{left_time}"), F.col("_found._t")))
        joined = joined.withColumn("_found", F.when(gap <= tolerance_days, F.col("_found")))
    return joined.select("_left.*", *[F.col(f"_found._{i}").alias(take[n]) for i, n in enumerate(names)])


def interval_join(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Each point with the spans of its key that contain it."""
    shared = [F.col(f"p.{c}") == F.col(f"s.{c}") for c in by]
    inside = (F.col(f"s.{start}") <= F.col(f"p.{at}")) & F.coalesce(F.col(f"p.{at}") < F.col(f"s.{end}"), F.lit(True))
    return points.alias("p").join(spans.alias("s"), [*shared, inside]).select("p.*", *[f"s.{c}" for c in spans.columns if c not in points.columns])


def band_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_date: str, right_date: str, days: int, how: str = "inner") -> DataFrame:
    """Rows of one key whose dates are at most `days` apart.

    Each left row is put into the few buckets of `days` width that its band touches, so the join is an equi-join on
    key and bucket; how: inner, left_anti or left_semi.
    """
    width = max(days, 1)
    bucket = lambda c: F.floor(F.datediff(c, F.lit(date(1970, 1, 1))) / width)
    spread = left.withColumn("_bucket", F.explode(F.sequence(bucket(F.date_sub(left_date, days)), bucket(F.date_add(left_date, days)))))
    near = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in by] + [F.col("l._bucket") == F.col("r._rb"), F.abs(F.datediff(f"l.{left_date}", f"r.{right_date}")) <= days]
    marked = right.withColumn("_rb", bucket(F.col(right_date)))
    if how == "inner":
        return spread.alias("l").join(marked.alias("r"), near).drop("_bucket", "_rb")
    hit = spread.alias("l").join(marked.alias("r"), near, "left_semi").drop("_bucket").distinct()
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in left.columns]
    return left.alias("a").join(hit.alias("b"), same, how)


def align(left: DataFrame, right: DataFrame, on: str = "date") -> tuple[DataFrame, DataFrame]:
    """The inner join on a date, and the dates that only one side has with the side's name."""
    both = left.join(right, on)
    full = left.select(on, F.lit(1).alias("_l")).join(right.select(on, F.lit(1).alias("_r")), on, "full_outer")
    lost = full.where("_l IS NULL OR _r IS NULL").select(on, F.when(F.col("_l").isNotNull(), "left").otherwise("right").alias("side"))
    return both, lost


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b has too, counted as often, nulls equal; a.exceptAll of it shows what b lost."""
    return a.intersectAll(b.select(*a.columns))


def membership_changes(spans: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """ADDED at valid_from and REMOVED at valid_to within (start, end]."""
    lo, hi = column(start), column(end)
    inside = lambda c: (F.col(c) > lo) & (F.col(c) <= hi)
    added = spans.where(inside("valid_from")).select("universe", "security_id", F.col("valid_from").alias("effective"), F.lit("added").alias("change"))
    gone = spans.where(inside("valid_to")).select("universe", "security_id", F.col("valid_to").alias("effective"), F.lit("removed").alias("change"))
    return added.unionByName(gone)
