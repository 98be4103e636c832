"""Trading sessions: weekday calendars in closed form, month ends, rebalance days and gaps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = date(1970, 1, 1)


def weekday_number(day: Column | str) -> Column:
    """The number of weekdays before a day, counted from a Monday; differences are weekdays between days."""
    days = F.datediff(day, F.lit(EPOCH)) + 3
    return (F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))).cast("long")


def sessions_between(start: Column | str, end: Column | str) -> Column:
    """Weekday sessions from start to end, both included."""
    return weekday_number(F.date_add(end, 1)) - weekday_number(start)


def next_session(day: Column | str) -> Column:
    """The weekday after a day."""
    return F.date_add(day, F.when(F.weekday(day) >= 4, 7 - F.weekday(day)).otherwise(1))


def previous_session(day: Column | str) -> Column:
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))


def sessions(spark: SparkSession, start: date, end: date, holidays: DataFrame | None = None, half_days: DataFrame | None = None) -> DataFrame:
    """(session, is_half_day): weekdays that aren't holidays, from start to end. Both tables have one column, session."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("session")).where(F.weekday("session") < 5)
    if holidays is not None:
        days = days.join(holidays, "session", "left_anti")
    if half_days is None:
        return days.withColumn("is_half_day", F.lit(False))
    return days.join(half_days.select("session", F.lit(True).alias("is_half_day")), "session", "left").na.fill(False, ["is_half_day"])


def month_ends(days: DataFrame, column: str = "session") -> DataFrame:
    """The last session of each month."""
    return days.groupBy(F.trunc(column, "month").alias("_m")).agg(F.max(column).alias(column)).drop("_m")


def rebalance_sessions(days: DataFrame, months: tuple[int, ...] = tuple(range(1, 13)), offset: int = 0, column: str = "session") -> DataFrame:
    """The (offset + 1)-th session of each scheduled month, or its last if it has fewer."""
    turn = Window.partitionBy(F.trunc(column, "month")).orderBy(column)
    ranked = days.where(F.month(column).isin(*months)).withColumn("_n", F.row_number().over(turn)).withColumn("_of", F.count("*").over(Window.partitionBy(F.trunc(column, "month"))))
    return ranked.where(F.col("_n") == F.least(F.lit(offset + 1), F.col("_of"))).select(column)


def gap_runs(bars: DataFrame) -> DataFrame:
    """Stretches of weekdays without a bar between a security's first and last bar: start, end, sessions.

    A gap lies between neighbouring bars, so one window finds all; no calendar is crossed with the securities.
    """
    prev = F.lag("trade_date").over(Window.partitionBy("security_id").orderBy("trade_date"))
    marked = bars.select("security_id", "trade_date", prev.alias("_prev")).where("_prev IS NOT NULL")
    lost = marked.select("security_id", next_session("_prev").alias("start"), previous_session("trade_date").alias("end"))
    return lost.withColumn("sessions", sessions_between("start", "end")).where("sessions > 0 AND start <= end")


def listing_gaps(listings: DataFrame, bars: DataFrame, days: DataFrame) -> DataFrame:
    """Runs of sessions within listing windows (security_id, valid_from, valid_to) without a bar: start, end, sessions.

    Windows are clamped to the calendar; a listing without an end runs to the calendar's last session.
    """
    span = days.agg(F.min("session").alias("_lo"), F.max("session").alias("_hi"))
    windows = listings.crossJoin(F.broadcast(span)).select("security_id", F.greatest("valid_from", "_lo").alias("_a"), F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("_hi")), F.col("_hi")).alias("_z")).where("_a <= _z")
    numbered = days.select("session", F.row_number().over(Window.orderBy("session")).alias("_k"))  # a calendar is a short list
    expected = windows.select("security_id", F.explode(F.sequence("_a", "_z")).alias("session")).distinct().join(F.broadcast(numbered), "session")
    lost = expected.join(bars.select("security_id", F.col("trade_date").alias("session")), ["security_id", "session"], "left_anti")
    island = F.col("_k") - F.row_number().over(Window.partitionBy("security_id").orderBy("_k"))
    return lost.withColumn("_i", island).groupBy("security_id", "_i").agg(F.min("session").alias("start"), F.max("session").alias("end"), F.count("*").alias("sessions")).drop("_i")


def session_gaps(bars: DataFrame, days: DataFrame) -> DataFrame:
    """As gap_runs(), over the sessions of a calendar: runs of sessions without a bar between a security's first and last
    bar, so that a holiday is no gap. Bars on days that aren't sessions don't count."""
    numbered = days.select("session", F.row_number().over(Window.orderBy("session")).alias("_k"))  # a calendar is a short list
    placed = bars.select("security_id", F.col("trade_date").alias("session")).distinct().join(F.broadcast(numbered), "session")
    prev = F.lag("_k").over(Window.partitionBy("security_id").orderBy("_k"))
    lost = placed.withColumn("_p", prev).where("_k - _p > 1").select("security_id", (F.col("_p") + 1).alias("_from"), (F.col("_k") - 1).alias("_to"))
    at = lambda number, name: F.broadcast(numbered.select(F.col("_k").alias(number), F.col("session").alias(name)))
    return lost.join(at("_from", "start"), "_from").join(at("_to", "end"), "_to").select("security_id", "start", "end", (F.col("_to") - F.col("_from") + 1).cast("long").alias("sessions"))


def half_days(hours: DataFrame) -> DataFrame:
    """Sessions (session, minutes) shorter than the usual length, the most frequent one (the longest of those)."""
    usual = hours.groupBy("minutes").agg(F.count("*").alias("_n")).agg(F.max(F.struct("_n", "minutes")).alias("_u"))
    return hours.crossJoin(F.broadcast(usual)).where(F.col("minutes") < F.col("_u.minutes")).drop("_u")  # one row
