"""Performance of value curves: metric records, rolling windows, drawdowns, benchmark-relative figures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats

YEAR_DAYS = 365.25


def curve(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy("date")


def returns(equity: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Returns of a value curve; its first day has none."""
    prev = F.lag("value").over(curve(by))
    return equity.withColumn("ret", F.col("value") / F.nullif(prev, F.lit(0.0)) - 1).where(F.col("ret").isNotNull())


def drawdowns(equity: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """value / highest value so far - 1, by day."""
    peak = F.max("value").over(curve(by).rowsBetween(Window.unboundedPreceding, 0))
    return equity.withColumn("peak", peak).withColumn("drawdown", F.col("value") / F.col("peak") - 1)


def max_drawdown(equity: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The deepest drawdown and the first day of it; the curve's first day if it never falls."""
    return drawdowns(equity, by).groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"), F.min_by("date", F.struct("drawdown", "date")).alias("trough"))


def drawdown_episodes(equity: DataFrame, by: Sequence[str] = (), top: int = 5) -> DataFrame:
    """The deepest `top` falls from a high to the recovery: peak, trough and recovery day (null if none), days, depth."""
    order = curve(by)
    marked = drawdowns(equity, by).withColumn("at_peak", F.col("drawdown") >= 0)
    island = F.sum(F.col("at_peak").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("episode", island)
    starts = marked.where("at_peak").select(*by, "episode", F.col("date").alias("peak_date"))
    falls = marked.where(~F.col("at_peak")).groupBy(*by, "episode").agg(
        F.min("drawdown").alias("depth"), F.min_by("date", F.struct("drawdown", "date")).alias("trough_date"), F.max("date").alias("last")
    )
    recovered = starts.withColumn("before", F.col("episode") - 1).select(*by, F.col("before").alias("episode"), F.col("peak_date").alias("recovery_date"))
    joined = falls.join(starts, [*by, "episode"]).join(recovered, [*by, "episode"], "left")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("depth", "peak_date"))
    days = F.datediff(F.coalesce("recovery_date", "last"), "peak_date")
    return joined.withColumn("rank", rank).where(F.col("rank") <= top).select(*by, "rank", "depth", "peak_date", "trough_date", "recovery_date", days.alias("days"))


def metric_record(equity: DataFrame, by: Sequence[str] = (), risk_free: float = 0.0, periods: int = 252) -> DataFrame:
    """One record for each curve: returns, risk, ratios, drawdown and flags for what has too little data."""
    rets, base = returns(equity, by), (1 + risk_free) ** (1 / periods) - 1
    excess = F.col("ret") - F.lit(base)
    # the downside counts over the whole sample, not over losing days alone
    downside = F.sqrt(F.sum(F.pow(F.least(excess, F.lit(0.0)), 2)) / F.count("ret"))
    risk = rets.groupBy(*by).agg(
        F.count("*").alias("observations"), stats.annualised_volatility(F.col("ret"), periods).alias("volatility"), stats.sharpe(F.col("ret"), risk_free, periods).alias("sharpe"),
        (F.avg(excess) / F.nullif(downside, F.lit(0.0)) * F.sqrt(F.lit(float(periods)))).alias("sortino"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"),
    )
    span = equity.groupBy(*by).agg(F.min("date").alias("start"), F.max("date").alias("end"), F.min_by("value", "date").alias("_first"), F.max_by("value", "date").alias("_last"))
    years = F.datediff("end", "start") / F.lit(YEAR_DAYS)
    growth = F.col("_last") / F.col("_first")
    span = span.withColumns({"total_return": growth - 1, "cagr": F.when((years > 0) & (growth > 0), F.pow(growth, 1 / F.nullif(years, F.lit(0.0))) - 1)})
    depth = max_drawdown(equity, by)
    joined = _with(_with(span, risk, by), depth, by).drop("_first", "_last")
    flags = F.array_compact(F.array(F.when(F.col("observations") < periods, "under_one_year"), F.when(F.col("volatility").isNull() | (F.col("volatility") == 0), "no_volatility"), F.when(F.col("max_drawdown") == 0, "no_drawdown")))
    return joined.withColumns({"calmar": F.col("cagr") / F.nullif(F.abs("max_drawdown"), F.lit(0.0)), "flags": flags})


def _with(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """A join of records; without keys both sides are one row each."""
    return a.join(b, list(by), "left") if by else a.crossJoin(F.broadcast(b))


def annual_returns(rets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rets.groupBy(*by, F.year("date").alias("year")).agg(stats.compound(F.col("ret")).alias("ret"), F.count("*").alias("days"))


def year_table(equity: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Year-end values and returns on the year-end before, or on the first value in the first year."""
    ends = equity.groupBy(*by, F.year("date").alias("year")).agg(F.max_by("value", "date").alias("value"), F.min_by("value", "date").alias("_open"))
    base = F.coalesce(F.lag("value").over(Window.partitionBy(*by).orderBy("year")), F.col("_open"))
    return ends.withColumn("ret", F.col("value") / base - 1).drop("_open")


def rolling_days(rets: DataFrame, days: int, least: int = 20, by: Sequence[str] = (), periods: int = 252, market: str | None = None) -> DataFrame:
    """Metrics of the last `days` rows by day; null below `least` observations."""
    return _rolling(rets, stats.rolling(list(by), "date", days), least, periods, market).withColumn("window", F.lit(f"{days}d"))


def _rolling(rets: DataFrame, window: Column, least: int, periods: int, market: str | None) -> DataFrame:
    n = F.count("ret").over(window)
    sd = F.stddev_samp("ret").over(window)
    guard = lambda x: F.when(n >= least, x)
    out = rets.withColumns({
        "observations": n, "total": guard(F.product(1 + F.col("ret")).over(window) - 1), "volatility": guard(sd * periods**0.5),
        "sharpe": guard(F.avg("ret").over(window) / F.nullif(sd, F.lit(0.0)) * periods**0.5),
    })
    if market:
        out = out.withColumn("beta", guard(F.covar_samp("ret", market).over(window) / F.nullif(F.var_samp(market).over(window), F.lit(0.0))))
    return out


def rolling_months(rets: DataFrame, months: int, least: int = 20, periods: int = 252) -> DataFrame:
    """Metrics over (date - months, date], the left end excluded, by day.

    A calendar window whose left end is open isn't a window frame. Each return goes to the later days that can see it:
    days are put into month buckets, a day looks at its own bucket and the `months` before, by an equi-join.
    """
    month = lambda c: F.year(c) * 12 + F.month(c)
    days = rets.select(F.col("date").alias("on"), F.explode(F.sequence(month("date") - months, month("date"))).alias("_m"))
    seen = rets.select("date", "ret", month("date").alias("_m"))
    inside = days.join(seen, "_m").where((F.col("date") <= F.col("on")) & (F.col("date") > F.add_months("on", -months)))
    guard = lambda x: F.when(F.count("ret") >= least, x)
    return inside.groupBy(F.col("on").alias("date")).agg(
        F.count("ret").alias("observations"), guard(stats.compound(F.col("ret"))).alias("total"), guard(stats.annualised_volatility(F.col("ret"), periods)).alias("volatility"),
        guard(F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * periods**0.5).alias("sharpe"),
    ).withColumn("window", F.lit(f"{months}m"))


@dataclass(frozen=True)
class RollingSpec:
    """A rolling window: days or months, not both, with at least two observations."""

    days: int | None = None
    months: int | None = None
    least: int = 20

    def __post_init__(self) -> None:
        if (self.days is None) == (self.months is None) or self.least < 2:
            raise ValueError("a window has days or months, and at least two observations")


def rolling_report(rets: DataFrame, specs: Sequence[RollingSpec]) -> DataFrame:
    """All windows below each other: date, window, observations, total, volatility, sharpe."""
    columns = ("date", "window", "observations", "total", "volatility", "sharpe")
    parts = [(rolling_days(rets, s.days, s.least) if s.days else rolling_months(rets, s.months, s.least)).select(*columns) for s in specs]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def benchmark_returns(bars: DataFrame, dividends: DataFrame, jump: float = 50.0) -> DataFrame:
    """Total returns of a benchmark, (close + dividend of the day) / previous close - 1, and a status in place of an
    error where the previous close isn't positive or the ratio is above `jump` or below its inverse."""
    paid = dividends.groupBy(F.col("ex_date").alias("date")).agg(F.sum("amount").alias("paid"))
    joined = bars.join(paid, "date", "left").na.fill(0.0, ["paid"]).withColumn("prev", F.lag("close").over(Window.orderBy("date")))
    ratio = (F.col("close") + F.col("paid")) / F.nullif(F.col("prev"), F.lit(0.0))
    status = F.when(F.col("prev") <= 0, "bad_previous").when((ratio > jump) | (ratio < 1 / jump), "bad_ratio").otherwise("ok")
    return joined.where(F.col("prev").isNotNull()).select("date", (ratio - 1).alias("ret"), status.alias("status"))


def relative_record(ours: DataFrame, theirs: DataFrame, periods: int = 252) -> DataFrame:
    """One record of returns against a benchmark's on the dates that both have."""
    both = ours.select("date", "ret").join(theirs.select("date", F.col("ret").alias("base")), "date").withColumn("active", F.col("ret") - F.col("base"))
    root = float(periods) ** 0.5
    found = both.agg(
        F.count("*").alias("observations"), (F.avg("active") * periods).alias("active_return"), (F.stddev_samp("active") * root).alias("tracking_error"),
        (F.avg("active") / F.nullif(F.stddev_samp("active"), F.lit(0.0)) * root).alias("information_ratio"), stats.beta(F.col("ret"), F.col("base")).alias("beta"),
        F.datediff(F.max("date"), F.min("date")).alias("_days"), F.sum(F.ln(1 + F.col("ret"))).alias("_a"), F.sum(F.ln(1 + F.col("base"))).alias("_b"),
    )
    years = F.nullif(F.col("_days") / F.lit(YEAR_DAYS), F.lit(0.0))
    return found.withColumn("excess_cagr", F.exp((F.col("_a") - F.col("_b")) / years) - 1).drop("_days", "_a", "_b")


def position_hit_rate(events: DataFrame) -> DataFrame:
    """The part of round trips, from flat to flat, that made money: trips, won, hit_rate. events: security_id, turn, quantity, cash."""
    order = Window.partitionBy("security_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    held = events.withColumn("held", F.sum("quantity").over(order))
    ended = F.coalesce(F.lag((F.col("held") == 0).cast("int")).over(Window.partitionBy("security_id").orderBy("turn")), F.lit(0))
    trips = held.withColumn("_ended", ended).withColumn("trip", F.sum("_ended").over(order))
    closed = trips.groupBy("security_id", "trip").agg(F.sum("cash").alias("cash"), F.max_by("held", "turn").alias("left")).where("left = 0")
    return closed.agg(F.count("*").alias("trips"), F.count_if(F.col("cash") > 0).alias("won"), F.avg((F.col("cash") > 0).cast("double")).alias("hit_rate"))


def realised_volatility(bars: DataFrame, window: int = 126, least: int = 21, periods: int = 252) -> DataFrame:
    """Each security's deviation of its last `window` returns; null below `least` of them."""
    last = Window.partitionBy("security_id").orderBy(F.desc("trade_date"))
    recent = bars.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= window + 1)
    rets = recent.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("security_id").orderBy("trade_date")) - 1).where("ret IS NOT NULL")
    return rets.groupBy("security_id").agg(F.count("*").alias("returns"), F.when(F.count("*") >= least, F.stddev_samp("ret") * float(periods) ** 0.5).alias("volatility"))


def window_mean_rate(rates: DataFrame, start: str, end: str, low: float = -0.02, high: float = 0.2) -> DataFrame:
    """The mean annual rate from start to end, both included, of the rates within a sane band; status no_rates without one."""
    inside = rates.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("annual_rate").between(low, high))
    return inside.agg(F.count("*").alias("days"), F.avg("annual_rate").alias("mean_rate")).withColumn("status", F.when(F.col("days") == 0, "no_rates").otherwise("ok"))
