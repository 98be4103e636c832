"""Daily bars: returns, adjustment for corporate actions, unit repair and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import upper_median
from tidemark.operators.temporal import asof_join, band_join

#: Most days between an action and the bar before it.
ANCHOR_DAYS = 7
#: The share ratios that a one-day move is compared with, and how near it must come.
EVENT_RATIOS = (2.0, 0.5, 3.0, 1 / 3, 4.0, 0.25, 5.0, 0.2, 10.0, 0.1, 1.5, 2 / 3, 100.0, 0.01)
RATIO_TOLERANCE = 0.02


def series(*by: str) -> Window:
    return Window.partitionBy(*(by or ("security_id",))).orderBy("trade_date")


def daily_returns(bars: DataFrame, value: str = "close") -> DataFrame:
    """Simple returns from bar to bar; the first bar of a security has none."""
    prev = F.lag(value).over(series())
    return bars.withColumn("ret", F.col(value) / F.nullif(prev, F.lit(0.0)) - 1).where(F.col("ret").isNotNull())


def anchored(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """Actions with the close of the bar strictly before ex_date, and a status instead of an error where it is missing
    or older than ANCHOR_DAYS."""
    found = asof_join(actions, bars.select("security_id", "trade_date", "close"), ["security_id"], "ex_date", "trade_date", {"trade_date": "prev_date", "close": "prev_close"}, strict=True)
    status = F.when(F.col("prev_date").isNull(), "no_previous_bar").when(F.datediff("ex_date", "prev_date") > ANCHOR_DAYS, "stale_previous_bar").otherwise("ok")
    return found.withColumn("anchor_status", status)


def event_factors(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """(security_id, ex_date, split_factor, dividend_factor, unanchored): products of old / new shares, and of
    1 - dividend / base for each dividend of the day.

    Splits of a day come before its dividends, whose base is the previous close in post-split terms; a split needs no
    previous bar. A dividend not below its base gives no factor. A dividend whose previous bar is too old gives none
    either, and its day is marked unanchored: what is adjusted over it is incomplete.
    """
    day = Window.partitionBy("security_id", "ex_date")
    kind = F.col("action_type")
    found = anchored(actions, bars).withColumn("split_factor", F.product(F.when(kind == "split", F.col("old_shares") / F.col("new_shares")).otherwise(1.0)).over(day))
    base = F.col("prev_close") * F.col("split_factor")
    counts = (kind == "dividend") & (F.col("anchor_status") == "ok") & (F.col("amount") > 0) & (F.col("amount") < base)
    return found.groupBy("security_id", "ex_date").agg(
        F.max("split_factor").alias("split_factor"), F.product(F.when(counts, 1 - F.col("amount") / base).otherwise(1.0)).alias("dividend_factor"),
        F.bool_or((kind == "dividend") & (F.col("anchor_status") == "stale_previous_bar")).alias("unanchored"),
    )


def adjustment_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Each bar with the product of the factors of all later events; a security's last bar has 1. incomplete: a later
    dividend had no previous bar near enough, so its factor is missing.

    The factors of the days between two bars are put on the later bar, and one window from the last bar backwards
    multiplies them: one shuffle, no join of bars with all later events.
    """
    events = event_factors(actions, bars)
    on_bar = asof_join(events, bars.select("security_id", "trade_date"), ["security_id"], "ex_date", "trade_date", {"trade_date": "bar_date"}, forward=True)
    on_bar = on_bar.where("bar_date IS NOT NULL").groupBy("security_id", F.col("bar_date").alias("trade_date")).agg(F.product("split_factor").alias("own_split"), F.product("dividend_factor").alias("own_dividend"), F.bool_or("unanchored").alias("own_gap"))
    later = series().rowsBetween(1, Window.unboundedFollowing)
    joined = bars.join(on_bar, ["security_id", "trade_date"], "left").na.fill(1.0, ["own_split", "own_dividend"])
    return joined.withColumns({
        "split_factor": F.coalesce(F.product("own_split").over(later), F.lit(1.0)), "dividend_factor": F.coalesce(F.product("own_dividend").over(later), F.lit(1.0)),
        "incomplete": F.coalesce(F.bool_or("own_gap").over(later), F.lit(False)),
    }).drop("own_split", "own_dividend", "own_gap")


def adjusted(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars with the split-adjusted and the fully adjusted close."""
    found = adjustment_factors(bars, actions)
    split = F.col("close") * F.col("split_factor")
    return found.withColumns({"split_adjusted": split, "adjusted": split * F.col("dividend_factor")})


def single_bar_spikes(bars: DataFrame) -> DataFrame:
    """Bars more than 8 times or less than an eighth of the previous one, when the next is near the previous again."""
    prev, nxt = F.lag("close").over(series()), F.lead("close").over(series())
    ratio, back = F.col("close") / prev, nxt / prev
    return bars.withColumn("spike", F.coalesce(((ratio > 8) | (ratio < 1 / 8)) & (back > 0.5) & (back < 2), F.lit(False)))


def invalid_bars(bars: DataFrame) -> DataFrame:
    """Bars with a price that is null or not positive, a null or negative volume, or an order that can't be."""
    wrong = reduce(Column.__or__, [F.col(c).isNull() | (F.col(c) <= 0) for c in ("open", "high", "low", "close")])
    shape = (F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "close"))
    return bars.where(wrong | F.col("volume").isNull() | (F.col("volume") < 0) | shape)


def extreme_moves(bars: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Closes at least 1 + threshold or at most 1 - threshold times the previous one, limits included, by products
    instead of quotients; with the event ratio that the move is within RATIO_TOLERANCE of, the first in order."""
    prev = F.lag("close").over(series())
    hit = bars.withColumn("prev_close", prev).where((F.col("close") >= F.col("prev_close") * (1 + threshold)) | (F.col("close") <= F.col("prev_close") * (1 - threshold)))
    ratio = F.col("close") / F.col("prev_close")
    near = F.filter(F.array(*[F.lit(r) for r in EVENT_RATIOS]), lambda r: F.abs(ratio / r - 1) <= RATIO_TOLERANCE)
    return hit.withColumn("event_ratio", F.when(F.size(near) > 0, near[0]))


def unexplained_moves(bars: DataFrame, actions: DataFrame, threshold: float = 0.5, days: int = 3) -> DataFrame:
    """Extreme moves without a split within `days`."""
    moves = extreme_moves(bars, threshold).select("security_id", "trade_date", "close", "prev_close")
    return band_join(moves, actions.where("action_type = 'split'").select("security_id", "ex_date"), ["security_id"], "trade_date", "ex_date", days, "left_anti")


def runs(bars: DataFrame, changed: Column) -> DataFrame:
    """Numbers the stretches of a security's bars between changes."""
    flag = F.coalesce(changed, F.lit(True)).cast("int")
    return bars.withColumn("_changed", flag).withColumn("run", F.sum("_changed").over(series().rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def stale_runs(bars: DataFrame, value: str = "close", least: int = 5) -> DataFrame:
    """Runs of at least `least` equal values; an error if all of the run had no volume."""
    found = runs(bars, F.col(value) != F.lag(value).over(series()))
    run = found.groupBy("security_id", "run").agg(F.min("trade_date").alias("start"), F.max("trade_date").alias("end"), F.count("*").alias("bars"), F.max("volume").alias("_most"))
    return run.where(F.col("bars") >= least).select("security_id", "start", "end", "bars", F.when(F.col("_most") == 0, "error").otherwise("warning").alias("severity"))


def low_volume_runs(bars: DataFrame, limit: int = 0, least: int = 1) -> DataFrame:
    """Runs of bars whose volume doesn't exceed the limit."""
    low = F.col("volume") <= limit
    found = runs(bars.withColumn("_low", low), low != F.lag(low).over(series())).where("_low")
    return found.groupBy("security_id", "run").agg(F.min("trade_date").alias("start"), F.max("trade_date").alias("end"), F.count("*").alias("bars")).where(F.col("bars") >= least).drop("run")


def volume_outliers(bars: DataFrame, times: float = 20.0, window: int = 21, least: int = 10) -> DataFrame:
    """Volumes above `times` the floored median of the previous `window` bars, if there are `least` of them."""
    before = series().rowsBetween(-window, -1)
    rated = bars.withColumn("median_volume", F.floor(F.percentile("volume", 0.5).over(before))).withColumn("_n", F.count("volume").over(before))
    return rated.where((F.col("_n") >= least) & (F.col("volume") > F.col("median_volume") * times)).drop("_n")


def unit_flips(bars: DataFrame) -> DataFrame:
    """Scales for series that jump between units: a jump by 70 to 140 or its inverse shifts the scale by 100; a scale
    other than 1/100, 1 and 100 leaves the security unresolved."""
    ratio = F.col("close") / F.lag("close").over(series())
    step = F.when(ratio.between(70, 140), -1).when(ratio.between(1 / 140, 1 / 70), 1).otherwise(0)
    summed = bars.withColumn("_step", step).withColumn("shift", F.sum("_step").over(series().rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
    lost = F.max(F.abs("shift")).over(Window.partitionBy("security_id")) > 1
    return summed.withColumn("scale", F.pow(F.lit(100.0), F.col("shift"))).withColumn("resolved", ~lost)


def unit_classes(bars: DataFrame, dividends: DataFrame, adjudicated: DataFrame | None = None) -> DataFrame:
    """(security_id, scale, verdict): whether a security is quoted in major units and must be scaled by 100.

    An adjudicated scale counts first. Else the median yearly dividend yield, from two years on, speaks: above 0.30 the
    price is in major units. Without that, an upper median close below 25 does. A yield of at most 0.15 together with
    such a price is a conflict and stays unresolved. All others keep their scale.
    """
    level = bars.groupBy("security_id").agg(upper_median(F.col("close")).alias("typical"))
    yearly = dividends.groupBy("security_id", F.year("ex_date").alias("y")).agg(F.sum("amount").alias("paid"))
    price = bars.groupBy("security_id", F.year("trade_date").alias("y")).agg(upper_median(F.col("close")).alias("of_year"))
    yields = yearly.join(price, ["security_id", "y"]).groupBy("security_id").agg(F.count("*").alias("years"), upper_median(F.col("paid") / F.col("of_year")).alias("dividend_yield"))
    rated = level.join(yields, "security_id", "left").withColumn("dividend_yield", F.when(F.col("years") >= 2, F.col("dividend_yield")))
    rated = rated.join(adjudicated.withColumnRenamed("scale", "_set"), "security_id", "left") if adjudicated is not None else rated.withColumn("_set", F.lit(None).cast("double"))
    low = F.col("typical") < 25
    y = F.col("dividend_yield")
    verdict = F.when(F.col("_set").isNotNull(), "adjudicated").when(y > 0.30, "yield").when((y <= 0.15) & low, "conflict").when(y.isNull() & low, "price").otherwise("unchanged")
    rated = rated.withColumn("verdict", verdict)
    scale = F.when(F.col("verdict") == "adjudicated", F.col("_set")).when(F.col("verdict").isin("yield", "price"), 100.0).when(F.col("verdict") == "conflict", F.lit(None).cast("double")).otherwise(1.0)
    return rated.select("security_id", scale.alias("scale"), "verdict")


def apply_scales(bars: DataFrame, scales: DataFrame) -> DataFrame:
    """Prices times their scale, rounded to six places; volumes stay."""
    joined = bars.join(scales.select("security_id", "scale"), "security_id")
    return joined.withColumns({c: F.round(F.col(c) * F.col("scale"), 6) for c in ("open", "high", "low", "close")}).drop("scale")


def split_audit(splits: DataFrame, bars: DataFrame, near: float = 1.25, far: float = 1.35) -> DataFrame:
    """Whether prices show a split: the ratio of the last bar before to the first bar on or after ex_date.

    REAL if it is within `near` of the split's own ratio, PRE_APPLIED if within `near` of 1; SMALL_UNVERIFIABLE if the
    split's ratio is itself below `far`; NO_PRICE_CONTEXT without both bars; else UNCLEAR. All in logarithms.
    """
    price = bars.select("security_id", "trade_date", "close")
    found = asof_join(splits, price, ["security_id"], "ex_date", "trade_date", {"close": "before"}, strict=True)
    found = asof_join(found, price, ["security_id"], "ex_date", "trade_date", {"close": "after"}, forward=True)
    ratio, own = F.ln(F.col("before") / F.col("after")), F.ln(F.col("new_shares") / F.col("old_shares"))
    lim, small = F.ln(F.lit(near)), F.ln(F.lit(far))
    verdict = (
        F.when(F.col("before").isNull() | F.col("after").isNull(), "NO_PRICE_CONTEXT")
        .when(F.abs(own) < small, "SMALL_UNVERIFIABLE").when(F.abs(ratio - own) <= lim, "REAL").when(F.abs(ratio) <= lim, "PRE_APPLIED").otherwise("UNCLEAR")
    )
    return found.withColumn("verdict", verdict)
