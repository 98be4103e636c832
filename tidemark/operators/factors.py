"""Factors: window returns with a status ladder, fundamental ratios, cross-sectional transforms, composites, weights.

Every factor frame has security_id, status, value and warnings (array); only rows with status ok have a value, and
nothing is imputed. A frame may hold many cross-sections: `by` names the columns that tell them apart.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import unit_factor
from tidemark.operators.sessions import sessions_between
from tidemark.operators.temporal import Instant, asof_join, column

OK, NO_DATA, INSUFFICIENT, NOT_MEANINGFUL, NO_PROCEEDS = "ok", "no_data", "insufficient_data", "not_meaningful", "delisted_no_proceeds"
#: Most calendar days between a window's end and the bar that stands for it; least part of its sessions with a bar.
STALE_DAYS, COVERAGE = 15, 0.6
NOTES = "array<string>"
# The notes that rows carry.
SINGLE, CONSTANT, CLAMPED = "single-member cross-section for ", "constant cross-section for ", "winsorised from "
NO_SECTOR, NOT_NEUTRAL = "no sector: not neutralised", ": not neutralised"
MISSING, NEUTRAL, RENORMALISED = "missing ", "neutral for ", "renormalised over "
TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}


def transform(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a cross-sectional transform (frame, parameters) -> frame under a name of its own."""

    def register(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in TRANSFORMS:
            raise ValueError(f"transform {name} is registered twice")
        TRANSFORMS[name] = run
        return run

    return register


def window_return(ends: DataFrame, series: DataFrame, months: int, skip: int = 0, proceeds: DataFrame | None = None, value: str = "close", coverage: float = COVERAGE) -> DataFrame:
    """Returns over [end - months, end - skip] for every (security_id, end) of ends, by one ladder of statuses.

    Endpoints are bars at most STALE_DAYS old. Without one at the window's end, the proceeds (security_id, event_date,
    proceeds) of a security whose bars have ended stand in; unknown proceeds give delisted_no_proceeds. A window that
    has bars on less than `coverage` of its sessions is insufficient, unless proceeds were used.
    """
    turn = Window.partitionBy("security_id").orderBy("trade_date")
    bars = series.select("security_id", "trade_date", F.col(value).cast("double").alias("v"), F.row_number().over(turn).alias("n"))
    asked = ends.select("security_id", "end", F.add_months("end", -months).alias("window_start"), F.add_months("end", -skip).alias("window_end"))
    take = lambda p: {"trade_date": f"{p}_bar", "v": f"{p}_value", "n": f"{p}_n"}
    found = asof_join(asked, bars, ["security_id"], "window_start", "trade_date", take("start"), tolerance_days=STALE_DAYS)
    found = asof_join(found, bars, ["security_id"], "window_end", "trade_date", take("end"), tolerance_days=STALE_DAYS)
    last = bars.groupBy("security_id").agg(F.max("trade_date").alias("last_bar"))
    found = found.join(last, "security_id", "left")
    if proceeds is None:
        found = found.withColumns({"event_date": F.lit(None).cast("date"), "proceeds": F.lit(None).cast("double"), "_known": F.lit(False)})
    else:
        found = found.join(proceeds.select("security_id", "event_date", F.col("proceeds").cast("double").alias("proceeds"), F.lit(True).alias("_known")), "security_id", "left").na.fill(False, ["_known"])
    ended = F.col("end_bar").isNull() & (F.col("last_bar") < F.col("window_end")) & F.col("_known")
    used = ended & F.col("proceeds").isNotNull()
    found = found.withColumns({"used_proceeds": F.coalesce(used, F.lit(False)), "_ended": F.coalesce(ended, F.lit(False))})
    # the bars up to the event are counted by the last bar's number
    finish = F.when(F.col("used_proceeds"), F.least("event_date", "window_end")).otherwise(F.col("end_bar"))
    found = found.withColumns({"finish": finish, "finish_value": F.when(F.col("used_proceeds"), F.col("proceeds")).otherwise(F.col("end_value"))})
    found = found.withColumns({"expected": sessions_between("start_bar", "finish"), "observed": F.col("end_n") - F.col("start_n") + 1})
    status = (
        F.when(F.col("last_bar").isNull(), NO_DATA).when(F.col("start_bar").isNull(), INSUFFICIENT)
        .when(F.col("_ended") & F.col("proceeds").isNull(), NO_PROCEEDS).when(F.col("finish").isNull(), INSUFFICIENT)
        .when((F.col("start_value") <= 0) | (F.col("finish") <= F.col("start_bar")), INSUFFICIENT)
        .when(~F.col("used_proceeds") & (F.col("expected") > 0) & (F.col("observed") / F.col("expected") < coverage), INSUFFICIENT).otherwise(OK)
    )
    out = found.withColumn("status", status)
    return out.select("security_id", "end", "status", F.when(F.col("status") == OK, F.col("finish_value") / F.col("start_value") - 1).alias("value"), F.array().cast(NOTES).alias("warnings"), "start_bar", F.col("finish").alias("end_bar"), "used_proceeds")


def quote_units(bars: DataFrame) -> DataFrame:
    """(security_id, unit, warning): the unit of a security's first bar, and a warning if others occur."""
    found = bars.groupBy("security_id").agg(F.min_by("currency", "trade_date").alias("unit"), F.array_sort(F.collect_set("currency")).alias("_all"))
    return found.select("security_id", "unit", F.when(F.size("_all") > 1, F.concat(F.lit("several quote units: "), F.array_join("_all", ", "))).alias("warning"))


def action_proceeds(actions: DataFrame, units: DataFrame, known: Instant) -> DataFrame:
    """(security_id, event_date, proceeds, warning) of securities that ended, as known at an instant.

    The last merger with cash terms counts, in the security's quote unit (null with a warning where the currency is
    another's); otherwise the first delisting, worth 0 after a failure and unknown after any other reason.
    """
    paid = (F.col("action_type") == "merger") & F.col("amount").isNotNull()
    rows = actions.where((F.col("available_on") <= column(known)) & (paid | (F.col("action_type") == "delisting"))).withColumn("_paid", paid)
    order = Window.partitionBy("security_id").orderBy(F.desc("_paid"), F.when(paid, F.col("action_id")).desc(), "action_id")
    chosen = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").join(units.select("security_id", "unit"), "security_id", "left")
    cash = F.col("amount") * unit_factor(F.col("currency"), F.col("unit"))
    lost = F.concat("currency", F.lit(" isn't convertible to "), F.coalesce("unit", F.lit("an unknown unit")))
    value = F.when(F.col("_paid"), cash).when(F.col("reason") == "failure", F.lit(0.0))
    return chosen.select("security_id", F.col("ex_date").alias("event_date"), value.cast("double").alias("proceeds"), F.when(F.col("_paid") & cash.isNull(), lost).alias("warning"))


def return_over_volatility(returns: DataFrame, dispersion: DataFrame, least: int = 20, floor: float = 1e-6) -> DataFrame:
    """Window returns divided by the annualised deviation of the window's daily returns (security_id, end, n, sd)."""
    joined = returns.join(dispersion, ["security_id", "end"], "left")
    weak = F.coalesce(F.col("n") < least, F.lit(True)) | F.coalesce(F.col("sd") < floor, F.lit(True))
    status = F.when((F.col("status") == OK) & weak, INSUFFICIENT).otherwise(F.col("status"))
    return joined.withColumn("_s", status).select("security_id", "end", F.col("_s").alias("status"), F.when(F.col("_s") == OK, F.col("value") / F.col("sd")).alias("value"), "warnings")


def window_dispersion(ends: DataFrame, returns: DataFrame, months: int, skip: int = 0, periods: int = 252) -> DataFrame:
    """(security_id, end, n, sd): the deviation of daily returns within the window, by buckets of months."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    asked = ends.select("security_id", "end", F.add_months("end", -months).alias("_a"), F.add_months("end", -skip).alias("_z"))
    asked = asked.withColumn("_m", F.explode(F.sequence(month("_a"), month("_z"))))
    inside = asked.join(returns.withColumn("_m", month("trade_date")), ["security_id", "_m"]).where((F.col("trade_date") > F.col("_a")) & (F.col("trade_date") <= F.col("_z")))
    return inside.groupBy("security_id", "end").agg(F.count("ret").alias("n"), (F.stddev_samp("ret") * float(periods) ** 0.5).alias("sd"))


def fundamental_ratio(wide: DataFrame, numerator: Sequence[str], denominator: Sequence[str], minus: Sequence[str] = ()) -> DataFrame:
    """(sum of numerator - sum of minus) / sum of denominator; a denominator not above zero is not meaningful."""
    total = lambda names: reduce(Column.__add__, [F.col(n) for n in names], F.lit(0.0))
    over, under = total(numerator) - total(minus), total(denominator)
    status = F.when(over.isNull() | under.isNull(), NO_DATA).when(under <= 0, NOT_MEANINGFUL).otherwise(OK)
    return wide.select("security_id", status.alias("status"), F.when(status == OK, over / F.nullif(under, F.lit(0.0))).alias("value"), F.array().cast(NOTES).alias("warnings"))


def roic(wide: DataFrame) -> DataFrame:
    """ebit after a tax rate held within 0 and 1, over equity and net debt."""
    rate = F.when(F.col("pretax") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("tax") / F.nullif(F.col("pretax"), F.lit(0.0))))).otherwise(0.0)
    capital = F.col("equity") + F.col("net_debt")
    status = F.when(F.col("ebit").isNull() | capital.isNull() | F.col("tax").isNull(), NO_DATA).when(capital <= 0, NOT_MEANINGFUL).otherwise(OK)
    return wide.select("security_id", status.alias("status"), F.when(status == OK, F.col("ebit") * (1 - rate) / F.nullif(capital, F.lit(0.0))).alias("value"), F.array().cast(NOTES).alias("warnings"))


def earnings_stability(values: DataFrame, least: int = 3) -> DataFrame:
    """- sample deviation / |mean| of (security_id, value) rows; few values are insufficient, a mean near zero not meaningful."""
    found = values.groupBy("security_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    status = F.when(F.col("n") < least, INSUFFICIENT).when(F.abs("mean") < 1e-6, NOT_MEANINGFUL).otherwise(OK)
    return found.select("security_id", status.alias("status"), F.when(status == OK, -F.col("sd") / F.abs("mean")).alias("value"), F.array().cast(NOTES).alias("warnings"))


def market_value_yield(figures: DataFrame, *, use_ev: bool = False, negate: bool = False, refuse_negative: bool = False) -> DataFrame:
    """A figure over market capitalisation, or enterprise value: figure, price, shares, net_debt by security_id."""
    cap = F.col("price") * F.col("shares")
    base = cap + F.coalesce("net_debt", F.lit(0.0)) if use_ev else cap
    figure = -F.col("figure") if negate else F.col("figure")
    status = F.when(F.col("figure").isNull() | cap.isNull(), NO_DATA).when(base <= 0, NOT_MEANINGFUL)
    status = status.when(figure < 0, NOT_MEANINGFUL).otherwise(OK) if refuse_negative else status.otherwise(OK)
    return figures.select("security_id", status.alias("status"), F.when(status == OK, figure / F.nullif(base, F.lit(0.0))).alias("value"), F.array().cast(NOTES).alias("warnings"))


def _over(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by)


def _beside(frame: DataFrame, by: Sequence[str], found: Mapping[str, Column]) -> DataFrame:
    """The frame with aggregates of each row's cross-section. Without `by` that is the whole frame: a window would bring
    all rows to one task, so they are aggregated to one row, which is joined back."""
    if by:
        return frame.withColumns({name: column.over(_over(by)) for name, column in found.items()})
    return frame.crossJoin(F.broadcast(frame.agg(*[column.alias(name) for name, column in found.items()])))


def _measured(frame: DataFrame, by: Sequence[str], found: Mapping[str, Column] | None = None) -> DataFrame:
    """The frame with x (the value of ok rows) and the cross-section's count, least and greatest x, and what else is asked."""
    x = F.when(F.col("status") == OK, F.col("value"))
    return _beside(frame.withColumn("_x", x), by, {"_n": F.count("_x"), "_lo": F.min("_x"), "_hi": F.max("_x"), **(found or {})})


def _standardised(measured: DataFrame, value: Column, label: str, extra: Sequence[str] = ()) -> DataFrame:
    """Replaces ok values; a cross-section of one value, or without spread, is not meaningful."""
    ok = F.col("status") == OK
    note = F.when(F.col("_n") == 1, F.lit(SINGLE + label)).when(F.col("_hi") == F.col("_lo"), F.lit(CONSTANT + label))
    status = F.when(ok & note.isNotNull(), NOT_MEANINGFUL).when(ok & value.isNull(), NOT_MEANINGFUL).otherwise(F.col("status"))
    notes = F.when(ok & note.isNotNull(), F.concat("warnings", F.array(note))).otherwise(F.col("warnings"))
    return measured.withColumns({"status": status, "value": F.when(status == OK, value), "warnings": notes}).drop("_x", "_n", "_lo", "_hi", *extra)


@transform("winsorise")
def winsorise(frame: DataFrame, by: Sequence[str] = (), *, lower: float, upper: float) -> DataFrame:
    """Clamps ok values to the two linear percentiles, with a note where that changes one; below two values nothing."""
    if not 0 <= lower < upper <= 100:
        raise ValueError(f"bad percentiles [{lower}, {upper}]")
    found = _measured(frame, by, {"_p": F.percentile("_x", [lower / 100, upper / 100])})
    clamped = F.greatest(F.least("_x", F.col("_p")[1]), F.col("_p")[0])
    moved = (F.col("_n") >= 2) & (F.col("status") == OK) & (clamped != F.col("_x"))
    notes = F.when(moved, F.concat("warnings", F.array(F.concat(F.lit(CLAMPED), F.format_string("%.6g", "_x"))))).otherwise(F.col("warnings"))
    return found.withColumns({"value": F.when(moved, clamped).otherwise(F.col("value")), "warnings": notes}).drop("_x", "_n", "_lo", "_hi", "_p")


@transform("zscore")
def zscore(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(value - mean) / sample deviation."""
    found = _measured(frame, by, {"_m": F.avg("_x"), "_d": F.stddev_samp("_x")})
    return _standardised(found, (F.col("_x") - F.col("_m")) / F.nullif(F.col("_d"), F.lit(0.0)), "zscore", ["_m", "_d"])


@transform("zscore_robust")
def zscore_robust(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(value - median) / (1.4826 * median absolute deviation); a deviation of zero is not meaningful."""
    found = _measured(frame, by, {"_m": F.percentile("_x", 0.5)})
    found = _beside(found, by, {"_d": F.percentile(F.abs(F.col("_x") - F.col("_m")), 0.5)})
    return _standardised(found, (F.col("_x") - F.col("_m")) / F.nullif(F.col("_d") * 1.4826, F.lit(0.0)), "zscore_robust", ["_m", "_d"])


@transform("rank_percentile")
def rank_percentile(frame: DataFrame, by: Sequence[str] = (), *, ties: str = "average") -> DataFrame:
    """(rank - 0.5) / n with ties at the average, least or greatest of their ranks."""
    found = _measured(frame, by)
    low = F.rank().over(Window.partitionBy(*by, F.col("_x").isNull()).orderBy("_x"))
    same = F.count("_x").over(Window.partitionBy(*by, "_x"))
    rank = {"average": low + (same - 1) / 2, "min": low.cast("double"), "max": (low + same - 1).cast("double")}[ties]
    return _standardised(found.withColumn("_r", (rank - 0.5) / F.nullif(F.col("_n"), F.lit(0))), F.col("_r"), "rank_percentile", ["_r"])


@transform("sector_neutralise")
def sector_neutralise(frame: DataFrame, by: Sequence[str] = (), *, sector: str = "sector", least: int = 4) -> DataFrame:
    """Values less their sector's mean; without a sector, or in one of fewer than `least` values, they pass with a note."""
    group = Window.partitionBy(*by, sector, F.col("status") == OK)
    ok, size = F.col("status") == OK, F.count("value").over(group)
    note = F.when(F.col(sector).isNull(), F.lit(NO_SECTOR)).when(F.col("_size") < least, F.concat(F.lit("sector "), F.col(sector).cast("string"), F.lit(" has "), F.col("_size").cast("string"), F.lit(f" < {least}{NOT_NEUTRAL}")))
    found = frame.withColumns({"_size": size, "_mean": F.avg("value").over(group)})
    return found.withColumns({
        "value": F.when(ok & note.isNull(), F.col("value") - F.col("_mean")).otherwise(F.col("value")), "warnings": F.when(ok & note.isNotNull(), F.concat("warnings", F.array(note))).otherwise(F.col("warnings")),
    }).drop("_size", "_mean")


@dataclass(frozen=True)
class Component:
    """A part of a composite: its label, weight, and 1 or -1 for the direction in which it counts as good."""

    label: str
    weight: float = 1.0
    direction: int = 1

    def __post_init__(self) -> None:
        if self.direction not in (1, -1):
            raise ValueError("a direction is 1 or -1")


def composite(universe: DataFrame, parts: Mapping[str, DataFrame], components: Sequence[Component], *, standardise: str = "zscore", winsorised: tuple[float, float] | None = None, policy: str = "renormalise", least: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A weighted mean of standardised components for every security of the universe.

    Each component is winsorised if asked, standardised over its whole cross-section, and turned. Where some are
    missing: drop gives no_data, renormalise leaves them out, neutral counts them as 0. Fewer than `least` present
    components are insufficient, and a total weight of zero is not meaningful.
    """
    if policy not in ("drop", "renormalise", "neutral") or not components or sum(c.weight for c in components) == 0:
        raise ValueError("a composite needs components whose weights don't sum to zero, and a known policy")
    keys, frame = ["security_id", *by], universe.select("security_id", *by).distinct()
    for k, c in enumerate(components):
        part = parts[c.label]
        if winsorised:
            part = winsorise(part, by, lower=winsorised[0], upper=winsorised[1])
        done = TRANSFORMS[standardise](part, by).where(F.col("status") == OK)
        frame = frame.join(done.select(*keys, (F.col("value") * c.direction).alias(f"_c{k}")), keys, "left")
    values = [F.col(f"_c{k}") for k in range(len(components))]
    has = [v.isNotNull().cast("int") for v in values]
    present = reduce(Column.__add__, has)
    lost = F.array_compact(F.array(*[F.when(v.isNull(), F.lit(c.label)) for v, c in zip(values, components, strict=True)]))
    counted = F.lit(len(components)) if policy == "neutral" else present
    weight = reduce(Column.__add__, [F.lit(abs(c.weight)) * (F.lit(1) if policy == "neutral" else h) for c, h in zip(components, has, strict=True)])
    score = reduce(Column.__add__, [F.lit(float(c.weight)) * F.coalesce(v, F.lit(0.0)) for v, c in zip(values, components, strict=True)])
    frame = frame.withColumns({"_present": present, "_counted": counted, "_lost": lost, "_weight": weight, "_score": score})
    status = F.when((F.size("_lost") > 0) & F.lit(policy == "drop"), NO_DATA).when(F.col("_counted") < (least or len(components)), INSUFFICIENT).when(F.col("_weight") == 0, NOT_MEANINGFUL).otherwise(OK)
    said = {"drop": F.concat(F.lit(MISSING), F.array_join("_lost", ";")), "neutral": F.concat(F.lit(NEUTRAL), F.array_join("_lost", ";")), "renormalise": F.concat(F.lit(RENORMALISED), F.col("_present").cast("string"))}[policy]
    notes = F.when(F.size("_lost") > 0, F.array(said)).otherwise(F.array().cast(NOTES))
    return frame.withColumn("status", status).select(*keys, "status", F.when(F.col("status") == OK, F.col("_score") / F.nullif(F.col("_weight"), F.lit(0.0))).alias("value"), notes.alias("warnings"))


def tagged(frame: DataFrame, factor: str, version: int, versions: Mapping[str, str]) -> DataFrame:
    """A frame with its factor, version and the sorted k=v; list of its inputs' versions."""
    return frame.withColumns({"factor": F.lit(factor), "factor_version": F.lit(version), "input_versions": F.lit("".join(f"{k}={v};" for k, v in sorted(versions.items())))})


def select_top(scores: DataFrame, rule: str, *, by: Sequence[str] = (), n: int = 20, threshold: float | None = None, most: int | None = None) -> DataFrame:
    """The best scores, ties by security_id: top_n, top_decile (at least one) or threshold; then at most `most`."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "security_id")
    ranked = scores.withColumn("rank", F.row_number().over(order)).withColumn("_of", F.count("*").over(_over(by)))
    if rule == "threshold" and threshold is None:
        raise ValueError("a threshold rule needs a threshold")
    keep = {"top_n": F.col("rank") <= n, "top_decile": F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("_of") / 10)), "threshold": F.col("score") >= F.lit(threshold)}[rule]
    chosen = ranked.where(keep).drop("_of")
    return chosen.where(F.col("rank") <= most) if most is not None else chosen


def equal_weights(selected: DataFrame, invested: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    return selected.withColumn("weight", F.lit(invested) / F.count("*").over(_over(by)))


def score_weights(selected: DataFrame, policy: str, invested: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Weights in proportion to rank (1 for the worst), to the score above the least (equal if all agree), or to
    positive scores alone."""
    if policy == "positive_only":
        selected = selected.where("score > 0")
        share = F.col("score")
    elif policy == "shift":
        low, high = F.min("score").over(_over(by)), F.max("score").over(_over(by))
        share = F.when(low == high, F.lit(1.0)).otherwise(F.col("score") - low)
    elif policy == "rank":
        share = F.row_number().over(Window.partitionBy(*by).orderBy("score", F.desc("security_id"))).cast("double")
    else:
        raise ValueError(f"unknown policy {policy}")
    return selected.withColumn("_share", share).withColumn("weight", F.lit(invested) * F.col("_share") / F.sum("_share").over(_over(by))).drop("_share")


def inverse_volatility_weights(selected: DataFrame, invested: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Weights in proportion to 1 / volatility; rows without a positive one fall out."""
    usable = selected.where("volatility > 0").withColumn("_i", 1 / F.col("volatility"))
    return usable.withColumn("weight", F.lit(invested) * F.col("_i") / F.sum("_i").over(_over(by))).drop("_i")


def capped(weights: DataFrame, most: float, by: Sequence[str] = ()) -> DataFrame:
    """Weights under a cap, the excess shared among the others in proportion until none exceeds it.

    Found directly: in descending order, with k weights at the cap the others are scaled by (total - k * cap) / their
    sum; k is the least for which the next weight then fits. Infeasible caps give null weights.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), "security_id")
    w = weights.withColumns({
        "_k": F.row_number().over(order) - 1, "_total": F.sum("weight").over(_over(by)), "_n": F.count("*").over(_over(by)),
        "_rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    scale = (F.col("_total") - F.col("_k") * most) / F.nullif(F.col("_rest"), F.lit(0.0))
    w = w.withColumn("_scale", scale).withColumn("_fits", F.col("weight") * F.col("_scale") <= most + 1e-12)
    w = w.withColumn("_at", F.min(F.when(F.col("_fits"), F.struct("_k", "_scale"))).over(_over(by)))
    weight = F.when(F.col("_n") * most < F.col("_total") - 1e-12, F.lit(None)).when(F.col("_at").isNull() | (F.col("_k") < F.col("_at._k")), F.lit(most)).otherwise(F.col("weight") * F.col("_at._scale"))
    return w.withColumn("weight", weight).drop("_k", "_total", "_n", "_rest", "_scale", "_fits", "_at")


def target_shares(weights: DataFrame, value: Column, price: str = "price") -> DataFrame:
    """floor(weight * value / price), for names with a positive price and at least one share."""
    return weights.where(F.col(price) > 0).withColumn("shares", F.floor(F.col("weight") * value / F.col(price)).cast("long")).where("shares > 0")


def turnover(fills: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(buys + sells) / 2 over the value before trading (its column: value_before)."""
    found = fills.groupBy(*by).agg(F.sum(F.abs("quantity") * F.col("price")).alias("traded"), F.max("value_before").alias("_v"), F.count("*").alias("trades"))
    return found.withColumn("turnover", F.when(F.col("_v") > 0, F.col("traded") / 2 / F.col("_v")).otherwise(0.0)).drop("_v")


@dataclass(frozen=True)
class Costs:
    """Trading costs in basis points; commission has a least amount."""

    commission_bps: float = 2.0
    commission_min: float = 500.0
    spread_bps: float = 10.0
    stamp_bps: float = 50.0
    impact_bps: float = 25.0


def trade_costs(trades: DataFrame, costs: Costs, exempt: Column | None = None) -> DataFrame:
    """commission, spread, stamp, impact and total of trades (side, notional, median_traded). Stamp duty is on purchases
    that aren't exempt; without evidence of liquidity a trade counts as the whole volume."""
    n, bps = F.col("notional"), 1e-4
    stamp = (F.col("side") == "buy") & ~(exempt if exempt is not None else F.lit(False))
    part = F.when(F.col("median_traded") > 0, n / F.col("median_traded")).otherwise(1.0)
    out = trades.withColumns({
        "commission": F.greatest(n * (costs.commission_bps * bps), F.lit(costs.commission_min)), "spread": n * (costs.spread_bps / 2 * bps),
        "stamp": F.when(stamp, n * (costs.stamp_bps * bps)).otherwise(0.0), "impact": n * (costs.impact_bps * bps) * part,
    })
    return out.withColumn("total", F.col("commission") + F.col("spread") + F.col("stamp") + F.col("impact"))
