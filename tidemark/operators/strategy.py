"""Factor definitions, their materialisation over month ends, and backtests from scores to a ledger."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import factors, ledger, prices
from tidemark.operators.experiments import content_hash
from tidemark.operators.temporal import asof_join


@dataclass(frozen=True)
class Definition:
    """A factor: a name, a version, a registered computation and its parameters."""

    name: str
    version: int
    computation: str
    parameters: Mapping[str, object] = field(default_factory=dict)

    @property
    def digest(self) -> str:
        """The hash of what it means; notes and names of files don't count."""
        return content_hash({"name": self.name, "version": self.version, "computation": self.computation, "parameters": dict(self.parameters)})


class Definitions:
    """A closed registry of definitions by name and version; a changed meaning needs a new version."""

    def __init__(self, definitions: Sequence[Definition] = ()) -> None:
        self._held: dict[tuple[str, int], Definition] = {}
        for d in definitions:
            self.add(d)

    def add(self, definition: Definition) -> None:
        held = self._held.setdefault((definition.name, definition.version), definition)
        if held.digest != definition.digest:
            raise ValueError(f"{definition.name} {definition.version} is defined twice")

    def get(self, name: str, version: int | None = None) -> Definition:
        versions = [v for n, v in self._held if n == name]
        if not versions or version is not None and version not in versions:
            raise KeyError(f"no definition of {name} {version or ''}")
        return self._held[name, max(versions) if version is None else version]

    @classmethod
    def loads(cls, text: str) -> Definitions:
        return cls([Definition(d["name"], d["version"], d["computation"], d.get("parameters", {})) for d in json.loads(text)])


COMPUTATIONS = {
    "window_return": lambda ends, series, p: factors.window_return(ends, series, p["months"], p.get("skip", 0), value=p.get("value", "close"), coverage=p.get("coverage", factors.COVERAGE)),
    "return_over_volatility": lambda ends, series, p: factors.return_over_volatility(
        factors.window_return(ends, series, p["months"], p.get("skip", 0), value=p.get("value", "close"), coverage=p.get("coverage", factors.COVERAGE)),
        factors.window_dispersion(ends, prices.daily_returns(series, p.get("value", "close")).select("security_id", "trade_date", "ret"), p["months"], p.get("skip", 0)),
    ),
}


def materialised(definitions: Sequence[Definition], ends: DataFrame, series: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Values of all definitions at all ends in one plan: name, version, security_id, end, status, value. done: the
    (name, version, end) that are stored already and left out."""
    found = None
    for d in definitions:
        asked = ends
        if done is not None:
            own = done.where((F.col("name") == d.name) & (F.col("version") == d.version)).select("end").distinct()
            asked = ends.join(own, "end", "left_anti")
        values = COMPUTATIONS[d.computation](asked, series, d.parameters).select(F.lit(d.name).alias("name"), F.lit(d.version).alias("version"), "security_id", "end", "status", "value")
        found = values if found is None else found.unionByName(values)
    if found is None:
        raise ValueError("no definitions")
    return found


def decisions(values: DataFrame, sessions: DataFrame, n: int, run_id: str) -> DataFrame:
    """(run_id, on, clock, security_id, weight): the best n of each end, equally weighted, traded on the first session
    after the end, so that a decision never sees the day it trades on."""
    chosen = factors.equal_weights(factors.select_top(values.where("status = 'ok'").withColumnRenamed("value", "score"), "top_n", by=["end"], n=n), by=["end"])
    ends = chosen.select("end").distinct()
    following = ends.join(sessions, F.col("session") > F.col("end")).groupBy("end").agg(F.min("session").alias("on"))  # both sides are lists of days
    return chosen.join(following, "end").select(F.lit(run_id).alias("run_id"), "on", F.col("end").alias("clock"), "security_id", "weight")


def day_plans(targets: DataFrame, bars: DataFrame, actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """The days of each run as the ledger takes them: (run_id, on, payload).

    Only names that a run ever targets are followed. Marks are the last closes, prints the closes of the day with the
    median traded value of 60 bars, sizes the closes known at the clock; actions apply on the later of ex_date and the
    day they were known. Everything is joined by name and day; nothing here depends on the ledger.
    """
    traded = bars.withColumn("liquidity", F.percentile(F.col("close") * F.col("volume"), 0.5).over(prices.series().rowsBetween(-59, 0))).select("security_id", "trade_date", "close", "liquidity")
    runs = targets.groupBy("run_id").agg(F.min("on").alias("_start"))
    days = runs.join(F.broadcast(sessions), F.col("session") >= F.col("_start")).select("run_id", F.col("session").alias("on"))
    names = targets.select("run_id", "security_id").distinct()
    marks = asof_join(days.join(names, "run_id"), traded, ["security_id"], "on", "trade_date", {"trade_date": "last", "close": "close", "liquidity": "liquidity"}).where("last IS NOT NULL")
    text = lambda c: F.col(c).cast("decimal(38,6)").cast("string")
    by_day = marks.groupBy("run_id", "on").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("security_id").cast("string"), F.array(F.col("last").cast("string"), text("close"))))).alias("marks"),
        F.map_from_entries(F.collect_list(F.when(F.col("last") == F.col("on"), F.struct(F.col("security_id").cast("string"), F.array(text("close"), text("liquidity")))))).alias("prints"),
    )
    sized = asof_join(targets, traded, ["security_id"], "clock", "trade_date", {"close": "size"}, tolerance_days=factors.STALE_DAYS)
    wanted = sized.groupBy("run_id", "on").agg(F.map_from_entries(F.collect_list(F.struct(F.col("security_id").cast("string"), "weight"))).alias("targets"), F.map_from_entries(F.collect_list(F.struct(F.col("security_id").cast("string"), text("size")))).alias("sizes"))
    # an action between sessions applies on the next one; only the distinct days meet the list of sessions
    effects = ledger.resolved(actions).withColumn("_on", F.greatest("ex_date", "available_on"))
    next_session = asof_join(effects.select("_on", F.lit(1).alias("_all")).distinct(), sessions.withColumn("_all", F.lit(1)), ["_all"], "_on", "session", {"session": "on"}, forward=True).where("on IS NOT NULL")
    due = effects.join(next_session.select("_on", "on"), "_on")
    parts = [F.col("action_id"), F.col("security_id").cast("string").alias("security_id"), "effect", "new_shares", "old_shares", F.col("amount").cast("string").alias("amount"), "at_mark", "note"]
    acts = due.join(names, "security_id").groupBy("run_id", "on").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("effects"))
    joined = days.join(by_day, ["run_id", "on"], "left").join(wanted, ["run_id", "on"], "left").join(acts, ["run_id", "on"], "left")
    none = F.expr("cast(map() as map<string,array<string>>)")
    empty = F.expr("cast(array() as array<struct<action_id:bigint,security_id:string,effect:string,new_shares:int,old_shares:int,amount:string,at_mark:boolean,note:string>>)")
    payload = F.struct(F.coalesce("marks", none).alias("marks"), F.coalesce("prints", none).alias("prints"), F.coalesce("effects", empty).alias("effects"), "targets", "sizes")
    return joined.select("run_id", "on", F.to_json(payload).alias("payload"))


def backtest(targets: DataFrame, bars: DataFrame, actions: DataFrame, sessions: DataFrame, rules: ledger.Rules) -> DataFrame:
    """The ledgers of all runs; each run is one task, runs are spread over the cluster."""
    return ledger.simulate(day_plans(targets, bars, actions, sessions), rules)


def values_by_day(events: DataFrame, bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(run_id, date, value, cash) of each run's days, from its log: cash so far and holdings at their last close."""
    days = events.groupBy("run_id").agg(F.min("on").alias("_start")).join(F.broadcast(sessions), F.col("session") >= F.col("_start")).select("run_id", F.col("session").alias("date"))
    daily = events.groupBy("run_id", "on").agg(F.sum("cash_delta").alias("step"))
    so_far = daily.withColumn("cash", F.sum("step").over(Window.partitionBy("run_id").orderBy("on").rowsBetween(Window.unboundedPreceding, 0)))
    cash = asof_join(days, so_far, ["run_id"], "date", "on", {"cash": "cash"})
    held = ledger.holdings_history(events.where("security_id IS NOT NULL"))
    names = held.select("run_id", "security_id").distinct()
    owned = asof_join(days.join(names, "run_id"), held, ["run_id", "security_id"], "date", "on", {"quantity": "quantity"}).where("quantity > 0")
    marked = asof_join(owned, bars.select(F.col("security_id").cast("string").alias("security_id"), "trade_date", "close"), ["security_id"], "date", "trade_date", {"close": "close"})
    worth = marked.groupBy("run_id", "date").agg(F.sum(F.col("quantity") * F.col("close").cast("decimal(18,6)")).alias("worth"))
    joined = cash.join(worth, ["run_id", "date"], "left")
    return joined.select("run_id", "date", (F.col("cash") + F.coalesce("worth", F.lit(0))).cast("double").alias("value"), F.col("cash").cast("double").alias("cash"))


def suitability(benchmark: str, universe: str, currency: str, total_return: bool, known: Mapping[str, Mapping[str, str]]) -> list[str]:
    """What speaks against a benchmark for a universe: another universe or currency, or prices without dividends."""
    held = known.get(benchmark)
    if held is None:
        return [f"{benchmark} isn't known"]
    out = [f"{benchmark} covers {held['universe']}, not {universe}"] if held["universe"] != universe else []
    out += [f"{benchmark} is in {held['currency']}, not {currency}"] if held["currency"] != currency else []
    return out + ([] if total_return else [f"{benchmark} has no dividends"])
