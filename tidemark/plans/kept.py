"""Queries through the stores, the experiment registry, the calendars and the ledger's invariants."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators import experiments, factors, ledger, metrics, prices, sessions
from tidemark.operators.strategy import Definition
from tidemark.plans.fixtures import ACTIONS, BARS, EQUITY, FACTS, SPELLS, actions, bars, equity, facts, spells, table, with_tables
from tidemark.plans.market import all_kinds, simulated
from tidemark.plans.prices import FACTORS, LOGS, RETURNS
from tidemark.plans.registry import query
from tidemark.plans.rest import priced, scratch
from tidemark.sources import console, stores


def price_store(spark: SparkSession, sf_dir: str) -> str:
    root = scratch(spark, "kept-prices")
    stores.write_prices(priced(spark, sf_dir), root)
    return root


@query(with_tables(BARS) + "SELECT security_id::VARCHAR AS security_id, trade_date, close, volume FROM bars WHERE trade_date BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'")
def s1_pruned_price_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of dates from the store: the years outside of it aren't read."""
    held = stores.read_prices(spark, price_store(spark, sf_dir), start=date(1995, 3, 1), end=date(1996, 2, 29))
    return held.select("security_id", "trade_date", F.col("close").cast("double").alias("close"), "volume")


@query(with_tables(BARS) + "SELECT year(trade_date)::INT AS trade_year, count(*) AS \"rows\", count(*) < 10000 AS small FROM bars GROUP BY 1")
def s5_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.partition_counts(spark, price_store(spark, sf_dir), "trade_year")


@query(with_tables(BARS) + "SELECT year(trade_date)::INT AS trade_year, count(*) AS bars, max(close) AS highest FROM bars GROUP BY 1")
def s6_s34_view_of_the_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over the store's partitioned files; a view whose path holds nothing is left out."""
    root = price_store(spark, sf_dir)
    made = console.open_views(spark, {"kept_prices": root, "kept_nothing": f"{root}-none"})
    if made != ["kept_prices"]:
        raise ValueError(f"views: {made}")
    return console.run(spark, "SELECT trade_year, count(*) AS bars, CAST(max(close) AS double) AS highest FROM kept_prices GROUP BY trade_year")


@query(with_tables(FACTS) + "SELECT DISTINCT line_item FROM facts")
def s9_stored_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of the fundamentals store, by a scan of one column."""
    root, stamp = scratch(spark, "kept-facts"), F.col("available_on").cast("timestamp")
    rows = facts(spark, sf_dir).select(
        F.col("security_id").cast("string").alias("security_id"), F.lit("income").alias("statement"), "line_item", "period_end", F.lit("annual").alias("period_type"), "currency", (F.col("cents") / 100.0).alias("value"),
        F.lit(None).cast("timestamp").alias("filed_at"), stamp.alias("available_at"), F.when(F.col("revision") > 0, stamp).alias("revised_at"), F.col("revision").alias("revision_sequence"), F.lit("given").alias("source"),
        F.lit(True).alias("availability_imputed"), F.lit("period_end+90d").alias("imputation_rule"),
    )
    stores.write_fundamentals(rows, root)
    return stores.known_line_items(spark, root)


@query(with_tables(SPELLS) + "SELECT 'u' || universe AS universe, count(DISTINCT security_id) AS members, true AS stamped FROM spells GROUP BY 1")
def s11_universe_list_and_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universes of the membership store, and whether the dataset has a version."""
    root = scratch(spark, "kept-universe")
    one = spells(spark, sf_dir).groupBy("universe", "security_id").agg(F.min("valid_from").alias("valid_from"))
    rows = one.select(F.concat(F.lit("u"), F.col("universe").cast("string")).alias("universe"), F.col("security_id").cast("string").alias("security_id"), "valid_from", F.lit(None).cast("date").alias("valid_to"), F.lit(None).cast("timestamp").alias("recorded_at"), F.lit(None).cast("timestamp").alias("superseded_at"), F.lit("given").alias("source"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("security_id"))
    stores.write_universe(rows, root, [f"u{k}" for k in range(25)], known)
    stamp = stores.dataset_version(spark, root)
    return stores.read_universe(spark, root).groupBy("universe").agg(F.count_distinct("security_id").alias("members")).withColumn("stamped", F.lit(stamp != "empty"))


def refused(write: Callable[[], object]) -> bool:
    try:
        write()
    except (AnalysisException, ValueError):
        return True
    return False


@query(with_tables(BARS, ACTIONS) + FACTORS + f"SELECT security_id, trade_date, {LOGS}, true AS second_refused FROM factors")
def s15_adjustment_factor_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjustment factors written once, by year; a second write is refused."""
    root = scratch(spark, "kept-adjustments")
    found = prices.adjustment_factors(bars(spark, sf_dir), actions(spark, sf_dir)).select("security_id", "trade_date", "split_factor", "dividend_factor", F.year("trade_date").alias("trade_year"))
    stores.write_new(found, root, ["trade_year"])
    again = refused(lambda: stores.write_new(found, root, ["trade_year"]))
    held = spark.read.parquet(root)
    return held.select("security_id", "trade_date", F.round(F.log2("split_factor"), 6).alias("log_split"), F.round(F.ln("dividend_factor"), 6).alias("log_dividend"), F.lit(again).alias("second_refused"))


@query(with_tables(BARS) + RETURNS + "SELECT security_id, trade_date, round(ret, 9) AS ret FROM r WHERE ret IS NOT NULL")
def s16_return_set_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "kept-returns")
    stores.write_new(prices.daily_returns(bars(spark, sf_dir)).select("security_id", "trade_date", "ret"), root)
    return spark.read.parquet(root).select("security_id", "trade_date", F.round("ret", 9).alias("ret"))


@query(with_tables(EQUITY) + "SELECT date, value, 'quarterly' AS schedule, 5 AS names FROM equity")
def s17_run_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's configuration and its value curve, written and read together."""
    root = scratch(spark, "kept-runs")
    stores.write_run(root, "one", {"schedule": "quarterly", "names": 5}, {"curve": equity(spark, sf_dir)})
    meta = spark.read.text(f"{root}/one/meta").select(F.from_json("value", "struct<schedule:string,names:int>").alias("m")).select("m.*")
    return spark.read.parquet(f"{root}/one/curve").crossJoin(F.broadcast(meta))  # one row


@query("SELECT n_name AS name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def s18_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each nation as lines of JSON, written and read."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    found = customer.join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    root = scratch(spark, "kept-metrics")
    stores.write_json(spark, root, [r[0] for r in found.select(F.to_json(F.struct("name", "customers", "balance"))).collect()])  # a row a nation
    return spark.read.schema("name string, customers bigint, balance double").json(root)


@query(with_tables(EQUITY) + "SELECT * FROM (SELECT date, round(value / lag(value) OVER (ORDER BY date) - 1, 9) AS ret FROM equity) WHERE ret IS NOT NULL")
def s30_benchmark_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark's bars from a store, with dividends where a table of them is: here there is none."""
    root = scratch(spark, "kept-benchmark")
    stores.write_new(equity(spark, sf_dir).select("date", F.col("value").alias("close")), f"{root}/bars")
    paid = stores.optional_table(spark, f"{root}/dividends", "ex_date date, amount double")
    found = metrics.benchmark_returns(stores.optional_table(spark, f"{root}/bars", "date date, close double"), paid)
    return found.select("date", F.round("ret", 9).alias("ret"))


@query("SELECT r_name AS id, lower(r_name) AS name, 'designed' AS state, 'r' || r_regionkey AS hypothesis, 'a,b' AS tags FROM region")
def s33_mirrored_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a registry's JSON payloads as columns."""
    payload = F.to_json(F.struct(F.lower("r_name").alias("name"), F.lit("designed").alias("state"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("hypothesis"), F.array(F.lit("a"), F.lit("b")).alias("tags")))
    found = console.mirrored_registry(table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), payload.alias("payload")))
    return found.select("id", "name", "state", "hypothesis", F.array_join("tags", ",").alias("tags"))


@query("SELECT DISTINCT 'm' || r_regionkey AS metric FROM region UNION SELECT 'common'")
def u7_metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the names of metrics that runs recorded, each run its own."""
    runs = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("experiment"), F.lit("one").alias("run_id"), F.lit("2020").alias("started_at"),
        F.create_map(F.concat(F.lit("m"), F.col("r_regionkey").cast("string")), F.lit(1.0), F.lit("common"), F.lit(2.0)).alias("metrics"),
    )
    return console.metric_comparison(runs).select("metric")


@query("SELECT * FROM (VALUES ('nation', false), ('region', true)) AS t(name, refused)")
def p7_column_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the guard refuses a table without the columns that are asked for."""
    asked = ["n_nationkey", "n_name"]
    found = [(name, refused(lambda name=name: stores.require_columns(table(spark, sf_dir, name), asked))) for name in ("nation", "region")]
    return spark.createDataFrame(found, "name string, refused boolean")


REGISTRY_STEPS = """SELECT * FROM (VALUES
  ('a', 'concluded', 'kept', 'held', 5.0::DOUBLE, true), ('b', 'completed', 'kept', NULL, 25.0::DOUBLE, true), ('c', 'abandoned', 'dropped', NULL, NULL, NULL), ('d', 'designed', 'kept', NULL, NULL, NULL)
) AS t(id, state, hypothesis, verdict, counted, agrees)"""


@query(REGISTRY_STEPS)
def e1_e2_e4_e5_e6_z40_z43_z44_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four experiments through their states: designed, run, rerun, concluded and abandoned; a failing run is recorded."""
    held = experiments.Registry(spark, scratch(spark, "kept-registry"))
    count = lambda config: {"size": {"rows": table(spark, sf_dir, config["table"]).count(), "note": "text"}}
    held.design("a", "kept", {"table": "region"}, tags=["out_of_sample"], confirmatory=True)
    held.design("b", "kept", {"table": "nation"})
    held.design("c", "dropped", {"table": "nothing"})
    held.design("d", "kept", {"table": "region"}, tags=["later"])
    runs = {key: held.run(key, count, {"data": "given"}) for key in ("a", "b")}
    if not refused(lambda: held.run("c", count, {})):
        raise ValueError("a run without its table must fail")
    agrees = {key: held.rerun_agrees(run_id, count) for key, run_id in runs.items()}
    if not refused(lambda: held.conclude("a", "held", runs["a"])):
        raise ValueError("a confirmatory experiment that wasn't reproduced must not be concluded")
    held.conclude("a", "held", runs["a"], reproduced=agrees["a"])
    if not refused(lambda: held.move("a", "running")):
        raise ValueError("a concluded experiment must stay so")
    counted = held.runs().select(F.col("experiment").alias("id"), F.col("metrics")["size.rows"].alias("counted")).where("counted IS NOT NULL")
    told = spark.createDataFrame(list(agrees.items()), "id string, agrees boolean")
    return held.experiments().select("id", "state", "hypothesis", "verdict").join(counted, "id", "left").join(told, "id", "left")


@query("SELECT 'x' || c_nationkey AS id FROM customer GROUP BY c_nationkey HAVING c_nationkey % 2 = 0")
def p13_experiment_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments by state and tag: one row an experiment, whatever its history."""
    made = table(spark, sf_dir, "customer").select("c_nationkey").distinct().select(F.concat(F.lit("x"), F.col("c_nationkey").cast("string")).alias("id"), F.col("c_nationkey").alias("n"))
    line = lambda state, at: F.to_json(F.struct(F.lit(state).alias("state"), F.lit("h").alias("hypothesis"), F.when(F.col("n") % 2 == 0, F.array(F.lit("even"))).otherwise(F.array(F.lit("odd"))).alias("tags")))  # noqa: E731, ARG005
    root = scratch(spark, "kept-filters")
    for state, at in (("designed", "2020-01-01"), ("running", "2020-01-02")):
        made.select("id", F.lit("experiment").alias("kind"), F.lit(at).alias("at"), line(state, at).alias("payload")).write.mode("append").json(root)
    listed = experiments.Registry(spark, root).experiments()
    return listed.where((F.col("state") == "running") & F.array_contains("tags", "even")).select("id")


@query("SELECT * FROM (VALUES ('data', 'v1', 'v2'), ('gone', 'x', NULL), ('new', NULL, 'y')) AS t(name, before, after)")
def e3_z41_manifest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = experiments.manifest_difference({"same": "1", "data": "v1", "gone": "x"}, {"same": "1", "data": "v2", "new": "y"})
    return spark.createDataFrame([(k, a, b) for k, (a, b) in found.items()], "name string, before string, after string")


@query(
    """SELECT * FROM (VALUES
  ('config', sha256('{"months": 12, "skip": 1}')), ('definition', sha256('{"computation": "window_return", "name": "momentum", "parameters": {"months": 12}, "version": 1}'))) AS t(name, digest)"""
)
def f22_f23_content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes of a configuration and of what a definition means: sorted JSON, whatever the order of its fields."""
    rows = [("config", experiments.content_hash({"skip": 1, "months": 12})), ("definition", Definition("momentum", 1, "window_return", {"months": 12}).digest)]
    return spark.createDataFrame(rows, "name string, digest string")


@query("SELECT * FROM (VALUES ('both windows', true), ('no window', true), ('one observation', true), ('days', false), ('direction 0', true), ('weights of zero', true), ('unknown policy', true), ('known policy', false)) AS t(rule, refused)")
def r14_z9_z10_z11_config_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations that must be refused, and two that must not."""
    one = spark.createDataFrame([("s", "ok", 1.0)], "security_id string, status string, value double").withColumn("warnings", F.expr("cast(array() as array<string>)"))
    mix = lambda weights, policy="drop": factors.composite(one, dict.fromkeys(("a", "b"), one), [factors.Component(n, w) for n, w in zip("ab", weights, strict=True)], policy=policy)
    tries = {
        "both windows": lambda: metrics.RollingSpec(days=5, months=1), "no window": lambda: metrics.RollingSpec(), "one observation": lambda: metrics.RollingSpec(days=5, least=1), "days": lambda: metrics.RollingSpec(days=5),
        "direction 0": lambda: factors.Component("a", 1.0, 0), "weights of zero": lambda: mix((1.0, -1.0)), "unknown policy": lambda: mix((1.0, 1.0), "guess"), "known policy": lambda: mix((1.0, 1.0)),
    }
    return spark.createDataFrame([(name, refused(run)) for name, run in tries.items()], "rule string, refused boolean")


@query("SELECT c_mktsegment AS segment, count(*) FILTER (b BETWEEN -0.02 AND 0.2) AS days, round(avg(b) FILTER (b BETWEEN -0.02 AND 0.2), 9) AS mean_rate FROM (SELECT c_mktsegment, round(c_acctbal) / 10000 AS b FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def z12_risk_free_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of rates within the sane band; those outside of it don't count."""
    rows = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.lit("1995-06-01").cast("date").alias("date"), (F.round("c_acctbal") / 10000).alias("annual_rate"))
    return metrics.window_mean_rate(rows, "1995-01-01", "1995-12-31").select(F.lit("BUILDING").alias("segment"), "days", F.round("mean_rate", 9).alias("mean_rate"))


#: Days without trading in the fixture's calendar, besides weekends.
HOLIDAYS = "(month(d) = 12 AND day(d) IN (25, 26)) OR (month(d) = 1 AND day(d) = 1) OR (month(d) = 5 AND day(d) <= 7 AND isodow(d) = 1)"
CALENDAR = f"days AS (SELECT d AS session FROM (SELECT unnest(generate_series(DATE '1992-01-01', DATE '1999-12-31', INTERVAL 1 DAY))::DATE AS d) WHERE isodow(d) < 6 AND NOT ({HOLIDAYS}))"


def calendar(spark: SparkSession) -> DataFrame:
    """Sessions of eight years: weekdays but some holidays."""
    day = F.col("session")
    every = spark.range(1).select(F.explode(F.sequence(F.lit(date(1992, 1, 1)), F.lit(date(1999, 12, 31)))).alias("session"))
    off = ((F.month(day) == 12) & F.dayofmonth(day).isin(25, 26)) | ((F.month(day) == 1) & (F.dayofmonth(day) == 1)) | ((F.month(day) == 5) & (F.dayofmonth(day) <= 7) & (F.weekday(day) == 0))
    return sessions.sessions(spark, date(1992, 1, 1), date(1999, 12, 31), every.where(off)).select("session")


@query(
    with_tables(BARS, CALENDAR)
    + """, n AS (SELECT session, row_number() OVER (ORDER BY session) AS k FROM days),
b AS (SELECT security_id, k, lag(k) OVER (PARTITION BY security_id ORDER BY k) AS p FROM bars JOIN n ON trade_date = session)
SELECT security_id, x.session AS "start", y.session AS "end", b.k - b.p - 1 AS sessions FROM b JOIN n x ON x.k = b.p + 1 JOIN n y ON y.k = b.k - 1 WHERE b.k - b.p > 1"""
)
def w26_v2_j20_session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of sessions of a calendar without a bar: a holiday is no gap."""
    return sessions.session_gaps(bars(spark, sf_dir), calendar(spark))


@query(
    with_tables(CALENDAR)
    + "SELECT session, CASE WHEN month(session) = 12 AND day(session) IN (24, 31) THEN 150 ELSE 510 END AS minutes FROM days WHERE month(session) = 12 AND day(session) IN (24, 31)"
)
def z25_z27_half_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions shorter than most."""
    early = (F.month("session") == 12) & F.dayofmonth("session").isin(24, 31)
    return sessions.half_days(calendar(spark).withColumn("minutes", F.when(early, 150).otherwise(510)))


@query("SELECT * FROM (VALUES ('top20', 0, 0, 0, true), ('top5', 0, 0, 0, true)) AS t(run_id, debts, shorts, uncovered, replays)")
def b5_b6_b7_ledger_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all events of the runs, with splits, dividends, mergers and failures: cash and holdings never fall below
    zero, no trade is without a price of its day, and cash and holdings follow from the log alone."""
    from pyspark.sql import Window

    events, found, _ = simulated(spark, sf_dir)
    events = events.persist()
    turn = Window.partitionBy("run_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("run_id", "security_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    running = events.withColumns({"cash": F.sum("cash_delta").over(turn), "held": F.sum("quantity_delta").over(own)})
    traded = events.where("kind IN ('buy', 'sell')").join(found.select(F.col("security_id").cast("string").alias("security_id"), F.col("trade_date").alias("on"), F.lit(1).alias("printed")), ["security_id", "on"], "left")
    uncovered = traded.groupBy("run_id").agg(F.count_if(F.col("printed").isNull()).cast("int").alias("uncovered"))
    cash, _ = ledger.replayed(events)
    last = running.groupBy("run_id").agg(F.count_if(F.col("cash") < 0).cast("int").alias("debts"), F.count_if(F.col("security_id").isNotNull() & (F.col("held") < 0)).cast("int").alias("shorts"), F.max_by("cash", "turn").alias("last"))
    return last.join(uncovered, "run_id").join(cash, "run_id").select("run_id", "debts", "shorts", "uncovered", (F.col("last") == F.col("cash")).alias("replays"))


@query("SELECT * FROM (VALUES ('top20', 0), ('top5', 0)) AS t(run_id, overdue)")
def b3_stale_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of names whose last price was older than the limit on a later day of trading, and that weren't sold."""
    events, found, days = simulated(spark, sf_dir)
    events = events.persist()
    _, held = ledger.replayed(events)
    ends = found.groupBy(F.col("security_id").cast("string").alias("security_id")).agg(F.max("trade_date").alias("last"))
    final = days.agg(F.max("session").alias("final"))
    late = held.join(ends, "security_id").crossJoin(F.broadcast(final)).where(F.datediff("final", "last") > ledger.STALE_EXIT_DAYS)  # one row
    runs = events.select("run_id").distinct()
    return runs.join(late.groupBy("run_id").agg(F.count("*").cast("int").alias("overdue")), "run_id", "left").na.fill(0, ["overdue"])


@query(
    with_tables(BARS, ACTIONS)
    + """, ends AS (SELECT -security_id AS action_id, CASE WHEN security_id % 10 = 2 THEN max(close) WHEN security_id % 10 = 0 THEN 0 END AS amount, security_id % 10 = 1 AS at_mark,
  CASE security_id % 10 WHEN 2 THEN 'cash terms of a merger' WHEN 0 THEN 'ended: failure' ELSE 'ended: acquired' END AS note FROM bars WHERE security_id % 10 < 3 GROUP BY security_id)
SELECT action_id, CASE action_type WHEN 'split' THEN 'ratio' ELSE 'cash' END AS effect, round(amount / 1000, 6)::DOUBLE AS amount, false AS at_mark,
  CASE WHEN action_type = 'dividend' THEN CASE WHEN action_id % 3 = 0 THEN 'special' ELSE 'ordinary' END END AS note FROM actions
UNION ALL SELECT action_id, 'exit', round(amount, 6)::DOUBLE, at_mark, note FROM ends"""
)
def b2_z28_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each action does to a holding: splits, dividends, and ends by failure, at the last price or for cash."""
    found = ledger.resolved(all_kinds(spark, sf_dir, bars(spark, sf_dir)))
    return found.select("action_id", "effect", F.round(F.col("amount").cast("double"), 6).alias("amount"), "at_mark", "note")


@query("SELECT n_name AS name, count(*) AS securities FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def z50_master_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the security master as views of the console."""
    root, customer = scratch(spark, "kept-master"), table(spark, sf_dir, "customer")
    empty = {n: spark.createDataFrame([], f) for n, f in stores.MASTER.items()}
    entities = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("country"))
    securities = customer.select(F.col("c_custkey").cast("string").alias("security_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("entity_id"), F.lit("share").alias("security_type"), F.col("c_name").alias("name"))
    stores.write_master({**empty, "entities": entities, "securities": securities}, root)
    stores.read_master(spark, root, views=True)
    return console.run(spark, "SELECT e.name, count(*) AS securities FROM securities s JOIN entities e ON s.entity_id = e.entity_id GROUP BY e.name")
