"""Queries over the check harness, the raw store, plans of days, the master's assembly, defaults and reports."""

from __future__ import annotations

import dataclasses
import inspect
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bakeoff, experiments, factors, ledger, master, prices, strategy, universe
from tidemark.operators.sessions import month_ends
from tidemark.plans.checks import PROVIDER, keyed
from tidemark.plans.fixtures import ACTIONS, BARS, actions, bars, table, with_tables
from tidemark.plans.kept import refused
from tidemark.plans.market import all_kinds
from tidemark.plans.records import CHANGES, change_events
from tidemark.plans.registry import query
from tidemark.plans.rest import scratch
from tidemark.sources import payloads, stores


@query(
    f"""WITH c AS (SELECT DISTINCT {PROVIDER.format("(event_id % 40)")} FROM events)
SELECT provider, entry, 'sizes' AS "check", 'pass' AS outcome, count(*)::VARCHAR AS note FROM (SELECT {PROVIDER.format("(event_id % 40)")} FROM events) GROUP BY ALL
UNION ALL SELECT provider, entry, 'no such column', 'error', 'AnalysisException' FROM c UNION ALL SELECT provider, entry, 'no number', 'error', 'NumberFormatException' FROM c"""
)
def z36_raising_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three checks, one that raises when it is planned and one that raises when it runs: the third's findings stay."""
    cells = keyed(table(spark, sf_dir, "events").withColumn("cell", F.col("event_id") % 40), "cell").select("provider", "entry", "event_type")
    checks = {
        "sizes": lambda: bakeoff.finding(cells.groupBy("provider", "entry").agg(F.count("*").alias("n")), "sizes", F.lit("pass"), F.col("n").cast("string")),
        "no such column": lambda: bakeoff.finding(cells, "no such column", F.col("lost"), F.lit("")),
        "no number": lambda: bakeoff.finding(cells, "no number", F.col("event_type").cast("int").cast("string"), F.lit("")),
    }
    return bakeoff.run_checks(checks, cells.select("provider", "entry"), scratch(spark, "harness-checks"))


@query("SELECT r_name AS provider, n_name AS entry, d AS dataset FROM region CROSS JOIN nation CROSS JOIN (VALUES ('prices'), ('actions')) t(d) WHERE NOT ((n_regionkey = r_regionkey AND d = 'prices') OR n_nationkey % 7 = 0)")
def s29_append_and_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's cells in JSON lines, appended in two goes, and what is left to do; nothing is done before the first."""
    path, region, nation = scratch(spark, "harness-cells"), table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    providers, entries = region.select(F.col("r_name").alias("provider")), nation.select(F.col("n_name").alias("entry"))
    datasets = spark.createDataFrame([("prices",), ("actions",)], "dataset string")
    every = bakeoff.pending_cells(providers, entries, datasets, bakeoff.completed_cells(spark, path))
    named = every.join(nation, F.col("entry") == F.col("n_name")).join(region, F.col("provider") == F.col("r_name"))
    for part in ((F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("dataset") == "prices"), F.col("n_nationkey") % 7 == 0):
        bakeoff.append_cells(named.where(part).select("provider", "entry", "dataset", F.lit("pass").alias("outcome")), path)
    return bakeoff.pending_cells(providers, entries, datasets, bakeoff.completed_cells(spark, path))


@query("SELECT event_type AS provider, 'c' || (user_id % 20) AS entry, count(*) AS contents, sum(octet_length(encode(props)))::BIGINT AS bytes FROM events WHERE user_id % 3 = 0 GROUP BY ALL")
def z37_replayed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored contents found again by provider, dataset and parameters, under another credential than they came with."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.lit("ticks").alias("dataset"), "user_id", F.col("props").cast("binary").alias("content"))
    asked = lambda token: F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("api_token"), F.lit(token)).alias("parameters")
    cells = events.where("user_id % 3 = 0").select("provider", "dataset", F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("entry"), "user_id").distinct()
    found = payloads.replayed(events.select("provider", "dataset", asked("old"), "content"), cells.select("provider", "entry", "dataset", asked("new")))
    return found.groupBy("provider", "entry").agg(F.count("*").alias("contents"), F.sum(F.octet_length("content")).alias("bytes"))


@query(
    """WITH e AS (SELECT n_nationkey::INT AS place, CASE WHEN n_nationkey % 6 = 5 THEN lag(n_name) OVER (ORDER BY n_nationkey) ELSE n_name END AS entry FROM nation),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY entry ORDER BY place) > 1 THEN 'duplicate' WHEN entry < lag(entry) OVER (ORDER BY place) THEN 'unsorted' END AS fault FROM e)
SELECT entry, place, fault FROM f WHERE fault IS NOT NULL"""
)
def z38_entry_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of entries in which every sixth repeats the one before it, and whose order isn't that of its keys."""
    from pyspark.sql import Window

    nation = table(spark, sf_dir, "nation")
    entry = F.when(F.col("n_nationkey") % 6 == 5, F.lag("n_name").over(Window.orderBy("n_nationkey"))).otherwise(F.col("n_name"))  # 25 rows
    return bakeoff.entry_faults(nation.select(F.col("n_nationkey").cast("int").alias("place"), entry.alias("entry")))


@query(
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'uk' ELSE 'us' END AS market, CASE WHEN o_orderkey % 3 = 0 THEN 'annual' ELSE 'quarterly' END AS period_type,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS period_end, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE + (o_orderkey % 80 - 10)::INT END AS filed_on FROM orders),
u AS (SELECT *, coalesce(filed_on > period_end AND filed_on <= DATE '1998-06-01', false) AS usable, CASE WHEN market = 'uk' THEN CASE period_type WHEN 'annual' THEN 120 ELSE 90 END ELSE CASE period_type WHEN 'annual' THEN 90 ELSE 45 END END AS days FROM s)
SELECT o_orderkey, CASE WHEN usable THEN filed_on ELSE period_end + days END AS available_on, NOT usable AS imputed, CASE WHEN NOT usable AND period_end IS NOT NULL THEN market || '-' || period_type || '-lag-' || days || 'd' END AS rule FROM u"""
)
def f12_derived_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "uk").otherwise("us").alias("market"), F.when(k % 3 == 0, "annual").otherwise("quarterly").alias("period_type"),
        F.when(k % 11 != 0, day).alias("period_end"), F.when(k % 5 != 0, F.date_add(day, (k % 80 - 10).cast("int"))).alias("filed_on"),
    )
    lags = {("uk", "annual"): 120, ("uk", "quarterly"): 90, ("us", "annual"): 90, ("us", "quarterly"): 45}
    return bakeoff.derived_availability(rows, lags, "1998-06-01").select("o_orderkey", "available_on", "imputed", "rule")


@query(
    """WITH e AS (SELECT 'u' || (c_nationkey % 3) AS universe, DATE '2000-01-01' + (c_nationkey * 7)::INT AS effective, CASE WHEN c_custkey % 4 = 0 THEN 'same' ELSE c_name END AS name, c_custkey FROM customer),
h AS (SELECT *, count(*) OVER (PARTITION BY universe, effective, name) AS hits FROM e)
SELECT universe, CASE WHEN hits = 1 AND c_custkey % 5 = 0 THEN effective + 1 ELSE effective END AS effective, name, CASE WHEN hits = 1 AND c_custkey % 5 = 0 THEN 'noted [corrected: moved]' ELSE 'noted' END AS notes, 0 AS hits FROM h
UNION ALL SELECT NULL, NULL, 'fault ' || c_custkey, NULL, hits::INT FROM h WHERE c_custkey % 5 = 0 AND hits > 1 UNION ALL SELECT NULL, NULL, 'fault -1', NULL, 0"""
)
def z21_one_match_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of membership with corrections, of which some meet several changes and one meets none."""
    made = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), (F.col("c_nationkey") % 3).cast("string")).alias("universe"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("c_nationkey") * 7).cast("int")).alias("effective"),
        F.when(F.col("c_custkey") % 4 == 0, "same").otherwise(F.col("c_name")).alias("name"), F.lit("added").alias("change"), F.lit("noted").alias("notes"), F.col("c_custkey").cast("long").alias("correction"),
    )
    moved = made.where("correction % 5 = 0").select("correction", "universe", "effective", "name", F.date_add("effective", 1).alias("new_effective"), F.lit("moved").alias("reason"))
    nothing = spark.sql("SELECT -1L AS correction, 'u0' AS universe, DATE '1990-01-01' AS effective, 'none' AS name, DATE '1990-01-02' AS new_effective, 'moved' AS reason")
    events, faults = universe.corrected(made.drop("correction"), moved.unionByName(nothing))
    none = F.lit(None)
    lost = faults.select(none.cast("string").alias("universe"), none.cast("date").alias("effective"), F.concat(F.lit("fault "), F.col("correction").cast("string")).alias("name"), none.cast("string").alias("notes"), F.col("hits").cast("int").alias("hits"))
    return events.select("universe", "effective", "name", "notes", F.lit(0).alias("hits")).unionByName(lost)


BACKWARDS = CHANGES + """, e AS (SELECT * FROM ev WHERE NOT (security_id % 4 = 0 AND change = 'added')), an AS (SELECT DISTINCT universe, security_id FROM one WHERE security_id % 3 = 0),
names AS (SELECT universe, security_id FROM e UNION SELECT universe, security_id FROM an)"""


def backwards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Changes of membership without some additions, walked back from every third name."""
    events = change_events(spark, sf_dir)
    anchor = events.where("security_id % 3 = 0").select("universe", "security_id")
    return universe.reverse_replay(events.where("NOT (security_id % 4 = 0 AND change = 'added')"), anchor)


@query(
    BACKWARDS
    + """, f AS (SELECT n.universe, n.security_id, arg_min(change, (effective, CASE change WHEN 'removed' THEN 0 ELSE 1 END)) AS first FROM names n LEFT JOIN e USING (universe, security_id) GROUP BY ALL)
SELECT universe, security_id FROM f LEFT JOIN (SELECT *, true AS held FROM an) USING (universe, security_id) WHERE first = 'removed' OR (first IS NULL AND held)"""
)
def x7_reverse_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members at the start of a history that is known by its end."""
    return backwards(spark, sf_dir)[0]


@query(
    BACKWARDS
    + """, d AS (SELECT DISTINCT universe, effective FROM e),
f AS (SELECT d.universe, d.effective, n.security_id, arg_min(e.change, (e.effective, CASE e.change WHEN 'removed' THEN 0 ELSE 1 END)) AS first FROM d JOIN names n USING (universe) LEFT JOIN e ON e.universe = d.universe AND e.security_id = n.security_id AND e.effective >= d.effective GROUP BY ALL),
m AS (SELECT universe, effective, count(*) FILTER (first = 'removed' OR (first IS NULL AND held)) AS members FROM f LEFT JOIN (SELECT *, true AS held FROM an) USING (universe, security_id) GROUP BY ALL),
x AS (SELECT e.universe, e.effective, e.change, coalesce(lead(change) OVER (PARTITION BY universe, security_id ORDER BY effective, change DESC), CASE WHEN held THEN 'removed' ELSE 'added' END) AS follows FROM e LEFT JOIN (SELECT *, true AS held FROM an) USING (universe, security_id))
SELECT universe, effective, members, faults FROM m JOIN (SELECT universe, effective, count(*) FILTER (change = follows) AS faults FROM x GROUP BY ALL) USING (universe, effective)"""
)
def x7_reverse_replay_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of members before each day with changes, and the changes that don't fit what follows."""
    return backwards(spark, sf_dir)[1]


ENDED = """ended AS (SELECT security_id, 'merger' AS kind, max(close) AS amount FROM bars WHERE security_id % 10 = 2 GROUP BY 1
  UNION ALL SELECT DISTINCT security_id, CASE security_id % 10 WHEN 0 THEN 'failure' ELSE 'other' END, NULL::DOUBLE FROM bars WHERE security_id % 10 < 3)"""


@query(
    with_tables(BARS, ENDED)
    + """, d AS (SELECT security_id, DATE '1997-06-02' + (security_id % 300)::INT AS event_date, bool_or(kind = 'merger') AS paid, bool_or(kind = 'failure') AS failed, max(amount) AS amount FROM ended GROUP BY 1)
SELECT security_id, event_date, round(CASE WHEN paid THEN CASE WHEN security_id % 20 = 2 THEN amount * 100 END WHEN failed THEN 0.0 END, 4)::DOUBLE AS proceeds, CASE WHEN paid AND security_id % 20 <> 2 THEN 'USD isn''t convertible to GBX' END AS warning FROM d WHERE event_date <= DATE '1998-02-01'"""
)
def z3_z4_proceeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holders get when a security ends: a merger's cash in its quote unit before a delisting's, which a merger has too."""
    found = bars(spark, sf_dir).withColumn("currency", F.lit("GBX"))
    ends = all_kinds(spark, sf_dir, found).where("action_type IN ('merger', 'delisting')")
    both = ends.unionByName(ends.where("action_type = 'merger'").withColumns({"action_type": F.lit("delisting"), "amount": F.lit(None).cast("double"), "reason": F.lit("acquired")}))
    paid = both.withColumn("currency", F.when(F.col("security_id") % 20 == 2, "GBP").otherwise("USD"))
    return factors.action_proceeds(paid, factors.quote_units(found), F.lit("1998-02-01").cast("date")).withColumn("proceeds", F.round("proceeds", 4))


@query(with_tables(BARS) + "SELECT security_id, CASE WHEN month(min(trade_date)) <= 6 THEN 'GBX' ELSE 'GBP' END AS unit, CASE WHEN count(DISTINCT month(trade_date) <= 6) > 1 THEN 'several quote units: GBP, GBX' END AS warning FROM bars GROUP BY 1")
def z3_quote_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.quote_units(bars(spark, sf_dir).withColumn("currency", F.when(F.month("trade_date") <= 6, "GBX").otherwise("GBP")))


QUARTERS = """, se AS (SELECT DISTINCT trade_date AS session FROM bars), qe AS (SELECT max(session) AS e FROM se WHERE month(session) IN (3, 6, 9, 12) AND year(session) >= 1997 GROUP BY year(session), month(session)),
q AS (SELECT e, (SELECT min(session) FROM se WHERE session > e) AS d FROM qe),
n AS (SELECT DISTINCT security_id FROM bars), k AS (SELECT e, d, security_id, row_number() OVER (PARTITION BY e ORDER BY (security_id * 7919 + month(e)) % 1000 DESC, security_id) AS r FROM q CROSS JOIN n),
t AS (SELECT * FROM k WHERE r <= 5 AND d IS NOT NULL)"""


def decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets of quarterly decisions by a made-up score, with the bars and sessions that they rest on."""
    found = bars(spark, sf_dir)
    sessions = found.select(F.col("trade_date").alias("session")).distinct()
    ends = month_ends(sessions).where(F.month("session").isin(3, 6, 9, 12) & (F.year("session") >= 1997)).withColumnRenamed("session", "end")
    values = found.select("security_id").distinct().crossJoin(F.broadcast(ends)).select("security_id", "end", F.lit("ok").alias("status"), ((F.col("security_id") * 7919 + F.month("end")) % 1000).cast("double").alias("value"))
    return strategy.decisions(values, sessions, 5, "five"), found, sessions


@query(with_tables(BARS) + QUARTERS + """ SELECT 'five' AS run_id, d AS "on", e AS clock, security_id, 0.2::DOUBLE AS weight FROM t""")
def b4_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of each quarter's end, traded on the session after it."""
    return decided(spark, sf_dir)[0].withColumn("weight", F.round("weight", 9))


@query(
    with_tables(BARS, ACTIONS)
    + QUARTERS
    + """, days AS (SELECT session FROM se WHERE session >= (SELECT min(d) FROM t)), own AS (SELECT DISTINCT security_id FROM t),
m AS (SELECT session, count(*) AS marks, count(*) FILTER (last = session) AS prints FROM (SELECT session, security_id, max(trade_date) AS last FROM days JOIN bars ON trade_date <= session WHERE security_id IN (FROM own) GROUP BY ALL) GROUP BY 1),
a AS (SELECT (SELECT min(session) FROM se WHERE session >= greatest(ex_date, available_on)) AS session, count(*) AS effects FROM actions WHERE security_id IN (FROM own) GROUP BY 1),
w AS (SELECT d AS session, count(*) AS targets, count(*) FILTER (EXISTS (FROM bars b WHERE b.security_id = t.security_id AND trade_date BETWEEN e - 15 AND e)) AS sized FROM t GROUP BY 1)
SELECT 'five' AS run_id, session AS "on", coalesce(marks, 0)::INT AS marks, coalesce(prints, 0)::INT AS prints, coalesce(effects, 0)::INT AS effects, coalesce(targets, 0)::INT AS targets, coalesce(sized, 0)::INT AS sized
FROM days LEFT JOIN m USING (session) LEFT JOIN a USING (session) LEFT JOIN w USING (session)"""
)
def b17_z5_z8_day_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a day's plan holds: last prices of all names of the run, prints of the day, actions by the later of their
    ex-date and the day they were known, and sizes by prices known at the decision's clock."""
    targets, found, sessions = decided(spark, sf_dir)
    plans = strategy.day_plans(targets, found, actions(spark, sf_dir), sessions)
    shape = "struct<marks:map<string,array<string>>,prints:map<string,array<string>>,effects:array<struct<action_id:bigint>>,targets:map<string,double>,sizes:map<string,string>>"
    held = plans.select("run_id", "on", F.from_json("payload", shape).alias("p"))
    size = lambda c: F.coalesce(F.cardinality(c), F.lit(0))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(size(F.col(c)))
    sized = F.when(F.col("p.sizes").isNull(), 0).otherwise(size(F.map_filter("p.sizes", lambda _, v: v.isNotNull())))
    return held.select("run_id", "on", *[count(f"p.{c}").alias(c) for c in ("marks", "prints", "effects", "targets")], sized.alias("sized"))


@query(
    """WITH RECURSIVE r(ticker, root) AS (SELECT n_nationkey, n_nationkey - 1 FROM nation WHERE n_nationkey % 6 <> 0), c AS (SELECT n_nationkey AS ticker, n_nationkey AS root FROM nation UNION ALL SELECT c.ticker, r.root FROM c JOIN r ON c.root = r.ticker),
x AS (SELECT ticker, min(root) AS root FROM c GROUP BY 1)
SELECT 'N' || root AS security_id, arg_max(n_name, ticker) AS name, DATE '2000-01-01' + (min(ticker) * 30)::INT AS first, DATE '2000-01-01' + (max(ticker) * 30 + 29)::INT AS last, count(*) AS tickers FROM x JOIN nation ON ticker = n_nationkey GROUP BY root"""
)
def m15_assembled_securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers brought together to securities by their renames."""
    nation, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    name = lambda key: F.concat(F.lit("N"), key.cast("string"))
    day = lambda n: F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int"))
    tickers = nation.select(name(k).alias("ticker"), F.col("n_name").alias("name"), day(k * 30).alias("first"), day(k * 30 + 29).alias("last"))
    return master.assembled(tickers, nation.where("n_nationkey % 6 <> 0").select(name(k - 1).alias("old"), name(k).alias("new")))


@query("SELECT c_custkey AS security_id, 'X' || (c_nationkey % 6) AS mic, CASE c_nationkey % 6 WHEN 0 THEN 'GBX' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' END AS currency, CASE WHEN c_nationkey % 6 < 3 THEN 'ok' ELSE 'unknown_exchange' END AS status FROM customer")
def z49_traded_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    exchanges = spark.createDataFrame([("X0", "GBX"), ("X1", "USD"), ("X2", "EUR")], "mic string, currency string")
    listings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("security_id"), F.concat(F.lit("X"), (F.col("c_nationkey") % 6).cast("string")).alias("mic"))
    return master.traded_currency(listings, exchanges).select("security_id", "mic", "currency", "status")


@query(with_tables(BARS) + "SELECT security_id::VARCHAR AS security_id, max(trade_date) + 1 AS ex_date, 'delisting' AS action_type, 'unknown' AS reason, true AS empty_before FROM bars GROUP BY security_id")
def z32_delistings_as_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended series stored and loaded as actions; without a table there are none."""
    path = scratch(spark, "harness-delistings")
    before = stores.load_delistings(spark, path).isEmpty()
    ended = bars(spark, sf_dir).groupBy(F.col("security_id").cast("string").alias("security_id")).agg(F.max("trade_date").alias("last_trading_date"))
    rows = ended.select("security_id", F.date_add("last_trading_date", 1).alias("ex_date"), "last_trading_date", F.lit("unknown").alias("reason"), F.lit("2002-01-01").cast("timestamp").alias("available_at"), F.lit("given").alias("source"))
    stores.write_new(rows, path)
    return stores.load_delistings(spark, path).select("security_id", "ex_date", "action_type", "reason", F.lit(before).alias("empty_before"))


@query(
    """SELECT o_custkey AS security_id, CASE WHEN o_orderkey % 2 = 0 THEN 'annual' ELSE 'quarterly' END AS period_type, o_orderdate::DATE AS period_end, o_orderdate::DATE + 60 AS filed_on, 'USD' AS currency, 'total' AS provider_item, round(o_totalprice)::DOUBLE AS value
FROM orders WHERE o_orderkey % 3 <> 0"""
)
def z35_provider_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements in a provider's own nesting: yearly and quarterly entries count, other cadences don't."""
    day, text = F.to_date("o_orderdate"), lambda c: c.cast("string")
    entry = F.create_map(F.lit("date"), text(day), F.lit("filing_date"), text(F.date_add(day, 60)), F.lit("currency_symbol"), F.lit("USD"), F.lit("total"), text(F.round("o_totalprice")), F.lit("remark"), F.lit("none"))
    cadence = F.when(F.col("o_orderkey") % 3 == 0, "monthly").when(F.col("o_orderkey") % 2 == 0, "yearly").otherwise("quarterly")
    block = F.create_map(F.lit("Income_Statement"), F.create_map(cadence, F.create_map(text(F.col("o_orderkey")), entry)))
    made = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("security_id"), F.to_json(F.struct(block.alias("Financials"))).alias("payload"))
    return payloads.provider_statements(made).select("security_id", "period_type", "period_end", "filed_on", "currency", "provider_item", F.col("value").cast("double").alias("value"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'split' WHEN 1 THEN 'dividend' END AS kind FROM orders")
def z35_action_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    blank = F.lit("")
    row = F.create_map(F.lit("split"), F.when(k == 0, "2/1").otherwise(blank), F.lit("value"), F.when(k == 1, "0.5").otherwise(blank))
    return table(spark, sf_dir, "orders").select("o_orderkey", payloads.action_kind(row).alias("kind"))


@query(
    """SELECT o_orderdate::DATE AS trade_date, round(max(o_totalprice))::DOUBLE AS close, count(*) AS dividends, true AS splits_refused FROM orders WHERE o_custkey % 7 = 0 GROUP BY 1"""
)
def z15_benchmark_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark's bars and dividends from a provider's JSON; one with splits is refused."""
    rows = table(spark, sf_dir, "orders").where("o_custkey % 7 = 0").select(F.lit("index").alias("security_id"), F.lit("GBP").alias("currency"), F.to_date("o_orderdate").alias("date"), F.round("o_totalprice").alias("close"))
    daily = rows.groupBy("security_id", "currency", "date").agg(F.max("close").alias("close"))
    price = [F.col("close").alias(c) for c in ("open", "high", "low", "close")]
    made = daily.select("security_id", "currency", F.to_json(F.array(F.struct("date", *price, F.lit(0).alias("volume")))).alias("payload"))
    paid = rows.select("security_id", F.to_json(F.array(F.struct("date", F.lit("0.1").alias("value"), F.lit("GBP").alias("currency")))).alias("payload"))
    cut = spark.createDataFrame([("index", '[{"date": "1995-01-03", "split": "2/1"}]')], "security_id string, payload string")
    found, dividends = payloads.benchmark_tables(made, paid, cut.where("false"))
    none = refused(lambda: payloads.benchmark_tables(made, paid, cut))
    by_day = dividends.groupBy(F.col("ex_date").alias("trade_date")).agg(F.count("amount").alias("dividends"))
    return found.join(by_day, "trade_date").select("trade_date", F.col("close").cast("double").alias("close"), "dividends", F.lit(none).alias("splits_refused"))


@query(
    """SELECT kind, name, value::DOUBLE AS value FROM (VALUES ('ledger', 'commission_bps', 2.0), ('ledger', 'commission_min', 500.0), ('ledger', 'spread_bps', 10.0), ('ledger', 'stamp_bps', 50.0), ('ledger', 'impact_bps', 25.0),
 ('plans', 'commission_bps', 2.0), ('plans', 'commission_min', 500.0), ('plans', 'spread_bps', 10.0), ('plans', 'stamp_bps', 50.0), ('plans', 'impact_bps', 25.0)) AS t(kind, name, value)"""
)
def z9_cost_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The costs that the ledger and the plans assume if none are given, which must agree."""
    held = (("ledger", ledger.Rules()), ("plans", factors.Costs()))
    rows = [(kind, f.name, float(getattr(of, f.name))) for kind, of in held for f in dataclasses.fields(of) if f.name != "cash"]
    return spark.createDataFrame(rows, "kind string, name string, value double")


@query("SELECT name, value::DOUBLE AS value FROM (VALUES ('extreme_moves.threshold', 0.5), ('stale_runs.least', 5.0), ('low_volume_runs.least', 1.0), ('volume_outliers.times', 20.0), ('volume_outliers.window', 21.0), ('volume_outliers.least', 10.0)) AS t(name, value)")
def z29_validation_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thresholds that checks of bars assume if none are given."""
    rows = [
        (f"{run.__name__}.{name}", float(p.default))
        for run in (prices.extreme_moves, prices.stale_runs, prices.low_volume_runs, prices.volume_outliers)
        for name, p in inspect.signature(run).parameters.items()
        if isinstance(p.default, (int, float)) and name != "limit"
    ]
    return spark.createDataFrame(rows, "name string, value double")


@query("SELECT * FROM (VALUES ('alike', 0), ('another universe', 1), ('another currency', 1), ('prices alone', 1), ('nothing fits', 3), ('unknown', 1)) AS t(benchmark, warnings)")
def b18_suitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"index": {"universe": "all", "currency": "GBP"}}
    asked = {"alike": ("index", "all", "GBP", True), "another universe": ("index", "some", "GBP", True), "another currency": ("index", "all", "USD", True), "prices alone": ("index", "all", "GBP", False), "nothing fits": ("index", "some", "USD", False), "unknown": ("none", "all", "GBP", True)}
    return spark.createDataFrame([(name, len(strategy.suitability(*of, known))) for name, of in asked.items()], "benchmark string, warnings int")


@query("SELECT 'nation' AS name, 'n_nationkey,n_name,n_regionkey' AS columns, 20 AS rows, true AS more UNION ALL SELECT 'region', 'r_regionkey,r_name', 5, false")
def b20_c15_e7_z45_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of two tables, read back from its page: a table that isn't shown whole says so."""
    nation, region = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    page = experiments.html_report("Tables & <rows>", {"nation": nation, "region": region}, most=20)
    parts = re.split("<h2>", page)[1:]
    rows = [(p.split("<")[0], ",".join(re.findall("<th>(.*?)</th>", p)), p.count("<tr><td>"), "Only the first" in p) for p in parts]
    return spark.createDataFrame(rows, "name string, columns string, rows int, more boolean")
