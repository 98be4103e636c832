"""Queries that compose operators: market values, repair, definitions, backtests."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ledger, metrics, prices, strategy
from tidemark.operators.sessions import month_ends
from tidemark.operators.temporal import asof_join
from tidemark.plans.factors import ENDS, SPARSE, window_sql
from tidemark.plans.fixtures import ACTIONS, BARS, EQUITY, actions, bars, equity, table, with_tables
from tidemark.plans.metrics import INDEX, RETS, index_returns
from tidemark.plans.registry import query

SHARES = ", sh AS (SELECT l_suppkey AS security_id, l_shipdate::DATE AS date, max(l_partkey)::DOUBLE AS shares, l_shipdate::DATE + 30 AS available_from FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)"


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    return line.groupBy(F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("date")).agg(F.max("l_partkey").cast("double").alias("shares")).withColumn("available_from", F.date_add("date", 30))


@query(with_tables(BARS, ACTIONS) + SHARES + "SELECT action_id, s.shares FROM actions a ASOF LEFT JOIN sh s ON a.security_id = s.security_id AND a.ex_date >= s.available_from")
def j6_asof_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_join(actions(spark, sf_dir), shares(spark, sf_dir), ["security_id"], "ex_date", "available_from", {"shares": "shares"}).select("action_id", "shares")


@query(
    with_tables(BARS, ACTIONS)
    + """, fx AS (SELECT DISTINCT trade_date AS date, 0.7::DOUBLE + (dayofyear(trade_date) % 20) / 100.0 AS rate FROM bars WHERE day(trade_date) % 2 = 0),
p AS (SELECT action_id, ex_date, a.security_id % 3 AS u, close FROM actions a ASOF LEFT JOIN bars b ON a.security_id = b.security_id AND a.ex_date >= b.trade_date),
q AS (SELECT p.*, CASE WHEN ex_date - date <= 7 THEN rate END AS rate FROM p ASOF LEFT JOIN fx ON p.ex_date >= fx.date)
SELECT action_id, round(CASE u WHEN 0 THEN close / 100 WHEN 1 THEN close ELSE close * rate END, 6) AS pounds FROM q"""
)
def j8_close_in_pounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes quoted in pence, pounds or dollars, by security."""
    found = bars(spark, sf_dir)
    day = F.col("trade_date")
    rates = found.where(F.dayofmonth(day) % 2 == 0).select(F.lit("USD").alias("currency"), day.alias("date"), (0.7 + F.dayofyear(day) % 20 / 100.0).alias("rate")).distinct()
    unit = F.element_at(F.array(F.lit("GBX"), F.lit("GBP"), F.lit("USD")), (F.col("security_id") % 3).cast("int") + 1)
    priced = asof_join(actions(spark, sf_dir), found.select("security_id", "trade_date", "close"), ["security_id"], "ex_date", "trade_date", {"close": "close"}).withColumn("currency", unit)
    dated = asof_join(priced, rates, ["currency"], "ex_date", "date", {"rate": "rate"}, tolerance_days=7, bucket_days=90)
    pounds = F.when(F.col("currency") == "GBX", F.col("close") / 100).when(F.col("currency") == "GBP", F.col("close")).otherwise(F.col("close") * F.col("rate"))
    return dated.select("action_id", F.round(pounds, 6).alias("pounds"))


@query(
    with_tables(BARS) + SHARES + ENDS
    + """, p AS (SELECT e.security_id, e."end", b.close FROM ends e ASOF LEFT JOIN bars b ON e.security_id = b.security_id AND e."end" >= b.trade_date),
c AS (SELECT p.security_id, p."end", close * shares AS cap FROM p ASOF LEFT JOIN sh ON p.security_id = sh.security_id AND p."end" >= sh.available_from)
SELECT security_id, "end", round(cap, 4) AS cap, CASE WHEN cap < 50000 THEN 'small' WHEN cap > 2500000 THEN 'large' END AS flag FROM c WHERE cap < 50000 OR cap > 2500000"""
)
def g24_market_cap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bars(spark, sf_dir)
    ends = found.select("security_id").distinct().crossJoin(F.broadcast(month_ends(found.select("trade_date").distinct(), "trade_date").withColumnRenamed("trade_date", "end")))
    priced = asof_join(ends, found.select("security_id", "trade_date", "close"), ["security_id"], "end", "trade_date", {"close": "close"})
    held = asof_join(priced, shares(spark, sf_dir), ["security_id"], "end", "available_from", {"shares": "shares"}).withColumn("cap", F.col("close") * F.col("shares"))
    return held.where("cap < 50000 OR cap > 2500000").select("security_id", "end", F.round("cap", 4).alias("cap"), F.when(F.col("cap") < 50000, "small").otherwise("large").alias("flag"))


@query(
    with_tables(BARS, ACTIONS, EQUITY) + RETS + INDEX
    + """, j AS (SELECT date, r.ret, br.ret AS base FROM rets r JOIN br USING (date)), w AS (SELECT date, count(ret) OVER x AS n, covar_samp(ret, base) OVER x / var_samp(base) OVER x AS b FROM j WINDOW x AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
SELECT date, CASE WHEN n >= 20 THEN round(b, 8) END AS beta FROM w"""
)
def w13_rolling_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = metrics.returns(equity(spark, sf_dir)).join(index_returns(spark, sf_dir).select("date", F.col("ret").alias("base")), "date")
    return metrics.rolling_days(both, 63, market="base").select("date", F.round("beta", 8).alias("beta"))


@query(
    with_tables(EQUITY)
    + """, e AS (SELECT year(date) AS y, max(date) AS date, arg_max(value, date) AS value FROM equity GROUP BY 1), q AS (SELECT e.*, k, (date - to_years(k::INT))::DATE AS since FROM e CROSS JOIN (VALUES (1), (3), (5)) t(k)),
f AS (SELECT q.date, q.k, q.value, s.value AS base, s.date AS sd FROM q ASOF JOIN equity s ON q.since <= s.date WHERE q.since >= (SELECT min(date) FROM equity))
SELECT date, k::INT AS years, round(pow(value / base, 1.0 / k) - 1, 8) AS ret FROM f"""
)
def w17_rolling_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annualised returns of one, three and five years at year ends, from the first value on or after the day so long before."""
    curve = equity(spark, sf_dir)
    ends = curve.groupBy(F.year("date")).agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))
    asked = ends.withColumn("years", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).withColumn("since", F.expr("add_months(date, -12 * years)"))
    first = curve.agg(F.min("date").alias("first"))
    inside = asked.crossJoin(F.broadcast(first)).where("since >= first").withColumn("_all", F.lit(1))
    found = asof_join(inside, curve.withColumn("_all", F.lit(1)).select("_all", F.col("date").alias("at"), F.col("value").alias("base")), ["_all"], "since", "at", {"base": "base"}, forward=True)
    return found.select("date", "years", F.round(F.pow(F.col("value") / F.col("base"), 1 / F.col("years")) - 1, 8).alias("ret"))


@query(with_tables(ACTIONS) + "SELECT action_id, coalesce(CASE WHEN action_id % 3 <> 0 THEN available_on END, ex_date) AS available_on, action_id % 3 = 0 AS imputed FROM actions")
def f9_imputed_action_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("action_id") % 3 != 0, F.col("available_on"))
    return actions(spark, sf_dir).select("action_id", F.coalesce(known, F.col("ex_date")).alias("available_on"), known.isNull().alias("imputed"))


@query(
    with_tables(BARS, ACTIONS)
    + """, anchored AS (SELECT a.action_id, a.security_id, a.ex_date, CASE WHEN b.trade_date IS NULL THEN 'no_previous_bar' WHEN a.ex_date - b.trade_date > 7 THEN 'stale_previous_bar' ELSE 'ok' END AS status
  FROM actions a ASOF LEFT JOIN bars b ON a.security_id = b.security_id AND a.ex_date > b.trade_date)
SELECT 'adjustment_anchor' AS "check", CASE status WHEN 'no_previous_bar' THEN 'info' ELSE 'error' END AS severity, count(*) AS findings FROM anchored WHERE status <> 'ok' GROUP BY ALL"""
)
def v3_adjustment_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prices.anchored(actions(spark, sf_dir), bars(spark, sf_dir)).where("anchor_status <> 'ok'")
    return found.groupBy(F.lit("adjustment_anchor").alias("check"), F.when(F.col("anchor_status") == "no_previous_bar", "info").otherwise("error").alias("severity")).agg(F.count("*").alias("findings"))


@query(
    with_tables(BARS, ACTIONS)
    + """, s AS (SELECT * FROM actions WHERE action_type = 'split'), b AS (SELECT s.*, b.close AS before FROM s ASOF LEFT JOIN bars b ON s.security_id = b.security_id AND s.ex_date > b.trade_date),
f AS (SELECT b.*, a.close AS after FROM b ASOF LEFT JOIN bars a ON b.security_id = a.security_id AND b.ex_date <= a.trade_date)
SELECT action_id FROM s WHERE action_id NOT IN (SELECT action_id FROM f WHERE before IS NOT NULL AND after IS NOT NULL AND abs(ln(before / after) - ln(2)) > ln(1.25) AND abs(ln(before / after)) <= ln(1.25))"""
)
def v8_j12_repaired_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits without those that prices hold already."""
    splits = actions(spark, sf_dir).where("action_type = 'split'")
    applied = prices.split_audit(splits, bars(spark, sf_dir)).where("verdict = 'PRE_APPLIED'").select("action_id")
    return splits.join(applied, "action_id", "left_anti").select("action_id")


@query(
    with_tables(BARS)
    + """, z AS (SELECT security_id, trade_date, close * CASE WHEN month(trade_date) BETWEEN 4 AND 6 THEN 100.0 ELSE 1.0 END AS close FROM bars),
x AS (SELECT *, close / lag(close) OVER (PARTITION BY security_id ORDER BY trade_date) AS r FROM z),
y AS (SELECT *, sum(CASE WHEN r BETWEEN 70 AND 140 THEN -1 WHEN r BETWEEN 1.0/140 AND 1.0/70 THEN 1 ELSE 0 END) OVER (PARTITION BY security_id ORDER BY trade_date) AS k FROM x),
w AS (SELECT *, max(abs(k)) OVER (PARTITION BY security_id) <= 1 AS fine FROM y)
SELECT security_id, count(*) AS bars, count(*) FILTER (k <> 0) AS rescaled, round(max(close * pow(100, k)), 4) AS highest FROM w WHERE fine GROUP BY 1"""
)
def v9_repair_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that jump between units, brought to their first one; unresolved securities are left out."""
    flipped = bars(spark, sf_dir).withColumn("close", F.col("close") * F.when(F.month("trade_date").between(4, 6), 100.0).otherwise(1.0))
    fixed = prices.unit_flips(flipped).where("resolved").withColumn("close", F.col("close") * F.col("scale"))
    return fixed.groupBy("security_id").agg(F.count("*").alias("bars"), F.count_if(F.col("shift") != 0).alias("rescaled"), F.round(F.max("close"), 4).alias("highest"))


@query(
    with_tables(ACTIONS)
    + """SELECT action_id, CASE action_id % 3 WHEN 0 THEN amount WHEN 1 THEN amount * 100 END AS pence, CASE WHEN action_id % 3 = 2 THEN 'USD not convertible to GBX' END AS warning FROM actions WHERE action_type = 'dividend'"""
)
def z1_z2_quote_unit_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.values import unit_factor

    unit = F.element_at(F.array(F.lit("GBX"), F.lit("GBP"), F.lit("USD")), (F.col("action_id") % 3).cast("int") + 1)
    rows = actions(spark, sf_dir).where("action_type = 'dividend'").withColumn("unit", unit)
    scale = unit_factor(F.col("unit"), F.lit("GBX"))
    return rows.select("action_id", (F.col("amount") * scale).alias("pence"), F.when(scale.isNull(), F.concat("unit", F.lit(" not convertible to GBX"))).alias("warning"))


DEFINITIONS = strategy.Definitions([
    strategy.Definition("momentum", 1, "window_return", {"months": 12, "skip": 1, "coverage": SPARSE}), strategy.Definition("short", 1, "window_return", {"months": 3, "coverage": SPARSE}),
])


@query(
    with_tables(BARS) + window_sql(12, 1) + window_sql(3, 0, "2")
    + """ SELECT 'momentum' AS name, 1 AS version, "end", count(*) AS securities, count(value) AS ok, round(avg(value), 8) AS mean FROM wr GROUP BY ALL
UNION ALL SELECT 'short', 1, "end", count(*), count(value), round(avg(value), 8) FROM wr2 WHERE year("end") > 1995 GROUP BY ALL"""
)
def r15_r16_materialised_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two definitions at all month ends in one plan; the second is stored up to 1995 already."""
    found = bars(spark, sf_dir)
    ends = month_ends(found.select("trade_date").distinct(), "trade_date").withColumnRenamed("trade_date", "end")
    asked = found.select("security_id").distinct().crossJoin(F.broadcast(ends))
    done = ends.where(F.year("end") <= 1995).select(F.lit("short").alias("name"), F.lit(1).alias("version"), "end")
    values = strategy.materialised([DEFINITIONS.get("momentum"), DEFINITIONS.get("short")], asked, found, done)
    return values.groupBy("name", "version", "end").agg(F.count("*").alias("securities"), F.count("value").alias("ok"), F.round(F.avg("value"), 8).alias("mean"))


def simulated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, bars and sessions of two runs of quarterly momentum, with the best 5 and the best 20."""
    found = bars(spark, sf_dir)
    sessions = found.select(F.col("trade_date").alias("session")).distinct()
    ends = month_ends(sessions).where(F.month("session").isin(3, 6, 9, 12) & (F.year("session") >= 1996)).withColumnRenamed("session", "end")
    asked = found.select("security_id").distinct().crossJoin(F.broadcast(ends))
    values = strategy.materialised([DEFINITIONS.get("momentum")], asked, found)
    targets = strategy.decisions(values, sessions, 5, "top5").unionByName(strategy.decisions(values, sessions, 20, "top20"))
    rules = ledger.Rules(cash=Decimal(10_000_000), commission_min=Decimal(1))
    return strategy.backtest(targets, found, all_kinds(spark, sf_dir, found), sessions, rules), found, sessions


def all_kinds(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """The splits and dividends of the market (amounts in pounds of a hundred), every third of them special, and the end
    of some securities: by failure, at the last price, or for cash."""
    known = actions(spark, sf_dir).withColumns({"amount": F.col("amount") / 1000, "reason": F.lit(None).cast("string"), "special": F.col("action_id") % 3 == 0})
    ends = found.groupBy("security_id").agg(F.max("close").alias("high")).where("security_id % 10 < 3").withColumns({
        "action_id": -F.col("security_id"), "ex_date": F.date_add(F.lit("1997-06-02").cast("date"), (F.col("security_id") % 300).cast("int")),
        "action_type": F.when(F.col("security_id") % 10 == 2, "merger").otherwise("delisting"), "new_shares": F.lit(None).cast("int"), "old_shares": F.lit(None).cast("int"),
        "amount": F.when(F.col("security_id") % 10 == 2, F.col("high")), "reason": F.when(F.col("security_id") % 10 == 0, "failure").when(F.col("security_id") % 10 == 1, "acquired"), "special": F.lit(False),
    })
    return known.unionByName(ends.withColumn("available_on", F.col("ex_date")).select(*known.columns))


@query()
def b1_b16_b19_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledgers of two runs; the fold over days has no SQL, see the hand-derived ledger and replay in the tests."""
    return simulated(spark, sf_dir)[0]


@query()
def b19_backtest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric record of each run's value curve, rebuilt from its log alone."""
    events, found, sessions = simulated(spark, sf_dir)
    # the fold and the curve are each read by several branches of the record
    curve = strategy.values_by_day(events.persist(), found, sessions).persist()
    return metrics.metric_record(curve, ["run_id"])
