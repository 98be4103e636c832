"""Queries over the point-in-time kernel."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import temporal as t
from tidemark.plans.fixtures import ACTIONS, BARS, FACTS, RATES, SPELLS, actions, bars, facts, rates, spells, table, with_tables
from tidemark.plans.registry import query


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions(spark, sf_dir).where("action_type = 'dividend'").select("action_id", "security_id", "ex_date", "amount")


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("security_id", "trade_date", "close")


def asof_sql(condition: str, order: str, tolerance: str = "") -> str:
    return with_tables(BARS, ACTIONS) + f"""
SELECT d.action_id, d.security_id, d.ex_date, {f"CASE WHEN {tolerance} THEN b.trade_date END" if tolerance else "b.trade_date"} AS price_date,
       {f"CASE WHEN {tolerance} THEN b.close END" if tolerance else "b.close"} AS close
FROM (SELECT * FROM actions WHERE action_type = 'dividend') d ASOF LEFT JOIN bars b ON d.security_id = b.security_id AND d.ex_date {condition} b.trade_date"""


TAKE = {"trade_date": "price_date", "close": "close"}


@query(asof_sql(">=", "DESC"))
def j1_asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = t.asof_join(dividends(spark, sf_dir), closes(spark, sf_dir), ["security_id"], "ex_date", "trade_date", TAKE)
    return joined.select("action_id", "security_id", "ex_date", "price_date", "close")


@query(asof_sql(">=", "DESC", "d.ex_date - b.trade_date <= 3"))
def j2_asof_staleness_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = t.asof_join(dividends(spark, sf_dir), closes(spark, sf_dir), ["security_id"], "ex_date", "trade_date", TAKE, tolerance_days=3)
    return joined.select("action_id", "security_id", "ex_date", "price_date", "close")


@query(asof_sql(">=", "DESC"))
def j3_asof_bucketed_time_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = t.asof_join(dividends(spark, sf_dir), closes(spark, sf_dir), ["security_id"], "ex_date", "trade_date", TAKE, bucket_days=30)
    return joined.select("action_id", "security_id", "ex_date", "price_date", "close")


@query(asof_sql(">", "DESC", "d.ex_date - b.trade_date <= 7"))
def j7_strict_previous_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = t.asof_join(dividends(spark, sf_dir), closes(spark, sf_dir), ["security_id"], "ex_date", "trade_date", TAKE, strict=True, tolerance_days=7)
    return joined.select("action_id", "security_id", "ex_date", "price_date", "close")


@query(asof_sql("<=", "ASC"))
def j16_asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = t.asof_join(dividends(spark, sf_dir), closes(spark, sf_dir), ["security_id"], "ex_date", "trade_date", TAKE, forward=True)
    return joined.select("action_id", "security_id", "ex_date", "price_date", "close")


@query(
    with_tables(RATES)
    + """, o AS (SELECT o_orderkey, c_nationkey AS currency, o_orderdate::DATE AS on_date FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, o.currency, on_date, CASE WHEN on_date - r.date <= 7 THEN r.rate END AS rate,
  CASE WHEN r.date IS NULL OR on_date - r.date > 7 THEN 'no_rate' ELSE 'ok' END AS status
FROM o ASOF LEFT JOIN rates r ON o.currency = r.currency AND o.on_date >= r.date"""
)
def j5_asof_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    dated = order.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("currency"), F.to_date("o_orderdate").alias("on_date"))
    joined = t.asof_join(dated, rates(spark, sf_dir), ["currency"], "on_date", "date", {"rate": "rate"}, tolerance_days=7, bucket_days=90)
    return joined.withColumn("status", F.when(F.col("rate").isNull(), "no_rate").otherwise("ok"))


@query(with_tables(FACTS) + "SELECT security_id, line_item, period_end, revision, cents FROM facts WHERE available_on <= DATE '1996-06-30'")
def p1_as_of_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.as_of(facts(spark, sf_dir), date(1996, 6, 30), "available_on").select("security_id", "line_item", "period_end", "revision", "cents")


VISIBLE = "(recorded_on IS NULL OR recorded_on <= DATE '1996-01-01') AND (superseded_on IS NULL OR superseded_on > DATE '1996-01-01')"


@query(with_tables(SPELLS) + f"SELECT universe, security_id, valid_from, valid_to FROM spells WHERE {VISIBLE}")
def p2_bitemporal_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spells(spark, sf_dir).where(t.visible(date(1996, 1, 1), "recorded_on", "superseded_on")).select("universe", "security_id", "valid_from", "valid_to")


@query(with_tables(SPELLS) + f"SELECT universe, security_id, valid_from, valid_to, recorded_on, NULL::DATE AS superseded_on FROM spells WHERE {VISIBLE}")
def p3_known_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.known_as_of(spells(spark, sf_dir), date(1996, 1, 1), "recorded_on", "superseded_on")


@query(with_tables(SPELLS) + "SELECT universe, security_id, valid_from, valid_to FROM spells WHERE valid_from <= DATE '1997-01-01' AND (valid_to IS NULL OR DATE '1997-01-01' < valid_to)")
def p4_half_open_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spells(spark, sf_dir).where(t.contains(date(1997, 1, 1))).select("universe", "security_id", "valid_from", "valid_to")


@query(
    with_tables(SPELLS)
    + """SELECT a.universe, a.security_id, a.valid_from AS a_from, b.valid_from AS b_from FROM spells a JOIN spells b
ON a.universe = b.universe AND a.security_id = b.security_id AND a.valid_from < b.valid_from AND (b.valid_to IS NULL OR a.valid_from < b.valid_to) AND (a.valid_to IS NULL OR b.valid_from < a.valid_to)"""
)
def p5_range_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = spells(spark, sf_dir).alias("a"), spells(spark, sf_dir).alias("b")
    same = [F.col("a.universe") == F.col("b.universe"), F.col("a.security_id") == F.col("b.security_id"), F.col("a.valid_from") < F.col("b.valid_from")]
    clash = t.overlaps((F.col("a.valid_from"), F.col("a.valid_to")), (F.col("b.valid_from"), F.col("b.valid_to")))
    return a.join(b, [*same, clash]).select("a.universe", "a.security_id", F.col("a.valid_from").alias("a_from"), F.col("b.valid_from").alias("b_from"))


@query(
    with_tables(SPELLS)
    + """, m AS (SELECT *, max(coalesce(valid_to, DATE '9999-12-31')) OVER (PARTITION BY universe, security_id ORDER BY valid_from, valid_to NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spells)
SELECT universe, security_id, min(valid_from) AS valid_from FROM m WHERE valid_from < reached GROUP BY ALL"""
)
def p6_first_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.first_overlap(spells(spark, sf_dir), ["universe", "security_id"]).select("universe", "security_id", "valid_from")


@query(
    with_tables(SPELLS)
    + """, e AS (SELECT o_orderkey, o_custkey AS security_id, o_orderdate::DATE AS on_date FROM orders)
SELECT o_orderkey, e.security_id, on_date, universe, valid_from FROM e JOIN spells s ON e.security_id = s.security_id AND s.valid_from <= on_date AND (s.valid_to IS NULL OR on_date < s.valid_to)"""
)
def j9_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("security_id"), F.to_date("o_orderdate").alias("on_date"))
    return t.interval_join(events, spells(spark, sf_dir), ["security_id"], "on_date").select("o_orderkey", "security_id", "on_date", "universe", "valid_from")


MOVES = """, m AS (SELECT * FROM (SELECT security_id, trade_date, close, lag(close) OVER (PARTITION BY security_id ORDER BY trade_date) AS prev FROM bars) WHERE close >= prev * 1.5 OR close <= prev * 0.5)"""


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    prev = F.lag("close").over(Window.partitionBy("security_id").orderBy("trade_date"))
    return closes(spark, sf_dir).withColumn("prev", prev).where("close >= prev * 1.5D OR close <= prev * 0.5D")


@query(with_tables(BARS, ACTIONS) + MOVES + "SELECT m.security_id, m.trade_date, a.action_id, a.action_type, a.ex_date FROM m JOIN actions a ON m.security_id = a.security_id AND abs(m.trade_date - a.ex_date) <= 3")
def j10_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = actions(spark, sf_dir).select(F.col("security_id").alias("of"), "action_id", "action_type", "ex_date")
    near = t.band_join(moves(spark, sf_dir), act.withColumnRenamed("of", "security_id"), ["security_id"], "trade_date", "ex_date", 3)
    return near.select(F.col("l.security_id"), "trade_date", "action_id", "action_type", "ex_date")


@query(
    with_tables(BARS, ACTIONS) + MOVES
    + "SELECT security_id, trade_date, close, prev FROM m WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.action_type = 'split' AND m.security_id = a.security_id AND abs(m.trade_date - a.ex_date) <= 3)"
)
def j10_band_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.band_join(moves(spark, sf_dir), actions(spark, sf_dir).where("action_type = 'split'").select("security_id", "ex_date"), ["security_id"], "trade_date", "ex_date", 3, "left_anti")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j11_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, order = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return customer.join(order, customer["c_custkey"] == order["o_custkey"], "left_anti").select("c_custkey", "c_name")


SIDES = """WITH a AS (SELECT o_orderdate::DATE AS date, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT l_shipdate::DATE AS date, count(*) AS lines FROM lineitem GROUP BY 1)
"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("orders"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count("*").alias("lines"))
    return t.align(a, b)


@query(SIDES + "SELECT date, orders, lines FROM a JOIN b USING (date)")
def j14_align_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir)[0]


@query(SIDES + "SELECT coalesce(a.date, b.date) AS date, CASE WHEN b.date IS NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON a.date = b.date WHERE a.date IS NULL OR b.date IS NULL")
def u3_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir)[1]


@query("SELECT DISTINCT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def u2_date_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).intersect(table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT event_type, user_id, value FROM events INTERSECT ALL SELECT event_type, user_id, value FROM events WHERE value > 10")
def j15_row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "value")
    return t.same_rows(events, events.where("value > 10"))


@query(
    with_tables(SPELLS)
    + """SELECT universe, security_id, valid_from AS effective, 'added' AS change FROM spells WHERE valid_from > DATE '1995-01-01' AND valid_from <= DATE '1996-01-01'
UNION ALL SELECT universe, security_id, valid_to, 'removed' FROM spells WHERE valid_to > DATE '1995-01-01' AND valid_to <= DATE '1996-01-01'"""
)
def u5_membership_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.membership_changes(spells(spark, sf_dir), date(1995, 1, 1), date(1996, 1, 1))


@query(
    with_tables(FACTS)
    + """SELECT security_id, line_item, period_end, revision, cents, row_number() OVER (PARTITION BY security_id, line_item, period_end ORDER BY revision)::INT AS n FROM facts
QUALIFY row_number() OVER (PARTITION BY security_id, line_item, period_end ORDER BY revision) = 1"""
)
def u6_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turn = Window.partitionBy("security_id", "line_item", "period_end").orderBy("revision")
    return facts(spark, sf_dir).withColumn("n", F.row_number().over(turn)).where("n = 1").select("security_id", "line_item", "period_end", "revision", "cents", "n")
