"""The domain's tables as projections of the given ones, in Spark and, for the SQL side, as common table expressions.

Prices are whole cents (long) before they become doubles, so both sides hold the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: a supplier is a security, a line of its deliveries a trade."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("trade_date"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long").alias("cents"),
        F.col("l_quantity").cast("long").alias("quantity"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("turn"),
    )
    day = line.groupBy("security_id", "trade_date").agg(
        F.min_by("cents", "turn").alias("o"), F.max("cents").alias("h"), F.min("cents").alias("l"), F.max_by("cents", "turn").alias("c"), F.sum("quantity").alias("volume")
    )
    return day.select("security_id", "trade_date", *[(F.col(a) / 100.0).alias(b) for a, b in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))], "volume")


BARS = """
trades AS (
  SELECT l_suppkey AS security_id, l_shipdate::DATE AS trade_date, round(l_extendedprice / l_quantity * 100)::BIGINT AS cents,
         l_quantity::BIGINT AS quantity, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem),
bars AS (
  SELECT security_id, trade_date,
    first(cents ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) / 100.0 AS open, max(cents) / 100.0 AS high, min(cents) / 100.0 AS low,
    last(cents ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) / 100.0 AS close, sum(quantity)::BIGINT AS volume
  FROM trades GROUP BY ALL)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits and dividends: urgent orders in progress are splits, high ones dividends, of the security with the customer's number."""
    suppliers = table(spark, sf_dir, "supplier").agg(F.count("*").alias("suppliers"))
    order = table(spark, sf_dir, "orders").crossJoin(F.broadcast(suppliers))  # one row, by its aggregate
    split = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    return order.where(split | (F.col("o_orderpriority") == "2-HIGH")).select(
        F.col("o_orderkey").alias("action_id"), (F.col("o_custkey") % F.col("suppliers") + 1).alias("security_id"), F.to_date("o_orderdate").alias("ex_date"),
        F.when(split, "split").otherwise("dividend").alias("action_type"),
        F.when(split, F.lit(2)).alias("new_shares"), F.when(split, F.lit(1)).alias("old_shares"),
        F.when(~split, F.round(F.col("o_totalprice") / 100).cast("long") / 100.0).alias("amount"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 30).cast("int")).alias("available_on"),
    )


ACTIONS = """
actions AS (
  SELECT o_orderkey AS action_id, o_custkey % (SELECT count(*) FROM supplier) + 1 AS security_id, o_orderdate::DATE AS ex_date,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'split' ELSE 'dividend' END AS action_type,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 2 END AS new_shares, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END AS old_shares,
    CASE WHEN o_orderpriority <> '1-URGENT' THEN round(o_totalprice / 100)::BIGINT / 100.0 END AS amount,
    o_orderdate::DATE + (o_orderkey % 30)::INT AS available_on
  FROM orders WHERE (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') OR o_orderpriority = '2-HIGH')"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated facts with revisions: a customer's orders of a year revise its figure for that year."""
    return spark.sql(
        """SELECT o_custkey AS security_id, o_orderpriority AS line_item, make_date(year(o_orderdate), 12, 31) AS period_end,
                  round(o_totalprice * 100)::BIGINT AS cents, o_orderdate::DATE + 90 AS available_on, o_orderkey AS source_id,
                  CASE WHEN o_orderkey % 4 = 0 THEN 'USD' ELSE 'GBP' END AS currency,
                  (row_number() OVER (PARTITION BY o_custkey, o_orderpriority, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1)::INT AS revision
           FROM {orders}""".replace("::BIGINT", "::bigint"),
        orders=table(spark, sf_dir, "orders"),
    )


FACTS = """
facts AS (
  SELECT o_custkey AS security_id, o_orderpriority AS line_item, make_date(year(o_orderdate)::INT, 12, 31) AS period_end,
    round(o_totalprice * 100)::BIGINT AS cents, o_orderdate::DATE + 90 AS available_on, o_orderkey AS source_id,
    CASE WHEN o_orderkey % 4 = 0 THEN 'USD' ELSE 'GBP' END AS currency,
    (row_number() OVER (PARTITION BY o_custkey, o_orderpriority, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1)::INT AS revision
  FROM orders)"""


def spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership: a nation is a universe, a customer a member from its first to its last order of each status."""
    order, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    span = order.groupBy("o_custkey", "o_orderstatus").agg(F.to_date(F.min("o_orderdate")).alias("valid_from"), F.to_date(F.max("o_orderdate")).alias("last"))
    return span.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("universe"), F.col("o_custkey").alias("security_id"), "valid_from",
        F.when(F.col("last") > F.col("valid_from"), F.col("last")).alias("valid_to"), F.col("valid_from").alias("recorded_on"),
        F.when(F.col("c_acctbal") < 0, F.date_add("valid_from", 365)).alias("superseded_on"),
    )


SPELLS = """
spells AS (
  SELECT c_nationkey AS universe, o_custkey AS security_id, valid_from, CASE WHEN last > valid_from THEN last END AS valid_to,
    valid_from AS recorded_on, CASE WHEN c_acctbal < 0 THEN valid_from + 365 END AS superseded_on
  FROM (SELECT o_custkey, o_orderstatus, min(o_orderdate)::DATE AS valid_from, max(o_orderdate)::DATE AS last FROM orders GROUP BY ALL)
  JOIN customer ON o_custkey = c_custkey)"""


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value curve by day: ten million and the running sum of orders, open ones against it."""
    return spark.sql(
        """SELECT day AS date, (1000000000 + sum(cents) OVER (ORDER BY day)) / 100.0D AS value
           FROM (SELECT o_orderdate::DATE AS day, sum(CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END * round(o_totalprice)::bigint) AS cents FROM {orders} GROUP BY 1)""",
        orders=table(spark, sf_dir, "orders"),
    )


EQUITY = """
equity AS (
  SELECT day AS date, (1000000000 + sum(cents) OVER (ORDER BY day))::BIGINT / 100.0::DOUBLE AS value
  FROM (SELECT o_orderdate::DATE AS day, sum(CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END * round(o_totalprice)::BIGINT) AS cents FROM orders GROUP BY 1))"""


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated rates of each nation on the days of its suppliers' deliveries that are weekdays."""
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    days = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("currency"), F.to_date("l_shipdate").alias("date")).distinct()
    return days.where(F.weekday("date") < 5).withColumn("rate", 1 + (F.dayofyear("date") * 7 + F.col("currency") * 13) % 100 / 1000.0)


RATES = """
rates AS (
  SELECT *, 1 + ((dayofyear(date) * 7 + currency * 13) % 100) / 1000.0::DOUBLE AS rate
  FROM (SELECT DISTINCT s_nationkey AS currency, l_shipdate::DATE AS date FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) WHERE isodow(date) < 6)"""


def with_tables(*tables: str) -> str:
    """The WITH clause of these fixtures."""
    return "WITH " + ",".join(tables) + "\n"
