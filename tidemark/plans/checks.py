"""Queries over provider checks, registries, streams' batch plans and the replay of a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bakeoff as bo
from tidemark.operators import experiments as ex
from tidemark.operators import ledger
from tidemark.plans.fixtures import table
from tidemark.plans.registry import query
from tidemark.streaming import ticks


def keyed(df: DataFrame, key: str) -> DataFrame:
    """Nations as entries of two providers, by the parity of a key."""
    return df.withColumn("provider", F.when(F.col(key) % 2 == 0, "even").otherwise("odd")).withColumn("entry", F.concat(F.lit("c"), F.col(key).cast("string")))


PROVIDER = "CASE WHEN {0} % 2 = 0 THEN 'even' ELSE 'odd' END AS provider, 'c' || {0} AS entry"


@query(
    f"""WITH e AS (SELECT {PROVIDER.format("o_custkey")}, o_orderdate::DATE AS ex_date, 2 AS n, 1 AS o, o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
a AS (SELECT provider, entry, CASE WHEN k % 5 = 0 THEN ex_date + 3 ELSE ex_date END AS ex_date, CASE WHEN k % 7 = 0 THEN 1 WHEN k % 11 = 0 THEN 3 ELSE 2 END AS n, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS o FROM e WHERE k % 13 <> 0),
r AS (SELECT e.provider, e.entry, e.ex_date, min(CASE WHEN e.n * a.o = a.n * e.o AND e.ex_date = a.ex_date THEN 0 WHEN e.n * a.o = a.n * e.o THEN 1 WHEN e.n * a.n = a.o * e.o THEN 2 WHEN a.n IS NOT NULL THEN 3 ELSE 4 END) AS r FROM e LEFT JOIN a ON e.provider = a.provider AND e.entry = a.entry AND abs(e.ex_date - a.ex_date) <= 7 GROUP BY ALL)
SELECT provider, entry, 'split_ratio' AS "check", CASE WHEN r = 0 THEN 'pass' ELSE 'fail' END AS outcome, ['exact', 'other_date', 'inverted_ratio', 'other_ratio', 'missing'][r + 1] AS note FROM r"""
)
def c1_split_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), "o_custkey").withColumn("ex_date", F.to_date("o_orderdate"))
    expected = rows.select("provider", "entry", "ex_date", F.lit(2).alias("new_shares"), F.lit(1).alias("old_shares"))
    k = F.col("o_orderkey")
    actual = rows.where(k % 13 != 0).select(
        "provider", "entry", F.when(k % 5 == 0, F.date_add("ex_date", 3)).otherwise(F.col("ex_date")).alias("ex_date"),
        F.when(k % 7 == 0, 1).when(k % 11 == 0, 3).otherwise(2).alias("new_shares"), F.when(k % 7 == 0, 2).otherwise(1).alias("old_shares"),
    )
    return bo.split_ratio(expected, actual)


@query(
    f"""WITH e AS (SELECT {PROVIDER.format("o_custkey")}, o_orderkey AS k, round(o_totalprice) AS amount FROM orders),
j AS (SELECT provider, entry, amount, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 5 = 0 THEN amount * 100 WHEN k % 3 = 0 THEN amount * 1.1 ELSE amount * 1.001 END AS f FROM e)
SELECT provider, entry, 'dividend_amount' AS "check", CASE WHEN abs(f - amount) / amount <= 0.005 THEN 'pass' ELSE 'fail' END AS outcome,
  CASE WHEN f IS NULL THEN 'missing' WHEN abs(f - amount) / amount <= 0.005 THEN 'within' WHEN abs(f - amount * 100) / (amount * 100) <= 0.005 THEN 'unit' ELSE 'amount' END AS note FROM j"""
)
def c2_dividend_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a day of its own: its key stands for the date."""
    rows = keyed(table(spark, sf_dir, "orders"), "o_custkey").select("provider", "entry", F.col("o_orderkey").alias("ex_date"), F.round("o_totalprice").alias("amount"))
    k = F.col("ex_date")
    actual = rows.where(k % 9 != 0).withColumn("amount", F.col("amount") * F.when(k % 5 == 0, 100.0).when(k % 3 == 0, 1.1).otherwise(1.001))
    return bo.dividend_amount(rows, actual)


BARS = f"b AS (SELECT {PROVIDER.format('o_custkey')}, o_orderdate::DATE AS trade_date, round(o_totalprice) AS close, o_orderkey FROM orders)"


def provider_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(table(spark, sf_dir, "orders"), "o_custkey").select("provider", "entry", F.to_date("o_orderdate").alias("trade_date"), F.round("o_totalprice").alias("close"), "o_orderkey", "o_custkey")


@query(
    f"""WITH {BARS}, l AS (SELECT provider, entry, max(trade_date) AS last FROM b GROUP BY ALL), e AS (SELECT {PROVIDER.format("c_custkey")}, DATE '1998-06-15' AS d FROM customer)
SELECT provider, entry, 'delisted_history' AS "check", CASE WHEN abs(last - d) <= 5 THEN 'pass' ELSE 'fail' END AS outcome, CASE WHEN last IS NULL THEN 'no_rows' WHEN last - d > 5 THEN 'overrun' WHEN last - d < -5 THEN 'shortfall' ELSE 'within' END AS note FROM e LEFT JOIN l USING (provider, entry)"""
)
def c3_delisted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = keyed(table(spark, sf_dir, "customer"), "c_custkey").select("provider", "entry", F.lit("1998-06-15").cast("date").alias("delisted_on"))
    return bo.delisted_history(expected, provider_bars(spark, sf_dir))


@query(f"""WITH {BARS} SELECT provider, entry, 'history_depth' AS "check", CASE WHEN max(trade_date) - min(trade_date) >= 5 * 365 THEN 'pass' ELSE 'fail' END AS outcome, (max(trade_date) - min(trade_date))::VARCHAR AS note FROM b GROUP BY ALL""")
def c4_history_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bo.history_depth(provider_bars(spark, sf_dir), 5)


@query(
    f"""WITH {BARS}, x AS (SELECT provider, entry, close, CASE WHEN entry LIKE '%7' THEN NULL WHEN entry LIKE '%3' THEN close ELSE close * 0.5 END AS pa, close * CASE WHEN entry LIKE '%1' THEN 0.6 ELSE 0.5 END AS rb FROM b),
a AS (SELECT DISTINCT provider, entry FROM b WHERE entry NOT LIKE '%9'),
g AS (SELECT provider, entry, count(pa) AS n, max(abs(rb - pa) / pa) AS err, max(abs(close - pa) / pa) AS raw FROM x GROUP BY ALL),
j AS (SELECT g.*, a.entry IS NOT NULL AS has FROM g LEFT JOIN a USING (provider, entry))
SELECT provider, entry, 'raw_versus_adjusted' AS "check", CASE WHEN n = 0 OR NOT has THEN 'not_applicable' WHEN raw < 1e-9 THEN 'fail' WHEN err <= 0.005 THEN 'pass' ELSE 'fail' END AS outcome,
  CASE WHEN n = 0 THEN 'no_adjusted_series' WHEN NOT has THEN 'no_actions' WHEN raw < 1e-9 THEN 'equals_raw' WHEN err <= 0.005 THEN 'within' ELSE 'reconstruction' END AS note FROM j"""
)
def c5_raw_versus_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ends = provider_bars(spark, sf_dir), lambda c: F.col("entry").endswith(c)
    series = rows.withColumn("provider_adjusted", F.when(ends("7"), F.lit(None)).when(ends("3"), F.col("close")).otherwise(F.col("close") * 0.5)).withColumn("rebuilt", F.col("close") * F.when(ends("1"), 0.6).otherwise(0.5))
    return bo.raw_versus_adjusted(series, rows.where(~ends("9")).select("provider", "entry").distinct())


@query(
    f"""WITH {BARS}, u AS (SELECT provider, entry, trade_date, max(close) AS close FROM b GROUP BY ALL), e AS (SELECT {PROVIDER.format("c_custkey")}, DATE '1995-06-15' AS d FROM customer),
x AS (SELECT e.*, u.trade_date AS bd, u.close AS bc FROM e ASOF LEFT JOIN u ON e.provider = u.provider AND e.entry = u.entry AND e.d > u.trade_date),
y AS (SELECT x.*, u.trade_date AS ad, u.close AS ac FROM x ASOF LEFT JOIN u ON x.provider = u.provider AND x.entry = u.entry AND x.d <= u.trade_date)
SELECT provider, entry, 'ticker_change' AS "check", CASE WHEN ad - bd <= 90 AND abs(ac / bc - 1) <= 0.25 THEN 'pass' ELSE 'fail' END AS outcome,
  CASE WHEN ad IS NULL OR bd IS NULL THEN 'no_history' WHEN ad - bd > 90 THEN 'gap' WHEN abs(ac / bc - 1) > 0.25 THEN 'jump' ELSE 'continuous' END AS note FROM y"""
)
def c6_ticker_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = keyed(table(spark, sf_dir, "customer"), "c_custkey").select("provider", "entry", F.lit("1995-06-15").cast("date").alias("changed_on"))
    daily = provider_bars(spark, sf_dir).groupBy("provider", "entry", "trade_date").agg(F.max("close").alias("close"))
    return bo.ticker_change(expected, daily, days=90)


STATEMENTS = f"""s AS (SELECT {PROVIDER.format("o_custkey")}, o_orderdate::DATE AS period_end, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN o_orderdate::DATE WHEN o_custkey % 5 = 1 THEN o_orderdate::DATE + 30 ELSE o_orderdate::DATE + (o_orderkey % 90)::INT END AS filed_on,
  CASE WHEN o_custkey % 3 = 0 THEN o_orderdate::DATE + 200 END AS revised_on FROM orders)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, c, k = F.to_date("o_orderdate"), F.col("o_custkey"), F.col("o_orderkey")
    filed = F.when(k % 10 == 0, F.lit(None)).when(c % 5 == 0, day).when(c % 5 == 1, F.date_add(day, 30)).otherwise(F.date_add(day, (k % 90).cast("int")))
    return keyed(table(spark, sf_dir, "orders"), "o_custkey").select("provider", "entry", day.alias("period_end"), filed.alias("filed_on"), F.when(c % 3 == 0, F.date_add(day, 200)).alias("revised_on"))


@query(f"""WITH {STATEMENTS} SELECT provider, entry, 'timestamp_presence' AS "check", CASE WHEN avg((filed_on IS NOT NULL)::INT) >= 0.9 THEN 'pass' ELSE 'fail' END AS outcome, floor(avg((filed_on IS NOT NULL)::INT) * 1000)::BIGINT::VARCHAR AS note FROM s GROUP BY ALL""")
def c7_timestamp_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bo.timestamp_presence(statements(spark, sf_dir))


@query(
    f"""WITH {STATEMENTS}, r AS (SELECT *, filed_on - period_end AS lag FROM s WHERE filed_on IS NOT NULL), m AS (SELECT provider, entry, max(c) AS modal FROM (SELECT provider, entry, lag, count(*) AS c FROM r GROUP BY ALL) GROUP BY ALL),
g AS (SELECT provider, entry, count(*) AS n, bool_and(filed_on = period_end) AS ends, bool_or(year(filed_on) < 1980 OR filed_on > DATE '1998-12-01') AS odd, avg((day(filed_on) = 1)::INT) AS firsts FROM r GROUP BY ALL),
x AS (SELECT provider, entry, CASE WHEN ends THEN 'period_ends' WHEN odd THEN 'impossible' WHEN n >= 3 AND modal / n >= 0.9 THEN 'one_lag' WHEN n >= 3 AND firsts >= 0.9 THEN 'firsts_of_months' ELSE 'plausible' END AS note FROM g JOIN m USING (provider, entry))
SELECT provider, entry, 'timestamp_plausibility' AS "check", CASE WHEN note = 'plausible' THEN 'pass' ELSE 'fail' END AS outcome, note FROM x"""
)
def c8_timestamp_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bo.timestamp_plausibility(statements(spark, sf_dir), "1998-12-01")


@query(f"""WITH {STATEMENTS} SELECT provider, entry, 'availability_class' AS "check", CASE WHEN count(filed_on) > 0 THEN 'pass' ELSE 'fail' END AS outcome, CASE WHEN count(filed_on) > 0 AND count(revised_on) > 0 THEN 'point_in_time' WHEN count(filed_on) > 0 THEN 'filing_dates' ELSE 'imputed_only' END AS note FROM s GROUP BY ALL""")
def c9_availability_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bo.availability_class(statements(spark, sf_dir))


@query(
    f"""WITH v AS (SELECT {PROVIDER.format("o_custkey")}, o_orderpriority AS line_item, year(o_orderdate)::INT AS period_end, round(o_totalprice) AS value, o_orderdate, o_orderkey FROM orders),
e AS (SELECT provider, entry, line_item, period_end, arg_min(value, (o_orderdate, o_orderkey)) AS o, arg_max(value, (o_orderdate, o_orderkey)) * 1.005 AS r FROM v GROUP BY ALL),
g AS (SELECT e.provider, e.entry, line_item, period_end, max((abs(value - o) / o <= 0.01)::INT) AS ho, max((abs(value - r) / r <= 0.01)::INT) AS hr FROM e JOIN v USING (provider, entry, line_item, period_end) WHERE v.o_orderkey % 3 <> 0 GROUP BY ALL),
x AS (SELECT e.provider, e.entry, CASE WHEN ho = 1 AND hr = 1 THEN 'both' WHEN hr = 1 THEN 'restated_only' WHEN ho = 1 THEN 'original_only' ELSE 'neither' END AS note FROM e LEFT JOIN g USING (provider, entry, line_item, period_end))
SELECT provider, entry, 'restatement_visibility' AS "check", CASE WHEN note = 'both' THEN 'pass' ELSE 'fail' END AS outcome, note FROM x"""
)
def c10_restatement_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(table(spark, sf_dir, "orders"), "o_custkey").select("provider", "entry", F.col("o_orderpriority").alias("line_item"), F.year("o_orderdate").alias("period_end"), F.round("o_totalprice").alias("value"), F.struct("o_orderdate", "o_orderkey").alias("turn"))
    expected = rows.groupBy("provider", "entry", "line_item", "period_end").agg(F.min_by("value", "turn").alias("original"), (F.max_by("value", "turn") * 1.005).alias("restated"))
    return bo.restatement_visibility(expected, rows.where("turn.o_orderkey % 3 <> 0").drop("turn"))


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS provider, 'c' || event_id AS entry, 'payload_presence' AS \"check\", CASE WHEN octet_length(encode(props)) > 0 THEN 'pass' ELSE 'fail' END AS outcome, octet_length(encode(props))::VARCHAR AS note FROM events")
def c12_payload_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bo.payload_presence(keyed(table(spark, sf_dir, "events"), "event_id").withColumnRenamed("props", "payload"))


@query("SELECT r_name AS provider, n_name AS entry, d AS dataset FROM region CROSS JOIN nation CROSS JOIN (VALUES ('prices'), ('actions')) t(d) WHERE NOT (n_regionkey = r_regionkey AND d = 'prices')")
def c13_pending_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    done = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("provider"), F.col("n_name").alias("entry"), F.lit("prices").alias("dataset"))
    return bo.pending_cells(region.select(F.col("r_name").alias("provider")), nation.select(F.col("n_name").alias("entry")), spark.createDataFrame([("prices",), ("actions",)], "dataset string"), done)


SCORED = """WITH f AS (SELECT c_mktsegment AS provider, CASE WHEN c_custkey % 3 = 0 THEN 'split_ratio' WHEN c_custkey % 3 = 1 THEN 'dividend_amount' ELSE 'history_depth' END AS "check", CASE WHEN c_custkey % 10 = 0 THEN 'not_applicable' WHEN c_acctbal > 2000 THEN 'pass' ELSE 'fail' END AS outcome FROM customer),
c("check", criterion, weight) AS (VALUES ('split_ratio', 'actions', 3.0), ('dividend_amount', 'actions', 3.0), ('history_depth', 'depth', 1.0)),
b AS (SELECT provider, criterion, sum((outcome = 'pass')::INT) / count(*) FILTER (outcome <> 'not_applicable') AS ratio, max(weight) AS weight FROM f JOIN c USING ("check") GROUP BY ALL),
s AS (SELECT provider, sum(ratio * weight) / sum(weight) AS score, count(*) AS measured, bool_or(criterion = 'depth' AND ratio < 0.7) AS barred FROM b GROUP BY 1),
r AS (SELECT *, row_number() OVER w AS rank, score - coalesce(lead(score) OVER w, 0) AS lead FROM s WINDOW w AS (ORDER BY barred, score DESC, provider))
SELECT provider, round(score, 9) AS score, measured, barred, rank::INT AS rank, CASE WHEN barred THEN 'barred' WHEN rank = 1 AND lead >= 0.05 THEN 'recommended' WHEN rank = 1 THEN 'inconclusive' ELSE 'not_first' END AS recommendation FROM r"""


@query(SCORED)
def c14_g27_z39_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    findings = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("provider"), F.when(k % 3 == 0, "split_ratio").when(k % 3 == 1, "dividend_amount").otherwise("history_depth").alias("check"),
        F.when(k % 10 == 0, "not_applicable").when(F.col("c_acctbal") > 2000, "pass").otherwise("fail").alias("outcome"),
    )
    criteria = spark.createDataFrame([("split_ratio", "actions", 3.0), ("dividend_amount", "actions", 3.0), ("history_depth", "depth", 1.0)], "check string, criterion string, weight double")
    return bo.ranked(bo.scored(findings, criteria, ["depth"], 0.7)).withColumn("score", F.round("score", 9))


@query("SELECT 'h' || (o_custkey % 50) AS hypothesis, count(*) AS variants, bool_or(o_orderpriority = '1-URGENT') AS out_of_sample FROM orders GROUP BY 1")
def g31_variant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("out_of_sample"))).otherwise(F.array(F.lit("in_sample")))
    return ex.variants(table(spark, sf_dir, "orders").select(F.concat(F.lit("h"), (F.col("o_custkey") % 50).cast("string")).alias("hypothesis"), tags.alias("tags")))


@query(
    """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY ALL"""
)
def stream_hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.bars(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


LOG = """WITH ev AS (SELECT 'run' || (l_suppkey % 8) AS run_id, l_partkey AS security_id, l_shipdate::DATE AS d, (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity)::BIGINT AS q, (CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * round(l_extendedprice))::BIGINT AS c FROM lineitem)
"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("run"), (F.col("l_suppkey") % 8).cast("string")).alias("run_id"), F.col("l_partkey").alias("security_id"), F.to_date("l_shipdate").alias("on"), (sign * F.col("l_quantity")).cast("long").alias("quantity_delta"),
        (-sign * F.round("l_extendedprice")).cast("decimal(38,10)").alias("cash_delta"), F.when(sign > 0, "buy").otherwise("sell").alias("kind"), F.round("l_extendedprice").alias("price"), F.round(F.col("l_tax") * 100).alias("costs"),
    )


@query(LOG + "SELECT run_id, sum(c)::BIGINT AS cash FROM ev GROUP BY 1")
def b8_replayed_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.replayed(event_log(spark, sf_dir))[0].withColumn("cash", F.col("cash").cast("bigint"))


@query(LOG + "SELECT run_id, security_id, sum(q)::BIGINT AS quantity FROM ev GROUP BY ALL HAVING sum(q) <> 0")
def b8_replayed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.replayed(event_log(spark, sf_dir))[1]


@query(LOG + ", g AS (SELECT run_id, security_id, d, sum(q) AS q FROM ev GROUP BY ALL) SELECT run_id, security_id, d AS \"on\", (sum(q) OVER (PARTITION BY run_id, security_id ORDER BY d))::BIGINT AS quantity FROM g")
def w33_holdings_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.holdings_history(event_log(spark, sf_dir)).select("run_id", "security_id", "on", "quantity")


@query("SELECT 'run' || (l_suppkey % 8) AS run_id, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS kind, count(*) AS events, sum(l_quantity * round(l_extendedprice)) AS value, sum(round(l_tax * 100)) AS costs FROM lineitem GROUP BY ALL")
def g32_portfolio_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.behaviour(event_log(spark, sf_dir))
