"""Queries over stores, guards, orderings and the smaller operators."""

from __future__ import annotations

import tempfile
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import stats, values
from tidemark.operators import factors as fa
from tidemark.operators import fundamentals as fu
from tidemark.operators import master as ms
from tidemark.operators import metrics, prices, sessions, universe
from tidemark.operators.temporal import asof_join
from tidemark.plans.fixtures import ACTIONS, BARS, EQUITY, FACTS, SPELLS, actions, bars, equity, facts, spells, table, with_tables
from tidemark.plans.master import IDENTIFIERS, identifiers
from tidemark.plans.metrics import INDEX, RETS, index_returns
from tidemark.plans.prices import FACTORS
from tidemark.plans.records import LATEST, MAPPING, MAPPING_SQL, normalised
from tidemark.plans.registry import query
from tidemark.sources import stores


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the folder that the session shares with its executors; one of its own only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select(
        F.col("security_id").cast("string").alias("security_id"), "trade_date", "open", "high", "low", "close", "volume", F.lit("GBX").alias("currency"), F.lit("given").alias("source"),
        F.lit("2002-01-01").cast("timestamp").alias("ingested_at"), F.lit(None).cast("double").alias("provider_adjusted_close"),
    )


@query(with_tables(BARS) + "SELECT security_id::VARCHAR AS security_id, trade_date, close, volume FROM bars WHERE trade_date BETWEEN DATE '1996-11-15' AND DATE '1998-02-10'")
def s2_s3_s4_s6_s11_price_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the bars written, then all of them: what is stored stays, what is new is appended; read back by range."""
    root, rows = scratch(spark, "prices"), priced(spark, sf_dir)
    stores.write_prices(rows.where("close > 1000"), root)
    stores.write_prices(rows, root)
    return stores.read_prices(spark, root, start=date(1996, 11, 15), end=date(1998, 2, 10)).select("security_id", "trade_date", F.col("close").cast("double").alias("close"), "volume")


@query(with_tables(FACTS) + "SELECT security_id::VARCHAR AS security_id, line_item, period_end, revision AS revision_sequence, cents / 100.0 AS value FROM facts WHERE line_item IN ('1-URGENT', '5-LOW') AND period_end >= DATE '1997-01-01'")
def s7_s8_fundamentals_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "fundamentals")
    stamp = F.col("available_on").cast("timestamp")
    rows = facts(spark, sf_dir).select(
        F.col("security_id").cast("string").alias("security_id"), F.lit("income").alias("statement"), "line_item", "period_end", F.lit("annual").alias("period_type"), "currency", (F.col("cents") / 100.0).alias("value"), F.lit(None).cast("timestamp").alias("filed_at"),
        stamp.alias("available_at"), F.when(F.col("revision") > 0, stamp).alias("revised_at"), F.col("revision").alias("revision_sequence"), F.lit("given").alias("source"), F.lit(True).alias("availability_imputed"), F.lit("period_end+90d").alias("imputation_rule"),
    )
    stores.write_fundamentals(rows.where("revision_sequence = 0"), root)
    stores.write_fundamentals(rows, root)
    return stores.read_fundamentals(spark, root, items=["1-URGENT", "5-LOW"], start=date(1997, 1, 1)).select("security_id", "line_item", "period_end", "revision_sequence", F.col("value").cast("double").alias("value"))


@query(with_tables(FACTS) + "SELECT DISTINCT line_item FROM facts")
def s9_known_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("line_item").distinct()


@query(with_tables(SPELLS) + "SELECT 'u' || universe AS universe, security_id::VARCHAR AS security_id, min(valid_from) AS valid_from FROM spells GROUP BY ALL")
def s10_u4_x11_universe_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spell a name, checked against the registered universes and known securities, written and read back."""
    root = scratch(spark, "universe")
    one = spells(spark, sf_dir).groupBy("universe", "security_id").agg(F.min("valid_from").alias("valid_from"))
    rows = one.select(F.concat(F.lit("u"), F.col("universe").cast("string")).alias("universe"), F.col("security_id").cast("string").alias("security_id"), "valid_from", F.lit(None).cast("date").alias("valid_to"), F.lit(None).cast("timestamp").alias("recorded_at"), F.lit(None).cast("timestamp").alias("superseded_at"), F.lit("given").alias("source"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("security_id"))
    stores.write_universe(rows, root, [f"u{k}" for k in range(25)], known)
    return stores.read_universe(spark, root).select("universe", "security_id", "valid_from")


@query("SELECT c_custkey::VARCHAR AS security_id, 'N' || c_nationkey AS entity_id FROM customer")
def s12_s13_security_master_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, customer = scratch(spark, "master"), table(spark, sf_dir, "customer")
    empty = {n: spark.createDataFrame([], f) for n, f in stores.MASTER.items()}
    entities = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("country"))
    securities = customer.select(F.col("c_custkey").cast("string").alias("security_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("entity_id"), F.lit("share").alias("security_type"), F.col("c_name").alias("name"))
    stores.write_master({**empty, "entities": entities, "securities": securities}, root)
    held = stores.read_master(spark, root)
    return held["securities"].join(held["entities"], "entity_id").select("security_id", "entity_id")


@query("SELECT c_custkey::VARCHAR AS security_id, c_nationkey AS n, round(c_acctbal, 2) AS value, 'balance' AS name, 1 AS version FROM customer")
def s14_s15_s16_p10_factor_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged factor values written where none were, and read with the columns of their path."""
    root, customer = scratch(spark, "factors"), table(spark, sf_dir, "customer")
    frame = customer.select(F.col("c_custkey").cast("string").alias("security_id"), F.lit("ok").alias("status"), F.round("c_acctbal", 2).alias("value"), F.col("c_nationkey").alias("n"), F.lit(date(1998, 1, 30)).alias("end"))
    stores.write_factor_values(fa.tagged(frame, "balance", 1, {"customer": "v1"}), root)
    return spark.read.parquet(root).select("security_id", "n", "value", "name", "version")


@query(with_tables(ACTIONS) + "SELECT security_id, ex_date, new_shares, amount FROM actions")
def s31_u1_action_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits and dividends of two tables as one, columns that a table lacks as nulls."""
    root, found = scratch(spark, "actions"), actions(spark, sf_dir)
    stores.write_new(found.where("action_type = 'split'").select("security_id", "ex_date", "new_shares"), f"{root}/splits")
    stores.write_new(found.where("action_type = 'dividend'").select("security_id", "ex_date", "amount"), f"{root}/dividends")
    return stores.load_actions(spark, [f"{root}/splits", f"{root}/dividends"])


@query("SELECT r_name AS region, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def f30_file_name_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column from the names of files' folders."""
    from tidemark.sources import console

    root = scratch(spark, "regions")
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    for name in [r[0] for r in rows.select("r_name").distinct().collect()]:  # five regions
        stores.write_new(rows.where(F.col("r_name") == name).select("n_name"), f"{root}/{name}")
    console.open_views(spark, {"console_regions": f"{root}/*"}, {"console_regions": "region"})
    return console.run(spark, "SELECT replace(region, '%20', ' ') AS region, count(*) AS nations FROM console_regions GROUP BY 1")


@query(
    with_tables(BARS, ACTIONS)
    + "SELECT action_id, CASE WHEN d - b.trade_date <= 15 THEN close END AS price FROM (SELECT *, ex_date - 1 AS d FROM actions) a ASOF LEFT JOIN bars b ON a.security_id = b.security_id AND a.d >= b.trade_date"
)
def j4_clock_bound_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price that was known on the day before, at most 15 days old."""
    clock = actions(spark, sf_dir).withColumn("clock", F.date_sub("ex_date", 1))
    return asof_join(clock, bars(spark, sf_dir).select("security_id", "trade_date", "close"), ["security_id"], "clock", "trade_date", {"close": "price"}, tolerance_days=15).select("action_id", "price")


@query(
    with_tables(BARS, ACTIONS, EQUITY) + RETS + INDEX
    + "SELECT count(*) AS n, CASE WHEN count(*) >= 60 THEN round(regr_slope(r.ret, br.ret), 9) END AS beta FROM rets r JOIN br USING (date)"
)
def g11_j13_j21_report_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = metrics.returns(equity(spark, sf_dir)).join(index_returns(spark, sf_dir).select("date", F.col("ret").alias("base")), "date")
    return both.agg(F.count("*").alias("n"), F.when(F.count("*") >= 60, F.round(F.regr_slope("ret", "base"), 9)).alias("beta"))


@query("WITH m AS (SELECT c_nationkey AS grp, c_acctbal AS x, median(c_acctbal) OVER (PARTITION BY c_nationkey) AS md FROM customer) SELECT grp, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(max(md), 6) AS median, round(median(abs(x - md)), 6) AS mad FROM m GROUP BY 1")
def g12_cross_section_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("x")).withColumn("md", stats.percentile(F.col("x"), 0.5).over(Window.partitionBy("grp")))
    return rows.groupBy("grp").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("sd"), F.round(F.max("md"), 6).alias("median"), F.round(F.median(F.abs(F.col("x") - F.col("md"))), 6).alias("mad"))


@query(with_tables(ACTIONS) + "SELECT security_id, median(amount) AS family, min(ex_date) AS first, max(ex_date) AS last FROM actions WHERE action_type = 'dividend' GROUP BY 1")
def g18_g22_family_median_and_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions(spark, sf_dir).where("action_type = 'dividend'").groupBy("security_id").agg(F.median("amount").alias("family"), F.min("ex_date").alias("first"), F.max("ex_date").alias("last"))


@query(with_tables(FACTS) + MAPPING_SQL + "SELECT coalesce(canonical, CASE WHEN review_status IS NULL THEN 'unmapped' ELSE 'excluded' END) AS name, count(*) AS items, CASE WHEN canonical IS NULL THEN 'unmapped' ELSE 'mapped' END AS outcome FROM facts LEFT JOIN mp ON line_item = provider_item GROUP BY ALL")
def g28_f27_normalisation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.normalisation_summary(*normalised(spark, sf_dir))


@query("SELECT o_orderkey, (o_totalprice / 3)::DECIMAL(38, 6)::DOUBLE AS exact, (o_orderdate::DATE + 1) AS rate_known, (o_orderkey % 130)::INT AS lag, (o_orderkey % 130) > 5 AS trusted FROM orders")
def f8_f11_f14_f15_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders").withColumn("end", F.to_date("o_orderdate")).withColumn("filed", F.date_add("end", (F.col("o_orderkey") % 130).cast("int")))
    lag = F.datediff("filed", "end")
    return order.select("o_orderkey", values.quantised(F.col("o_totalprice") / 3, 6).cast("double").alias("exact"), F.date_add("end", 1).alias("rate_known"), lag.alias("lag"), (lag > 5).alias("trusted"))


@query(with_tables(BARS) + ", r AS (SELECT security_id, trade_date, close / lag(close) OVER (PARTITION BY security_id ORDER BY trade_date) AS x FROM bars) SELECT security_id, trade_date, CASE WHEN x BETWEEN 1.96 AND 2.04 THEN 'double' WHEN x BETWEEN 0.49 AND 0.51 THEN 'half' WHEN x BETWEEN 70 AND 140 THEN 'hundred' ELSE 'none' END AS class FROM r WHERE x IS NOT NULL")
def f16_f17_ratio_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("close") / F.lag("close").over(prices.series())
    rows = bars(spark, sf_dir).select("security_id", "trade_date", ratio.alias("x")).where("x IS NOT NULL")
    return rows.select("security_id", "trade_date", F.when(F.col("x").between(1.96, 2.04), "double").when(F.col("x").between(0.49, 0.51), "half").when(F.col("x").between(70, 140), "hundred").otherwise("none").alias("class"))


@query("SELECT c_custkey, c_nationkey, (row_number() OVER (ORDER BY c_nationkey NULLS LAST, c_acctbal DESC, c_custkey))::INT AS place FROM customer QUALIFY place <= 50")
def k3_k4_k6_ordered_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 rows of a total order, as a console shows them."""
    head = table(spark, sf_dir, "customer").orderBy(F.col("c_nationkey").asc_nulls_last(), F.desc("c_acctbal"), "c_custkey").limit(50)
    place = F.row_number().over(Window.orderBy(F.col("c_nationkey").asc_nulls_last(), F.desc("c_acctbal"), "c_custkey"))
    return head.select("c_custkey", "c_nationkey", place.alias("place"))


@query(
    IDENTIFIERS
    + """, t AS (SELECT *, valid_from + 10 AS recorded_on, CASE WHEN security_id % 4 = 0 THEN valid_from + 400 END AS superseded_on FROM ident), k AS (SELECT * FROM t WHERE recorded_on <= DATE '1997-06-30' AND (superseded_on IS NULL OR superseded_on > DATE '1997-06-30')),
r AS (SELECT c_custkey AS request_id, 'I' || c_custkey AS value FROM customer), g AS (SELECT request_id, count(DISTINCT security_id) AS n, min(security_id) AS s FROM r LEFT JOIN k ON k.kind = 'isin' AND k.value = r.value AND k.valid_from <= DATE '1997-01-01' AND (k.valid_to IS NULL OR DATE '1997-01-01' < k.valid_to) GROUP BY 1)
SELECT request_id, CASE WHEN n = 1 THEN s END AS security_id, CASE WHEN n = 0 THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM g"""
)
def m3_point_in_time_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = identifiers(spark, sf_dir).withColumns({"recorded_on": F.date_add("valid_from", 10), "superseded_on": F.when(F.col("security_id") % 4 == 0, F.date_add("valid_from", 400))})
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.lit("isin").alias("kind"), F.concat(F.lit("I"), F.col("c_custkey").cast("string")).alias("value"), F.lit(date(1997, 1, 1)).alias("on"))
    return ms.resolve(requests, held, date(1997, 6, 30))


@query("SELECT c_custkey AS security_id, CASE WHEN c_acctbal < 0 THEN 'X1' ELSE 'X0' END AS mic FROM customer WHERE c_acctbal <= 5000")
def m9_m10_m12_dispatched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves and delistings applied in one batch; what is listed afterwards."""
    customer = table(spark, sf_dir, "customer")
    key, day = F.col("c_custkey").alias("security_id"), lambda *d: F.lit(date(*d))
    open_row = {"valid_from": day(1996, 1, 1), "valid_to": F.lit(None).cast("date"), "recorded_on": day(1996, 1, 1), "superseded_on": F.lit(None).cast("date")}
    listings = customer.select(key, F.lit("X0").alias("mic")).withColumns(open_row)
    tickers = customer.select(key, F.lit("ticker").alias("kind"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("value")).withColumns(open_row)
    kind = F.when(F.col("c_acctbal") > 5000, "delisting").when(F.col("c_acctbal") < 0, "exchange_move").otherwise("ticker_change")
    events = customer.select(kind.alias("kind"), key, day(1998, 1, 1).alias("effective"), day(1998, 2, 1).alias("recorded"), F.when(kind == "exchange_move", "X1").otherwise("NEW").alias("value"))
    out = ms.dispatched({"identifiers": tickers, "listings": listings}, events)
    return out["listings"].where("valid_to IS NULL AND superseded_on IS NULL").select("security_id", "mic")


@query("SELECT * FROM (VALUES ('a', 'mapped_twice'), ('b', 'unknown_canonical'), ('c', 'unknown_sign'), ('d', 'other_statement'), ('e', 'excluded_with_target')) t(provider_item, fault)")
def n6_mapping_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = [("a", "income", "revenue", "flip", "verified"), ("a", "income", "cost", "flip", "verified"), ("b", "income", "nothing", "flip", "verified"), ("c", "income", "cost", "odd", "verified"), ("d", "balance", "revenue", "flip", "verified"), ("e", "income", "cost", "flip", "excluded")]
    taxonomy = spark.createDataFrame([("revenue", "income"), ("cost", "income")], "canonical string, statement string")
    return fu.mapping_faults(spark.createDataFrame(mapping, "provider_item string, statement string, canonical string, sign string, review_status string"), taxonomy)


@query(
    with_tables(FACTS) + MAPPING_SQL
    + """SELECT security_id, canonical AS line_item, period_end, CASE WHEN sign = 'flip' THEN -cents ELSE cents END AS value, CASE WHEN source_id % 100 > 5 THEN period_end + (source_id % 100)::INT ELSE period_end + 120 END AS available_on, source_id % 100 <= 5 AS availability_imputed FROM facts JOIN mp ON line_item = provider_item WHERE review_status = 'verified'"""
)
def n8_canonicalised_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = facts(spark, sf_dir).select("security_id", F.lit("income").alias("statement"), F.col("line_item").alias("provider_item"), "period_end", F.lit("annual").alias("period_type"), "currency", F.col("cents").alias("value"), F.date_add("period_end", (F.col("source_id") % 100).cast("int")).alias("filed_on"))
    mapping = spark.createDataFrame(MAPPING, "provider_item string, canonical string, sign string, review_status string")
    return fu.canonicalised(items, mapping).select("security_id", "line_item", "period_end", "value", "available_on", "availability_imputed")


@query(with_tables(BARS, ACTIONS) + FACTORS + ", x AS (SELECT security_id, max(trade_date) AS last, round(ln(arg_min(close * split_factor * dividend_factor, trade_date)), 6) AS first_log, count(*) AS bars FROM factors GROUP BY 1) SELECT * FROM x")
def w8_w9_adjusted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prices.adjusted(bars(spark, sf_dir), actions(spark, sf_dir))
    return found.groupBy("security_id").agg(F.max("trade_date").alias("last"), F.round(F.ln(F.min_by("adjusted", "trade_date")), 6).alias("first_log"), F.count("*").alias("bars"))


@query(with_tables(BARS) + ", r AS (SELECT security_id, close / lag(close) OVER (PARTITION BY security_id ORDER BY trade_date) - 1 AS ret FROM bars) SELECT security_id, count(ret) AS returns, CASE WHEN count(ret) >= 20 THEN round(stddev_samp(ret) * sqrt(252.0), 7) END AS volatility FROM r GROUP BY 1")
def w20_guarded_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = prices.daily_returns(bars(spark, sf_dir))
    return rets.groupBy("security_id").agg(F.count("ret").alias("returns"), F.when(F.count("ret") >= 20, F.round(stats.annualised_volatility(F.col("ret")), 7)).alias("volatility"))


@query(with_tables(BARS) + ", c AS (SELECT security_id, trade_date, CASE WHEN (close > open) = lag(close > open) OVER w THEN 0 ELSE 1 END AS ch FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY trade_date)) SELECT security_id, trade_date, (sum(ch) OVER (PARTITION BY security_id ORDER BY trade_date))::BIGINT AS run FROM c")
def w22_run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.col("close") > F.col("open")
    return prices.runs(bars(spark, sf_dir).withColumn("_up", up), F.col("_up") != F.lag("_up").over(prices.series())).select("security_id", "trade_date", "run")


@query("SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey))::INT AS place FROM customer")
def w29_ordinal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("place"))


@query(
    with_tables(BARS)
    + """, d AS (SELECT DISTINCT trade_date AS session FROM bars WHERE isodow(trade_date) < 6 AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'), k AS (SELECT session, row_number() OVER (ORDER BY session) AS k FROM d),
l AS (SELECT s_suppkey AS security_id, DATE '1996-06-01' + (s_suppkey * 3)::INT AS a, CASE WHEN s_suppkey % 2 = 0 THEN DATE '1997-09-01' END AS z FROM supplier),
e AS (SELECT security_id, session, k FROM l JOIN k ON session >= a AND (z IS NULL OR session < z)), m AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.security_id = e.security_id AND b.trade_date = e.session)),
i AS (SELECT *, k - row_number() OVER (PARTITION BY security_id ORDER BY k) AS i FROM m) SELECT security_id, min(session) AS start, max(session) AS "end", count(*) AS sessions FROM i GROUP BY security_id, i"""
)
def j20_z26_listing_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bars(spark, sf_dir)
    days = found.select(F.col("trade_date").alias("session")).distinct().where(F.weekday("session") < 5).where("session BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
    k = F.col("s_suppkey")
    listings = table(spark, sf_dir, "supplier").select(k.alias("security_id"), F.date_add(F.lit(date(1996, 6, 1)), (k * 3).cast("int")).alias("valid_from"), F.when(k % 2 == 0, F.lit(date(1997, 9, 1))).alias("valid_to"))
    return sessions.listing_gaps(listings, found, days)


@query(with_tables(FACTS) + f"SELECT period_end, count(*) AS facts, count(*) FILTER (revision > 0) AS restated FROM (SELECT * FROM facts WHERE available_on <= DATE '1998-12-31' {LATEST}) GROUP BY 1")
def z33_restated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fu.point_in_time(facts(spark, sf_dir), date(1998, 12, 31))
    return held.groupBy("period_end").agg(F.count("*").alias("facts"), F.count_if(F.col("revision") > 0).alias("restated"))


@query("SELECT p_partkey, len(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) AS words FROM part")
def z23_name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.size(universe.name_tokens(F.col("p_name"))).cast("bigint").alias("words"))
