"""Queries over identifiers and scalar functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import identifiers as ids
from tidemark.functions import values as v
from tidemark.operators import master as ms
from tidemark.operators import prices
from tidemark.plans.fixtures import BARS, bars, table, with_tables
from tidemark.plans.registry import query


@query("SELECT o_orderkey, (d + INTERVAL 7 MONTH)::DATE AS later, (d - INTERVAL 1 MONTH)::DATE AS earlier FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def f1_shift_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", v.shift_months(day, 7).alias("later"), v.shift_months(day, -1).alias("earlier"))


LUHN = """list_sum(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN substr(t, i, 1)::INT > 4 THEN substr(t, i, 1)::INT * 2 - 9 ELSE substr(t, i, 1)::INT * 2 END ELSE substr(t, i, 1)::INT END)) % 10 = 0"""


@query(
    f"""WITH x AS (SELECT c_custkey, 'GB' || lpad((c_custkey * 7919)::VARCHAR, 8, '0') || chr((65 + c_custkey % 26)::INT) || (c_custkey % 10)::VARCHAR AS isin FROM customer),
s AS (SELECT c_custkey, isin, reverse(array_to_string(list_transform(string_split(isin, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), '')) AS t FROM x)
SELECT c_custkey, isin, {LUHN} AS valid FROM s"""
)
def f2_isin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    isin = F.concat(F.lit("GB"), F.lpad((key * 7919).cast("string"), 8, "0"), F.char(65 + key % 26), (key % 10).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", isin.alias("isin")).withColumn("valid", ids.isin_is_valid(F.col("isin")))


@query(
    """WITH x AS (SELECT c_custkey, substr('BCDFGHJKLM', (c_custkey % 10)::INT + 1, 1) || lpad(((c_custkey * 31) % 100000)::VARCHAR, 5, '0') || ((c_custkey // 7) % 10)::VARCHAR AS sedol FROM customer)
SELECT c_custkey, sedol, list_sum(list_transform(range(1, 8), lambda i: (CASE WHEN substr(sedol, i, 1) BETWEEN '0' AND '9' THEN substr(sedol, i, 1)::INT ELSE ascii(substr(sedol, i, 1)) - 55 END) * [1, 3, 1, 7, 3, 9, 1][i])) % 10 = 0 AS valid FROM x"""
)
def f3_sedol_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    sedol = F.concat(F.substring(F.lit("BCDFGHJKLM"), (key % 10).cast("int") + 1, F.lit(1)), F.lpad((key * 31 % 100000).cast("string"), 5, "0"), (F.floor(key / 7) % 10).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", sedol.alias("sedol")).withColumn("valid", ids.sedol_is_valid(F.col("sedol")))


@query(
    """WITH x AS (SELECT c_custkey, lpad(((c_custkey * 104729) % 10000000)::VARCHAR, 7, '0') || substr('AZ*@#', (c_custkey % 5)::INT + 1, 1) || ((c_custkey // 3) % 10)::VARCHAR AS cusip FROM customer),
s AS (SELECT *, list_sum(list_transform(list_transform(range(1, 9), lambda i: (CASE substr(cusip, i, 1) WHEN '*' THEN 36 WHEN '@' THEN 37 WHEN '#' THEN 38 ELSE CASE WHEN substr(cusip, i, 1) BETWEEN '0' AND '9' THEN substr(cusip, i, 1)::INT ELSE ascii(substr(cusip, i, 1)) - 55 END END) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)), lambda d: d // 10 + d % 10)) AS total FROM (SELECT c_custkey, cusip FROM x))
SELECT c_custkey, cusip, (10 - total % 10) % 10 = substr(cusip, 9, 1)::INT AS valid FROM s""".replace("CASE substr(cusip, i, 1) WHEN '*' THEN 36 WHEN '@' THEN 37 WHEN '#' THEN 38 ELSE CASE WHEN substr(cusip, i, 1) BETWEEN '0' AND '9' THEN substr(cusip, i, 1)::INT ELSE ascii(substr(cusip, i, 1)) - 55 END END", "CASE WHEN substr(cusip, i, 1) = '*' THEN 36 WHEN substr(cusip, i, 1) = '@' THEN 37 WHEN substr(cusip, i, 1) = '#' THEN 38 WHEN substr(cusip, i, 1) BETWEEN '0' AND '9' THEN try_cast(substr(cusip, i, 1) AS INT) ELSE ascii(substr(cusip, i, 1)) - 55 END")
)
def f4_cusip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    cusip = F.concat(F.lpad((key * 104729 % 10000000).cast("string"), 7, "0"), F.substring(F.lit("AZ*@#"), (key % 5).cast("int") + 1, F.lit(1)), (F.floor(key / 3) % 10).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", cusip.alias("cusip")).withColumn("valid", ids.cusip_is_valid(F.col("cusip")))


@query(
    """WITH x AS (SELECT o_orderkey, round(o_totalprice) AS a, ['GBP', 'GBX', 'USD'][(o_orderkey % 3)::INT + 1] AS u FROM orders)
SELECT o_orderkey, u AS unit, CASE WHEN u = 'USD' THEN NULL ELSE round(CASE WHEN u = 'GBX' THEN a / 100 ELSE a END, 4) END AS pounds,
  round(CASE WHEN u = 'GBX' THEN a / 100 ELSE a END * CASE WHEN u = 'USD' THEN 0.8 ELSE 1 END * 100, 4) AS pence, round_even(a / 7, 2) AS even FROM x"""
)
def f5_f6_f7_units_and_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount, unit = F.round("o_totalprice"), F.element_at(F.array(F.lit("GBP"), F.lit("GBX"), F.lit("USD")), (F.col("o_orderkey") % 3).cast("int") + 1)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", amount.alias("a"), unit.alias("unit"))
    a, u = F.col("a"), F.col("unit")
    return rows.select(
        "o_orderkey", "unit", F.round(a * v.unit_factor(u, F.lit("GBP")), 4).alias("pounds"),
        F.round(v.converted(a, u, F.lit("GBX"), F.when(u == "USD", 0.8).otherwise(1.0)), 4).alias("pence"), v.half_even(a / 7, 2).alias("even"),
    )


@query(
    """WITH x AS (SELECT p_partkey, (p_size % 12 + 1)::BIGINT AS a, (p_partkey % 8 + 1)::BIGINT AS b FROM part)
SELECT p_partkey, a // gcd(a, b) AS new_shares, b // gcd(a, b) AS old_shares FROM x"""
)
def f26_s21_split_ratio_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, form = (F.col("p_size") % 12 + 1).cast("string"), (F.col("p_partkey") % 8 + 1).cast("string"), F.col("p_partkey") % 4
    text = F.when(form == 0, F.concat(a, F.lit(":"), b)).when(form == 1, F.concat(a, F.lit(".000/"), b, F.lit(".000"))).when(form == 2, F.concat(a, F.lit("-for-"), b)).otherwise(F.concat(a, F.lit(" for "), b))
    new, old = v.split_ratio(F.col("text"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).select("p_partkey", new.alias("new_shares"), old.alias("old_shares"))


@query("""SELECT p_partkey, substr(sha256('{"brand":"' || p_brand || '","size":"' || p_size || '"}'), 1, 16) AS hash FROM part""")
def f21_parameter_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", v.parameter_hash(made).alias("hash"))


@query(
    """SELECT event_id, ts::DATE AS day, CASE event_id % 4 WHEN 0 THEN 'GBX' WHEN 1 THEN 'GBX' WHEN 2 THEN 'GBP' ELSE 'USD' END AS unit, CASE event_id % 3 WHEN 0 THEN 'annual' WHEN 1 THEN 'interim' ELSE 'quarterly' END AS period FROM events"""
)
def f24_f25_f29_tolerant_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, k = F.col("ts"), F.col("event_id")
    day = F.when(k % 4 == 0, F.date_format(ts, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(ts, "yyyy/MM/dd")).when(k % 4 == 2, F.date_format(ts, "dd/MM/yyyy")).otherwise(F.date_format(ts, "yyyyMMdd"))
    unit = F.when(k % 4 == 0, " GBp ").when(k % 4 == 1, "pence").when(k % 4 == 2, "gbp").otherwise("usd")
    period = F.when(k % 3 == 0, " FY").when(k % 3 == 1, "H1").otherwise("q3")
    return table(spark, sf_dir, "events").select("event_id", v.tolerant_date(day).alias("day"), v.unit_label(unit).alias("unit"), v.period_class(period).alias("period"))


@query("SELECT o_orderkey, o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30' AS plausible, regexp_matches(o_orderpriority, '^.-.*H.*$') AS fits, round(abs(o_totalprice - 100000) / 100000, 9) AS apart FROM orders")
def f13_f28_p14_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.stats import relative_difference

    stamp = F.col("o_orderdate")
    limit = lambda d: F.lit(d).cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", v.plausible_time(stamp, limit("1995-01-01"), limit("1996-06-30")).alias("plausible"), v.name_glob(F.col("o_orderpriority"), "?-*H*").alias("fits"),
        F.round(relative_difference(F.col("o_totalprice"), F.lit(100000.0)), 9).alias("apart"),
    )


IDENTIFIERS = """WITH one AS (SELECT o_custkey AS security_id, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders GROUP BY 1),
ident AS (SELECT security_id, 'ticker' AS kind, 'T' || (security_id % 400) AS value, a AS valid_from, CASE WHEN security_id % 3 = 0 THEN NULL ELSE z + 1 END AS valid_to FROM one
  UNION ALL SELECT security_id, 'isin', 'I' || security_id, a, NULL FROM one)"""


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("security_id")).agg(F.to_date(F.min("o_orderdate")).alias("valid_from"), F.to_date(F.max("o_orderdate")).alias("z"))
    key = F.col("security_id")
    ticker = one.select("security_id", F.lit("ticker").alias("kind"), F.concat(F.lit("T"), (key % 400).cast("string")).alias("value"), "valid_from", F.when(key % 3 != 0, F.date_add("z", 1)).alias("valid_to"))
    return ticker.unionByName(one.select("security_id", F.lit("isin").alias("kind"), F.concat(F.lit("I"), key.cast("string")).alias("value"), "valid_from", F.lit(None).cast("date").alias("valid_to")))


@query(
    IDENTIFIERS
    + """, r AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN 'isin' ELSE 'ticker' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'I' || o_custkey ELSE 'T' || (o_custkey % 400) END AS value, o_orderdate::DATE - 30 AS on_date FROM orders),
g AS (SELECT request_id, count(DISTINCT security_id) AS n, min(security_id) AS s FROM r LEFT JOIN ident i ON r.kind = i.kind AND r.value = i.value AND i.valid_from <= on_date AND (i.valid_to IS NULL OR on_date < i.valid_to) GROUP BY 1)
SELECT request_id, CASE WHEN n = 1 THEN s END AS security_id, CASE WHEN n = 0 THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM g"""
)
def m1_j17_resolve_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, even = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 2 == 0
    value = F.when(even, F.concat(F.lit("I"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("T"), (F.col("o_custkey") % 400).cast("string")))
    requests = order.select(F.col("o_orderkey").alias("request_id"), F.when(even, "isin").otherwise("ticker").alias("kind"), value.alias("value"), F.date_sub("o_orderdate", 30).alias("on"))
    return ms.resolve(requests, identifiers(spark, sf_dir))


@query(IDENTIFIERS + "SELECT security_id, kind, value FROM ident WHERE valid_from <= DATE '1996-01-01' AND (valid_to IS NULL OR DATE '1996-01-01' < valid_to)")
def m2_m4_m5_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.in_force(identifiers(spark, sf_dir), date(1996, 1, 1)).select("security_id", "kind", "value")


@query(IDENTIFIERS + "SELECT DISTINCT 'one_value_two_securities' AS conflict, a.kind, a.security_id AS a_id, a.value AS a_value, b.security_id AS b_id, b.value AS b_value FROM ident a JOIN ident b ON a.kind = b.kind AND a.value = b.value AND a.security_id < b.security_id AND (b.valid_to IS NULL OR a.valid_from < b.valid_to) AND (a.valid_to IS NULL OR b.valid_from < a.valid_to)")
def m6_mapping_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.conflicts(identifiers(spark, sf_dir))


@query("SELECT 'security_without_entity' AS rule, c_custkey::VARCHAR AS id FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) UNION SELECT 'state_after_terminal', o_custkey::VARCHAR FROM (SELECT o_custkey, max((o_orderstatus = 'P')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM orders) WHERE t = 1")
def m7_master_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("entity_id"))
    customer, order = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    securities = customer.select(F.col("c_custkey").alias("security_id"), F.col("c_nationkey").alias("entity_id"))
    listings = order.select(F.col("o_custkey").alias("security_id"))
    states = order.select(F.col("o_custkey").alias("security_id"), F.when(F.col("o_orderstatus") == "P", "delisted").otherwise("listed").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("valid_from"))
    return ms.violations(entities, securities, listings, states)


@query(
    IDENTIFIERS
    + """, t AS (SELECT *, valid_from AS recorded_on, NULL::DATE AS superseded_on FROM ident), h AS (SELECT * FROM t WHERE kind = 'ticker' AND valid_to IS NULL)
SELECT security_id, kind, value, valid_from, valid_to, recorded_on, CASE WHEN kind = 'ticker' AND valid_to IS NULL THEN DATE '1999-02-01' END AS superseded_on FROM t
UNION ALL SELECT security_id, kind, value, valid_from, DATE '1999-01-15', DATE '1999-02-01', NULL FROM h UNION ALL SELECT security_id, kind, 'N' || security_id, DATE '1999-01-15', NULL, DATE '1999-02-01', NULL FROM h"""
)
def m8_m13_ticker_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = identifiers(spark, sf_dir).withColumn("recorded_on", F.col("valid_from")).withColumn("superseded_on", F.lit(None).cast("date"))
    changes = held.where("kind = 'ticker' AND valid_to IS NULL").select("security_id", "kind", F.lit(date(1999, 1, 15)).alias("effective"), F.lit(date(1999, 2, 1)).alias("recorded"), F.concat(F.lit("N"), F.col("security_id").cast("string")).alias("value"))
    return ms.superseded(held, changes, ["security_id", "kind"], ["value"])


@query(
    IDENTIFIERS
    + """, t AS (SELECT *, valid_from AS recorded_on, NULL::DATE AS superseded_on FROM ident), e AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), h AS (SELECT * FROM t WHERE valid_to IS NULL AND security_id IN (FROM e))
SELECT security_id, kind, value, valid_from, valid_to, recorded_on, CASE WHEN valid_to IS NULL AND security_id IN (FROM e) THEN DATE '1999-02-01' END AS superseded_on FROM t
UNION ALL SELECT security_id, kind, value, valid_from, DATE '1999-01-15', DATE '1999-02-01', NULL FROM h"""
)
def m11_terminations(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = identifiers(spark, sf_dir).withColumn("recorded_on", F.col("valid_from")).withColumn("superseded_on", F.lit(None).cast("date"))
    ended = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("security_id"), F.lit(date(1999, 1, 15)).alias("effective"), F.lit(date(1999, 2, 1)).alias("recorded"))
    return ms.terminated(held, ended)


ENDED = """, cut AS (SELECT b.* FROM bars b JOIN supplier ON security_id = s_suppkey WHERE s_acctbal > 2000 OR trade_date < DATE '1997-06-01'),
l AS (SELECT security_id, max(trade_date) AS last_date FROM cut GROUP BY 1), qq AS (SELECT * FROM l WHERE (SELECT max(last_date) FROM l) - last_date > 15),
rm AS (SELECT o_custkey AS security_id, o_orderdate::DATE AS removed_on, CASE WHEN o_custkey % 2 = 0 THEN 'acquired' ELSE o_orderstatus END AS reason FROM orders),
rs AS (SELECT security_id, list_distinct(list(reason)) AS r FROM qq JOIN rm USING (security_id) WHERE abs(removed_on - last_date) <= 400 GROUP BY 1)
SELECT security_id, last_date, last_date + CASE isodow(last_date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS ex_date, CASE WHEN len(r) = 1 THEN r[1] ELSE 'unknown' END AS reason FROM qq LEFT JOIN rs USING (security_id)"""


@query(with_tables(BARS) + ENDED)
def m14_j19_ended_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "supplier").where("s_acctbal <= 2000").select(F.col("s_suppkey").alias("security_id"), F.lit(True).alias("poor"))
    cut = bars(spark, sf_dir).join(poor, "security_id", "left").where("poor IS NULL OR trade_date < DATE '1997-06-01'")
    removals = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("security_id"), F.to_date("o_orderdate").alias("removed_on"), F.when(F.col("o_custkey") % 2 == 0, "acquired").otherwise(F.col("o_orderstatus")).alias("reason"))
    return ms.ended_series(cut, removals)


@query(
    """WITH b AS (SELECT l_suppkey AS security_id, l_shipdate::DATE AS trade_date, 'X' || (l_linenumber % 3) AS symbol, max(round(l_extendedprice)) AS close FROM lineitem GROUP BY ALL),
w AS (SELECT DISTINCT security_id, symbol, CASE symbol WHEN 'X0' THEN DATE '1992-01-01' WHEN 'X1' THEN DATE '1994-06-01' ELSE DATE '1996-03-01' END AS s, CASE symbol WHEN 'X0' THEN DATE '1994-05-31' WHEN 'X1' THEN DATE '1995-12-31' END AS e FROM b),
d AS (SELECT b.*, CASE WHEN trade_date BETWEEN s AND coalesce(e, DATE '9999-12-31') THEN 0 ELSE least(abs(trade_date - s), coalesce(abs(trade_date - e), 1073741824)) END AS dist FROM b JOIN w USING (security_id, symbol))
SELECT security_id, trade_date, symbol, close FROM d QUALIFY row_number() OVER (PARTITION BY security_id, trade_date ORDER BY dist, symbol) = 1"""
)
def z16_preferred_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    rows = line.groupBy(F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("trade_date"), F.concat(F.lit("X"), (F.col("l_linenumber") % 3).cast("string")).alias("symbol")).agg(F.max(F.round("l_extendedprice")).alias("close"))
    day = lambda d: F.lit(d).cast("date")
    s = F.col("symbol")
    windows = rows.select("security_id", "symbol").distinct().withColumn("starts", F.when(s == "X0", day("1992-01-01")).when(s == "X1", day("1994-06-01")).otherwise(day("1996-03-01"))).withColumn("ends", F.when(s == "X0", day("1994-05-31")).when(s == "X1", day("1995-12-31")))
    return ms.preferred_code(rows, windows).select("security_id", "trade_date", "symbol", "close")


@query("WITH RECURSIVE r(ticker, root) AS (SELECT 'N' || n_nationkey, 'N' || (n_nationkey - 1) FROM nation WHERE n_nationkey % 6 <> 0), c AS (SELECT ticker, root, ticker AS start FROM r UNION ALL SELECT c.ticker, r.root, r.ticker FROM c JOIN r ON c.root = r.ticker) SELECT ticker, root FROM c WHERE root NOT IN (SELECT ticker FROM r)")
def z17_rename_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda k: F.concat(F.lit("N"), k.cast("string"))
    renames = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 0").select(name(F.col("n_nationkey") - 1).alias("old"), name(F.col("n_nationkey")).alias("new"))
    return ms.rename_chains(renames)


@query(with_tables(BARS) + "SELECT security_id, min(trade_date) AS first, max(trade_date) AS last, count(*) AS bars FROM bars GROUP BY 1")
def z19_bars_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("security_id").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.count("*").alias("bars"))


@query(
    with_tables(BARS)
    + """, f AS (SELECT 'extreme_move' AS "check" FROM (SELECT close, lag(close) OVER (PARTITION BY security_id ORDER BY trade_date) AS p FROM bars) WHERE close >= p * 1.5 OR close <= p * 0.5
UNION ALL SELECT 'volume_outlier' FROM (SELECT volume, floor(quantile_cont(volume, 0.5) OVER w) AS m, count(volume) OVER w AS n FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)) WHERE n >= 10 AND volume > m * 20),
d("check") AS (VALUES ('extreme_move'), ('invalid_bar'), ('volume_outlier'))
SELECT d."check", count(f."check") AS findings FROM d LEFT JOIN f USING ("check") GROUP BY 1"""
)
def v1_g26_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bars(spark, sf_dir)
    checks = {"extreme_move": prices.extreme_moves(found), "invalid_bar": prices.invalid_bars(found), "volume_outlier": prices.volume_outliers(found)}
    rows = None
    for name, df in checks.items():
        one = df.select(F.lit(name).alias("check"))
        rows = one if rows is None else rows.unionByName(one)
    names = spark.createDataFrame([(n,) for n in checks], "check string")
    return names.join(rows.withColumn("_hit", F.lit(1)), "check", "left").groupBy("check").agg(F.count("_hit").alias("findings"))
