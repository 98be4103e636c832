"""Queries over factors, sessions and weights."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import factors as fa
from tidemark.operators import prices, sessions
from tidemark.plans.fixtures import BARS, bars, table, with_tables
from tidemark.plans.registry import query

WEEKDAYS = "(floor((({0} - DATE '1970-01-01') + 3) / 7.0)::BIGINT * 5 + least((({0} - DATE '1970-01-01') + 3) % 7, 5))"
ENDS = """, ends AS (SELECT security_id, e."end" FROM (SELECT DISTINCT security_id FROM bars) CROSS JOIN (SELECT max(trade_date) AS "end" FROM bars GROUP BY date_trunc('month', trade_date)) e)"""


def month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each security at each month's last day with a bar anywhere; the months are few."""
    found = bars(spark, sf_dir)
    days = sessions.month_ends(found.select("trade_date").distinct(), "trade_date").withColumnRenamed("trade_date", "end")
    return found.select("security_id").distinct().crossJoin(F.broadcast(days))


#: The given bars are sparse: a third of the sessions.
SPARSE = 0.2


def window_sql(months: int, skip: int, tag: str = "") -> str:
    """The tables ends, n and wr<tag>; with a tag only the latter, beside those of an earlier call."""
    first = f"""{ENDS}, n AS (SELECT security_id, trade_date, close, row_number() OVER (PARTITION BY security_id ORDER BY trade_date) AS n FROM bars)"""
    return f"""{"" if tag else first},
q{tag} AS (SELECT *, ("end" - INTERVAL {months} MONTH)::DATE AS ws, ("end" - INTERVAL {skip} MONTH)::DATE AS we FROM ends),
a{tag} AS (SELECT q.*, CASE WHEN ws - n.trade_date <= 15 THEN n.trade_date END AS sb, n.close AS sv, n.n AS sn FROM q{tag} q ASOF LEFT JOIN n ON q.security_id = n.security_id AND ws >= n.trade_date),
b{tag} AS (SELECT a.*, CASE WHEN we - n.trade_date <= 15 THEN n.trade_date END AS eb, n.close AS ev, n.n AS en FROM a{tag} a ASOF LEFT JOIN n ON a.security_id = n.security_id AND we >= n.trade_date),
c{tag} AS (SELECT *, CASE WHEN sb IS NULL OR eb IS NULL OR sv <= 0 OR eb <= sb THEN 'insufficient_data'
  WHEN (en - sn + 1) / ({WEEKDAYS.format("(eb + 1)")} - {WEEKDAYS.format("sb")}) < {SPARSE} THEN 'insufficient_data' ELSE 'ok' END AS status FROM b{tag}),
wr{tag} AS (SELECT security_id, "end", status, CASE WHEN status = 'ok' THEN ev / sv - 1 END AS value FROM c{tag})"""


def momentum(spark: SparkSession, sf_dir: str, months: int = 12, skip: int = 1) -> DataFrame:
    return fa.window_return(month_ends(spark, sf_dir), bars(spark, sf_dir), months, skip, coverage=SPARSE)


@query(with_tables(BARS) + window_sql(12, 1) + 'SELECT security_id, "end", status, round(value, 9) AS value FROM wr')
def w7_r1_window_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return momentum(spark, sf_dir).select("security_id", "end", "status", F.round("value", 9).alias("value"))


PROCEEDS = """, pr AS (SELECT s_suppkey AS security_id, DATE '1997-03-14' AS event_date, CASE WHEN s_acctbal < -500 THEN NULL WHEN s_acctbal < 0 THEN 0.0 ELSE 500.0 END AS proceeds FROM supplier WHERE s_acctbal < 1000)"""


@query(
    with_tables("""trades0 AS (SELECT 1)""", BARS.replace("FROM trades GROUP BY ALL)", "FROM trades GROUP BY ALL HAVING trade_date < DATE '1997-03-14' OR security_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000))"))
    + PROCEEDS + window_sql(6, 0).replace("c AS (SELECT *,", "d AS (SELECT b.*, pr.security_id IS NOT NULL AS known, event_date, proceeds, (SELECT max(trade_date) FROM n WHERE n.security_id = b.security_id) AS lastbar FROM b LEFT JOIN pr USING (security_id)),\nx AS (SELECT *, eb IS NULL AND lastbar < we AND known AS ended, eb IS NULL AND lastbar < we AND known AND proceeds IS NOT NULL AS used FROM d),\ny AS (SELECT * EXCLUDE (eb, ev), CASE WHEN used THEN least(event_date, we) ELSE eb END AS eb, CASE WHEN used THEN proceeds ELSE ev END AS ev FROM x),\nc AS (SELECT *,")
    .replace("CASE WHEN sb IS NULL OR eb IS NULL", "CASE WHEN sb IS NULL THEN 'insufficient_data' WHEN ended AND proceeds IS NULL THEN 'delisted_no_proceeds' WHEN eb IS NULL").replace("WHEN (en - sn", "WHEN NOT used AND (en - sn").replace("ELSE 'ok' END AS status FROM b)", "ELSE 'ok' END AS status FROM y)")
    + 'SELECT security_id, "end", status, round(value, 9) AS value FROM wr'
)
def w7_delisting_proceeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities of poor suppliers end in March 1997, with known, zero or unknown proceeds."""
    poor = table(spark, sf_dir, "supplier").where("s_acctbal < 1000")
    worth = F.when(F.col("s_acctbal") < -500, F.lit(None)).when(F.col("s_acctbal") < 0, 0.0).otherwise(500.0)
    proceeds = poor.select(F.col("s_suppkey").alias("security_id"), F.lit(date(1997, 3, 14)).alias("event_date"), worth.cast("double").alias("proceeds"))
    found = bars(spark, sf_dir)
    listed = found.join(proceeds.select("security_id", "event_date"), "security_id", "left").where("event_date IS NULL OR trade_date < event_date").drop("event_date")
    ends = sessions.month_ends(listed.select("trade_date").distinct(), "trade_date").withColumnRenamed("trade_date", "end")
    asked = listed.select("security_id").distinct().crossJoin(F.broadcast(ends))
    return fa.window_return(asked, listed, 6, 0, proceeds, coverage=SPARSE).select("security_id", "end", "status", F.round("value", 9).alias("value"))


DISPERSION = """, r AS (SELECT security_id, trade_date, close / lag(close) OVER (PARTITION BY security_id ORDER BY trade_date) - 1 AS ret FROM bars),
ds AS (SELECT e.security_id, e."end", count(ret) AS n, stddev_samp(ret) * sqrt(252.0) AS sd FROM ends e JOIN r ON e.security_id = r.security_id AND trade_date > e."end" - INTERVAL 6 MONTH AND trade_date <= e."end" AND ret IS NOT NULL GROUP BY ALL)"""


@query(
    with_tables(BARS) + window_sql(6, 0) + DISPERSION
    + """, z AS (SELECT wr.*, sd, CASE WHEN status = 'ok' AND (n IS NULL OR n < 20 OR sd IS NULL OR sd < 1e-6) THEN 'insufficient_data' ELSE status END AS s2 FROM wr LEFT JOIN ds USING (security_id, "end"))
SELECT security_id, "end", s2 AS status, CASE WHEN s2 = 'ok' THEN round(value / sd, 8) END AS value FROM z"""
)
def r2_return_over_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = month_ends(spark, sf_dir)
    spread = fa.window_dispersion(ends, prices.daily_returns(bars(spark, sf_dir)).select("security_id", "trade_date", "ret"), 6)
    return fa.return_over_volatility(momentum(spark, sf_dir, 6, 0), spread).select("security_id", "end", "status", F.round("value", 8).alias("value"))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-sections of a nation's customers: the account balance, ok if positive."""
    customer = table(spark, sf_dir, "customer")
    status = F.when(F.col("c_acctbal") > 0, "ok").otherwise("no_data")
    return customer.select(F.col("c_custkey").alias("security_id"), F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("sector"), status.alias("status"), F.when(status == "ok", F.round("c_acctbal", 0)).alias("value"), F.array().cast(fa.NOTES).alias("warnings"))


FRAME = """WITH fr AS (SELECT c_custkey AS security_id, c_nationkey AS grp, c_mktsegment AS sector, CASE WHEN c_acctbal > 0 THEN 'ok' ELSE 'no_data' END AS status, CASE WHEN c_acctbal > 0 THEN round(c_acctbal, 0) END AS value FROM customer)
"""


@query(FRAME + ", p AS (SELECT *, quantile_cont(value, 0.05) OVER (PARTITION BY grp) AS lo, quantile_cont(value, 0.95) OVER (PARTITION BY grp) AS hi FROM fr) SELECT security_id, status, CASE WHEN status = 'ok' THEN round(greatest(least(value, hi), lo), 6) END AS value, CASE WHEN status = 'ok' AND value <> greatest(least(value, hi), lo) THEN 1 ELSE 0 END AS notes FROM p")
def r7_winsorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.winsorise(frame(spark, sf_dir), ["grp"], lower=5, upper=95).select("security_id", "status", F.round("value", 6).alias("value"), F.size("warnings").alias("notes"))


@query(FRAME + "SELECT security_id, status, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 8) AS value FROM fr WINDOW w AS (PARTITION BY grp)")
def r8_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.zscore(frame(spark, sf_dir), ["grp"]).select("security_id", "status", F.round("value", 8).alias("value"))


@query(FRAME + ", m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY grp) AS md FROM fr), d AS (SELECT *, quantile_cont(abs(value - md), 0.5) OVER (PARTITION BY grp) AS mad FROM m) SELECT security_id, status, round((value - md) / (mad * 1.4826), 8) AS value FROM d")
def r9_zscore_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.zscore_robust(frame(spark, sf_dir), ["grp"]).select("security_id", "status", F.round("value", 8).alias("value"))


@query(FRAME + ", k AS (SELECT *, rank() OVER (PARTITION BY grp, value IS NULL ORDER BY value) AS lo, count(*) OVER (PARTITION BY grp, value) AS c, count(value) OVER (PARTITION BY grp) AS n FROM fr) SELECT security_id, status, CASE WHEN status = 'ok' THEN round((lo + (c - 1) / 2 - 0.5) / n, 9) END AS value FROM k")
def r10_w28_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.rank_percentile(frame(spark, sf_dir), ["grp"]).select("security_id", "status", F.round("value", 9).alias("value"))


@query(FRAME + ", g AS (SELECT *, count(value) OVER (PARTITION BY grp, sector, status) AS n, avg(value) OVER (PARTITION BY grp, sector, status) AS m FROM fr) SELECT security_id, status, round(CASE WHEN n >= 8 THEN value - m ELSE value END, 6) AS value, CASE WHEN status = 'ok' AND n < 8 THEN 1 ELSE 0 END AS notes FROM g")
def r11_sector_neutralise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.sector_neutralise(frame(spark, sf_dir), ["grp"], least=8).select("security_id", "status", F.round("value", 6).alias("value"), F.size("warnings").alias("notes"))


@query("SELECT c_custkey AS security_id, 'not_meaningful' AS status, NULL::DOUBLE AS value FROM customer")
def r12_degenerate_cross_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer alone in its cross-section."""
    return fa.zscore(frame(spark, sf_dir).withColumns({"status": F.lit("ok"), "value": F.lit(1.0)}), ["security_id"]).select("security_id", "status", "value")


COMPOSITE = FRAME + """, oc AS (SELECT o_custkey AS security_id, sum(round(o_totalprice)) AS v FROM orders GROUP BY 1),
a AS (SELECT security_id, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z FROM fr WHERE status = 'ok'), b AS (SELECT security_id, -(v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z FROM oc WHERE v < 2000000),
j AS (SELECT fr.security_id, a.z AS za, b.z AS zb FROM fr LEFT JOIN a USING (security_id) LEFT JOIN b USING (security_id))
"""


@query(COMPOSITE + "SELECT security_id, CASE WHEN za IS NULL AND zb IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status, CASE WHEN za IS NOT NULL OR zb IS NOT NULL THEN round((coalesce(2 * za, 0) + coalesce(zb, 0)) / ((za IS NOT NULL)::INT * 2.0 + (zb IS NOT NULL)::INT), 7) END AS value FROM j")
def r13_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir).select("security_id", "status", "value", "warnings")
    sales = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("security_id")).agg(F.sum(F.round("o_totalprice")).alias("value")).where("value < 2000000")
    parts = {"balance": own, "sales": sales.withColumns({"status": F.lit("ok"), "warnings": F.array().cast(fa.NOTES)})}
    found = fa.composite(own, parts, [fa.Component("balance", 2.0), fa.Component("sales", 1.0, -1)], least=1)
    return found.select("security_id", "status", F.round("value", 7).alias("value"))


RATIO = """WITH f AS (SELECT o_custkey AS security_id, sum(round(o_totalprice)) FILTER (o_orderpriority = '1-URGENT') AS a, sum(round(o_totalprice)) FILTER (o_orderpriority = '2-HIGH') AS b, sum(CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END * round(o_totalprice)) FILTER (o_orderpriority = '5-LOW') AS c FROM orders GROUP BY 1)
"""


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, of = F.round("o_totalprice"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("security_id")).agg(
        F.sum(F.when(of == "1-URGENT", price)).alias("a"), F.sum(F.when(of == "2-HIGH", price)).alias("b"), F.sum(F.when(of == "5-LOW", F.when(F.col("o_orderstatus") == "O", -price).otherwise(price))).alias("c")
    )


@query(RATIO + "SELECT security_id, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'no_data' WHEN c <= 0 THEN 'not_meaningful' ELSE 'ok' END AS status, CASE WHEN c > 0 THEN round((a - b) / c, 8) END AS value FROM f")
def r3_fundamental_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.fundamental_ratio(sums(spark, sf_dir), ["a"], ["c"], ["b"]).select("security_id", "status", F.round("value", 8).alias("value"))


@query(RATIO + ", g AS (SELECT security_id, a AS ebit, c AS tax, b AS pretax, a AS equity, c AS net_debt FROM f) SELECT security_id, CASE WHEN ebit IS NULL OR equity + net_debt IS NULL OR tax IS NULL THEN 'no_data' WHEN equity + net_debt <= 0 THEN 'not_meaningful' ELSE 'ok' END AS status, CASE WHEN equity + net_debt > 0 AND tax IS NOT NULL THEN round(ebit * (1 - CASE WHEN pretax > 0 THEN greatest(0.0, least(1.0, tax / pretax)) ELSE 0.0 END) / (equity + net_debt), 8) END AS value FROM g")
def r4_roic(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = sums(spark, sf_dir).select("security_id", F.col("a").alias("ebit"), F.col("c").alias("tax"), F.col("b").alias("pretax"), F.col("a").alias("equity"), F.col("c").alias("net_debt"))
    return fa.roic(wide).select("security_id", "status", F.round("value", 8).alias("value"))


@query("WITH y AS (SELECT o_custkey AS security_id, sum(round(o_totalprice)) AS v FROM orders GROUP BY o_custkey, year(o_orderdate)), s AS (SELECT security_id, count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd FROM y GROUP BY 1) SELECT security_id, CASE WHEN n < 3 THEN 'insufficient_data' ELSE 'ok' END AS status, CASE WHEN n >= 3 THEN round(-sd / abs(m), 8) END AS value FROM s")
def r5_earnings_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("security_id"), F.year("o_orderdate")).agg(F.sum(F.round("o_totalprice")).alias("value"))
    return fa.earnings_stability(yearly).select("security_id", "status", F.round("value", 8).alias("value"))


@query(RATIO + ", g AS (SELECT f.*, c_acctbal AS price FROM f JOIN customer ON security_id = c_custkey) SELECT security_id, CASE WHEN c IS NULL OR a IS NULL THEN 'no_data' WHEN price * a + coalesce(b, 0) <= 0 THEN 'not_meaningful' WHEN c < 0 THEN 'not_meaningful' ELSE 'ok' END AS status, CASE WHEN price * a + coalesce(b, 0) > 0 AND c >= 0 THEN round(c / (price * a + coalesce(b, 0)) * 1000, 8) END AS value FROM g")
def r6_market_value_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("security_id"), F.col("c_acctbal").alias("price"))
    figures = sums(spark, sf_dir).join(held, "security_id").select("security_id", F.col("c").alias("figure"), "price", F.col("a").alias("shares"), F.col("b").alias("net_debt"))
    found = fa.market_value_yield(figures, use_ev=True, refuse_negative=True)
    return found.select("security_id", "status", F.round(F.col("value") * 1000, 8).alias("value"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("security_id"), F.col("c_nationkey").alias("grp"), F.round("c_acctbal", 0).alias("score"))


SCORES = "WITH s AS (SELECT c_custkey AS security_id, c_nationkey AS grp, round(c_acctbal, 0) AS score FROM customer)\n"


@query(SCORES + "SELECT grp, security_id, (row_number() OVER (PARTITION BY grp ORDER BY score DESC, security_id))::INT AS rank FROM s QUALIFY rank <= 10")
def k1_k2_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.select_top(scores(spark, sf_dir), "top_n", by=["grp"], n=10).select("grp", "security_id", "rank")


@query(SCORES + "SELECT grp, security_id, (row_number() OVER (PARTITION BY grp ORDER BY score DESC, security_id))::INT AS rank FROM s QUALIFY rank <= greatest(1, ceil(count(*) OVER (PARTITION BY grp) / 10))")
def k2_top_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.select_top(scores(spark, sf_dir), "top_decile", by=["grp"]).select("grp", "security_id", "rank")


@query(SCORES + "SELECT grp, security_id, (row_number() OVER (PARTITION BY grp ORDER BY score DESC, security_id))::INT AS rank FROM s QUALIFY score >= 5000 AND rank <= 15")
def k2_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.select_top(scores(spark, sf_dir), "threshold", by=["grp"], threshold=5000.0, most=15).select("grp", "security_id", "rank")


@query(SCORES + "SELECT grp, security_id, round(0.95 / count(*) OVER (PARTITION BY grp), 10) AS weight FROM s")
def b10_equal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.equal_weights(scores(spark, sf_dir), 0.95, ["grp"]).select("grp", "security_id", F.round("weight", 10).alias("weight"))


@query(
    SCORES
    + """, r AS (SELECT grp, security_id, 'rank' AS policy, row_number() OVER (PARTITION BY grp ORDER BY score, security_id DESC)::DOUBLE AS x FROM s
UNION ALL SELECT grp, security_id, 'shift', score - min(score) OVER (PARTITION BY grp) FROM s UNION ALL SELECT grp, security_id, 'positive_only', score FROM s WHERE score > 0)
SELECT grp, security_id, policy, round(x / sum(x) OVER (PARTITION BY grp, policy), 9) AS weight FROM r"""
)
def b11_score_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [fa.score_weights(scores(spark, sf_dir), p, by=["grp"]).withColumn("policy", F.lit(p)) for p in ("rank", "shift", "positive_only")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("grp", "security_id", "policy", F.round("weight", 9).alias("weight"))


@query(SCORES + ", v AS (SELECT grp, security_id, 1 / score AS i FROM s WHERE score > 0) SELECT grp, security_id, round(i / sum(i) OVER (PARTITION BY grp), 9) AS weight FROM v")
def b12_inverse_volatility_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.inverse_volatility_weights(scores(spark, sf_dir).withColumnRenamed("score", "volatility"), by=["grp"]).select("grp", "security_id", F.round("weight", 9).alias("weight"))


CAPPED = SCORES + """, p AS (SELECT grp, security_id, score / sum(score) OVER (PARTITION BY grp) AS w FROM s WHERE score > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY w DESC, security_id) - 1 AS k, sum(w) OVER (PARTITION BY grp) AS total, count(*) OVER (PARTITION BY grp) AS n, sum(w) OVER (PARTITION BY grp ORDER BY w DESC, security_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM p),
f AS (SELECT *, (total - k * 0.025) / rest AS sc, w * ((total - k * 0.025) / rest) <= 0.025 + 1e-12 AS fits FROM k),
a AS (SELECT grp, min(k) AS k0 FROM f WHERE fits GROUP BY 1), b AS (SELECT f.grp, sc AS s0, k0 FROM f JOIN a ON f.grp = a.grp AND f.k = a.k0)
SELECT f.grp, security_id, round(CASE WHEN n * 0.025 < total - 1e-12 THEN NULL WHEN k0 IS NULL OR k < k0 THEN 0.025 ELSE w * s0 END, 9) AS weight FROM f LEFT JOIN b ON f.grp = b.grp"""


@query(CAPPED)
def b13_z7_capped_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = fa.score_weights(scores(spark, sf_dir), "positive_only", by=["grp"])
    return fa.capped(weighted, 0.025, ["grp"]).select("grp", "security_id", F.round("weight", 9).alias("weight"))


@query(SCORES + ", w AS (SELECT grp, security_id, 1.0 / count(*) OVER (PARTITION BY grp) AS weight, score AS price FROM s) SELECT grp, security_id, floor(weight * 1000000 / price)::BIGINT AS shares FROM w WHERE price > 0 AND floor(weight * 1000000 / price) > 0")
def b14_target_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = fa.equal_weights(scores(spark, sf_dir), 1.0, ["grp"]).withColumnRenamed("score", "price")
    return fa.target_shares(weighted, F.lit(1000000)).select("grp", "security_id", "shares")


@query("SELECT l_suppkey AS security_id, sum(l_quantity * round(l_extendedprice)) AS traded, count(*) AS trades, round(sum(l_quantity * round(l_extendedprice)) / 2 / 1e9, 9) AS turnover FROM lineitem GROUP BY 1")
def b15_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    fills = line.select(F.col("l_suppkey").alias("security_id"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"), F.round("l_extendedprice").alias("price"), F.lit(1e9).alias("value_before"))
    return fa.turnover(fills, ["security_id"]).withColumn("turnover", F.round("turnover", 9))


@query(
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'buy' ELSE 'sell' END AS side, round(o_totalprice) AS n, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 5000000.0 END AS m FROM orders)
SELECT o_orderkey, round(greatest(n * 0.0002, 20.0), 6) AS commission, round(n * 0.0005, 6) AS spread, round(CASE WHEN side = 'buy' AND o_orderkey % 7 <> 0 THEN n * 0.005 ELSE 0 END, 6) AS stamp, round(n * 0.0025 * coalesce(n / m, 1.0), 6) AS impact FROM t"""
)
def b9_trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders")
    trades = order.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "buy").otherwise("sell").alias("side"), F.round("o_totalprice").alias("notional"), F.when(F.col("o_orderkey") % 3 != 0, 5000000.0).alias("median_traded"))
    found = fa.trade_costs(trades, fa.Costs(commission_min=20.0), F.col("o_orderkey") % 7 == 0)
    return found.select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("commission", "spread", "stamp", "impact")])


DAYS = "WITH d AS (SELECT DISTINCT l_shipdate::DATE AS session FROM lineitem WHERE isodow(l_shipdate) < 6)\n"


def trade_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).distinct().where(F.weekday("session") < 5)


@query(DAYS + "SELECT max(session) AS session FROM d GROUP BY date_trunc('month', session)")
def w30_month_end_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.month_ends(trade_days(spark, sf_dir))


@query(DAYS + ", n AS (SELECT session, row_number() OVER (PARTITION BY date_trunc('month', session) ORDER BY session) AS n, count(*) OVER (PARTITION BY date_trunc('month', session)) AS c FROM d WHERE month(session) IN (1, 4, 7, 10)) SELECT session FROM n WHERE n = least(4, c)")
def w31_rebalance_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.rebalance_sessions(trade_days(spark, sf_dir), (1, 4, 7, 10), 3)


@query(
    "SELECT o_orderkey, (SELECT count(*) FROM generate_series(0, 30) g(k) WHERE isodow(d + k::INT) < 6 AND k::INT <= 30) AS sessions, "
    "d + CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS next_day, d - CASE isodow(d) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS previous_day FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)"
)
def w32_session_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", sessions.sessions_between(day, F.date_add(day, 30)).alias("sessions"), sessions.next_session(day).alias("next_day"), sessions.previous_session(day).alias("previous_day"))


@query(
    with_tables(BARS)
    + f""", p AS (SELECT security_id, trade_date, lag(trade_date) OVER (PARTITION BY security_id ORDER BY trade_date) AS prev FROM bars),
g AS (SELECT security_id, prev + CASE WHEN isodow(prev) = 5 THEN 3 WHEN isodow(prev) = 6 THEN 2 ELSE 1 END AS start, trade_date - CASE WHEN isodow(trade_date) = 1 THEN 3 WHEN isodow(trade_date) = 7 THEN 2 ELSE 1 END AS "end" FROM p WHERE prev IS NOT NULL)
SELECT security_id, start, "end", ({WEEKDAYS.format('("end" + 1)')} - {WEEKDAYS.format("start")})::BIGINT AS sessions FROM g WHERE start <= "end" AND {WEEKDAYS.format('("end" + 1)')} - {WEEKDAYS.format("start")} > 0"""
)
def v2_w26_calendar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.gap_runs(bars(spark, sf_dir))
