"""Queries over daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import nearest_rank, upper_median
from tidemark.operators import prices as p
from tidemark.operators.temporal import asof_join
from tidemark.plans.fixtures import ACTIONS, BARS, actions, bars, with_tables
from tidemark.plans.registry import query

RETURNS = ", r AS (SELECT security_id, trade_date, close / lag(close) OVER (PARTITION BY security_id ORDER BY trade_date) - 1 AS ret FROM bars)"


@query(with_tables(BARS) + "SELECT security_id, trade_date, open, high, low, close, volume FROM bars WHERE trade_date BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'")
def s1_price_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).where("trade_date BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'")


@query(with_tables(BARS) + "SELECT year(trade_date)::INT AS trade_year, count(*) AS bars, count(*) < 10000 AS small FROM bars GROUP BY 1")
def s5_rows_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy(F.year("trade_date").alias("trade_year")).agg(F.count("*").alias("bars"), (F.count("*") < 10000).alias("small"))


@query(with_tables(BARS) + RETURNS + "SELECT security_id, trade_date, round(ret, 9) AS ret FROM r WHERE ret IS NOT NULL")
def w1_daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.daily_returns(bars(spark, sf_dir)).select("security_id", "trade_date", F.round("ret", 9).alias("ret"))


FACTORS = """, anchored AS (
  SELECT a.*, b.trade_date AS prev_date, b.close AS prev_close,
    CASE WHEN b.trade_date IS NULL THEN 'no_previous_bar' WHEN a.ex_date - b.trade_date > 7 THEN 'stale_previous_bar' ELSE 'ok' END AS anchor_status
  FROM actions a ASOF LEFT JOIN bars b ON a.security_id = b.security_id AND a.ex_date > b.trade_date),
sized AS (
  SELECT *, product(CASE WHEN action_type = 'split' THEN old_shares::DOUBLE / new_shares ELSE 1.0 END) OVER (PARTITION BY security_id, ex_date) AS day_factor FROM anchored),
ev AS (
  SELECT security_id, ex_date, max(day_factor) AS split_factor,
    product(CASE WHEN action_type = 'dividend' AND anchor_status = 'ok' AND amount > 0 AND amount < prev_close * day_factor THEN 1 - amount / (prev_close * day_factor) ELSE 1.0 END) AS dividend_factor,
    bool_or(action_type = 'dividend' AND anchor_status = 'stale_previous_bar') AS unanchored
  FROM sized GROUP BY ALL),
onbar AS (
  SELECT e.security_id, b.trade_date, product(split_factor) AS s, product(dividend_factor) AS d, bool_or(unanchored) AS g
  FROM ev e ASOF JOIN bars b ON e.security_id = b.security_id AND e.ex_date <= b.trade_date GROUP BY ALL),
factors AS (
  SELECT b.security_id, b.trade_date, close,
    coalesce(product(coalesce(s, 1.0)) OVER w, 1.0) AS split_factor, coalesce(product(coalesce(d, 1.0)) OVER w, 1.0) AS dividend_factor,
    coalesce(bool_or(g) OVER w, false) AS incomplete
  FROM bars b LEFT JOIN onbar o ON b.security_id = o.security_id AND b.trade_date = o.trade_date
  WINDOW w AS (PARTITION BY b.security_id ORDER BY b.trade_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


@query(with_tables(BARS, ACTIONS) + FACTORS + "SELECT action_id, security_id, ex_date, prev_date, prev_close, anchor_status FROM anchored")
def p11_anchored_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.anchored(actions(spark, sf_dir), bars(spark, sf_dir)).select("action_id", "security_id", "ex_date", "prev_date", "prev_close", "anchor_status")


# long products of tiny factors: compared as rounded logarithms
LOGS = "round(log2(split_factor), 6) AS log_split, round(ln(dividend_factor), 6) AS log_dividend"


@query(with_tables(BARS, ACTIONS) + FACTORS + f"SELECT security_id, trade_date, {LOGS}, incomplete FROM factors")
def w3_adjustment_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.adjustment_factors(bars(spark, sf_dir), actions(spark, sf_dir))
    return found.select("security_id", "trade_date", F.round(F.log2("split_factor"), 6).alias("log_split"), F.round(F.ln("dividend_factor"), 6).alias("log_dividend"), "incomplete")


@query(with_tables(BARS, ACTIONS) + FACTORS + "SELECT security_id, trade_date, round(ln(close * split_factor), 6) AS split_adjusted, round(ln(close * split_factor * dividend_factor), 6) AS adjusted FROM factors")
def w4_adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.adjusted(bars(spark, sf_dir), actions(spark, sf_dir))
    return found.select("security_id", "trade_date", F.round(F.ln("split_adjusted"), 6).alias("split_adjusted"), F.round(F.ln("adjusted"), 6).alias("adjusted"))


@query(
    with_tables(BARS, ACTIONS) + FACTORS
    + """, a AS (SELECT security_id, trade_date, close * split_factor * dividend_factor AS v FROM factors),
r AS (SELECT security_id, trade_date, round(v / lag(v) OVER (PARTITION BY security_id ORDER BY trade_date) - 1, 8) AS ret FROM a) SELECT * FROM r WHERE ret IS NOT NULL"""
)
def w5_total_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.daily_returns(p.adjusted(bars(spark, sf_dir), actions(spark, sf_dir)), "adjusted")
    return found.select("security_id", "trade_date", F.round("ret", 8).alias("ret"))


@query(
    with_tables(BARS, ACTIONS) + FACTORS
    + "SELECT security_id, count(*) AS bars, round(avg(abs(split_factor * dividend_factor / split_factor - 1)), 8) AS mean_gap, count(*) FILTER (abs(dividend_factor - 1) > 0.005) AS apart FROM factors GROUP BY 1"
)
def w6_reconcile_adjusted_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Our adjusted close against a provider's, here the split-adjusted one."""
    found = p.adjusted(bars(spark, sf_dir), actions(spark, sf_dir)).withColumn("gap", F.abs(F.col("adjusted") / F.col("split_adjusted") - 1))
    return found.groupBy("security_id").agg(F.count("*").alias("bars"), F.round(F.avg("gap"), 8).alias("mean_gap"), F.count_if(F.abs(F.col("dividend_factor") - 1) > 0.005).alias("apart"))


SERIES = "(PARTITION BY security_id ORDER BY trade_date)"


@query(
    with_tables(BARS)
    + f""", x AS (SELECT *, close / lag(close) OVER {SERIES} AS r, lead(close) OVER {SERIES} / lag(close) OVER {SERIES} AS b FROM bars)
SELECT security_id, trade_date, coalesce((r > 8 OR r < 0.125) AND b > 0.5 AND b < 2, false) AS spike FROM x"""
)
def p12_single_bar_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.single_bar_spikes(bars(spark, sf_dir)).select("security_id", "trade_date", "spike")


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the faults of a provider: no volume on days divisible by 11, prices lost on the 13th."""
    lost = F.dayofmonth("trade_date") == 13
    return bars(spark, sf_dir).withColumns({"volume": F.when(F.dayofyear("trade_date") % 11 == 0, F.lit(0)).otherwise(F.col("volume")), "low": F.when(lost, F.lit(0.0)).otherwise(F.col("low"))})


DAMAGED = """, damaged AS (SELECT security_id, trade_date, open, high, CASE WHEN day(trade_date) = 13 THEN 0.0 ELSE low END AS low, close,
  CASE WHEN dayofyear(trade_date) % 11 = 0 THEN 0 ELSE volume END AS volume FROM bars)"""


@query(
    with_tables(BARS) + DAMAGED
    + "SELECT security_id, trade_date FROM damaged WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR volume < 0 OR high < greatest(open, low, close) OR low > least(open, close)"
)
def p8_invalid_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.invalid_bars(damaged(spark, sf_dir)).select("security_id", "trade_date")


RATIOS = "[2.0, 0.5, 3.0, 1.0/3, 4.0, 0.25, 5.0, 0.2, 10.0, 0.1, 1.5, 2.0/3, 100.0, 0.01]::DOUBLE[]"


@query(
    with_tables(BARS)
    + f""", x AS (SELECT *, lag(close) OVER {SERIES} AS prev_close FROM bars)
SELECT security_id, trade_date, close, prev_close, round(list_filter({RATIOS}, lambda r: abs(close / prev_close / r - 1) <= 0.02)[1], 6) AS event_ratio
FROM x WHERE close >= prev_close * 1.5 OR close <= prev_close * 0.5"""
)
def w21_extreme_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.extreme_moves(bars(spark, sf_dir)).select("security_id", "trade_date", "close", "prev_close", F.round("event_ratio", 6).alias("event_ratio"))


ROUGH = ", rough AS (SELECT security_id, trade_date, floor(close / 1000) AS close, volume FROM bars)"


@query(
    with_tables(BARS) + DAMAGED.replace(" bars)", " rough)").replace(", damaged AS (SELECT security_id, trade_date, open, high, CASE WHEN day(trade_date) = 13 THEN 0.0 ELSE low END AS low, close,", ROUGH + ", damaged AS (SELECT security_id, trade_date, close,")
    + f""", c AS (SELECT *, CASE WHEN close = lag(close) OVER {SERIES} THEN 0 ELSE 1 END AS changed FROM damaged),
g AS (SELECT *, sum(changed) OVER {SERIES} AS run FROM c)
SELECT security_id, min(trade_date) AS start, max(trade_date) AS "end", count(*) AS bars, CASE WHEN max(volume) = 0 THEN 'error' ELSE 'warning' END AS severity FROM g GROUP BY security_id, run HAVING count(*) >= 5"""
)
def w23_stale_price_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rough = damaged(spark, sf_dir).withColumn("close", F.floor(F.col("close") / 1000))
    return p.stale_runs(rough)


@query(
    with_tables(BARS) + DAMAGED
    + f""", c AS (SELECT *, volume <= 0 AS low0, CASE WHEN (volume <= 0) = lag(volume <= 0) OVER {SERIES} THEN 0 ELSE 1 END AS changed FROM damaged),
g AS (SELECT *, sum(changed) OVER {SERIES} AS run FROM c)
SELECT security_id, min(trade_date) AS start, max(trade_date) AS "end", count(*) AS bars FROM g WHERE low0 GROUP BY security_id, run"""
)
def w24_zero_volume_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.low_volume_runs(damaged(spark, sf_dir))


@query(
    with_tables(BARS)
    + """, x AS (SELECT security_id, trade_date, volume, floor(quantile_cont(volume, 0.5) OVER w)::BIGINT AS median_volume, count(volume) OVER w AS n FROM bars
  WINDOW w AS (PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING))
SELECT security_id, trade_date, volume, median_volume FROM x WHERE n >= 10 AND volume > median_volume * 3"""
)
def w25_volume_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.volume_outliers(bars(spark, sf_dir), times=3.0).select("security_id", "trade_date", "volume", "median_volume")


def flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars quoted in hundredths for a quarter of each year."""
    return bars(spark, sf_dir).withColumn("close", F.col("close") * F.when(F.month("trade_date").between(4, 6), 100.0).otherwise(1.0))


@query(
    with_tables(BARS)
    + f""", f AS (SELECT security_id, trade_date, close * CASE WHEN month(trade_date) BETWEEN 4 AND 6 THEN 100.0 ELSE 1.0 END AS close FROM bars),
x AS (SELECT *, close / lag(close) OVER {SERIES} AS r FROM f),
y AS (SELECT *, sum(CASE WHEN r BETWEEN 70 AND 140 THEN -1 WHEN r BETWEEN 1.0/140 AND 1.0/70 THEN 1 ELSE 0 END) OVER {SERIES} AS shift FROM x)
SELECT security_id, trade_date, shift::BIGINT AS shift, max(abs(shift)) OVER (PARTITION BY security_id) <= 1 AS resolved FROM y"""
)
def w27_unit_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.unit_flips(flipped(spark, sf_dir)).select("security_id", "trade_date", "shift", "resolved")


@query(
    with_tables(BARS, ACTIONS)
    + """, lv AS (SELECT security_id, list_sort(list(close))[len(list(close)) // 2 + 1] AS typical FROM bars GROUP BY 1),
yd AS (SELECT security_id, year(ex_date) AS y, sum(amount) AS paid FROM actions WHERE action_type = 'dividend' GROUP BY ALL),
py AS (SELECT security_id, year(trade_date) AS y, list_sort(list(close))[len(list(close)) // 2 + 1] AS of_year FROM bars GROUP BY ALL),
yl AS (SELECT security_id, count(*) AS years, list_sort(list(paid / of_year))[len(list(paid / of_year)) // 2 + 1] AS dy FROM yd JOIN py USING (security_id, y) GROUP BY 1),
v AS (SELECT security_id, typical, CASE WHEN years >= 2 THEN dy END AS y FROM lv LEFT JOIN yl USING (security_id)),
c AS (SELECT security_id, CASE WHEN y > 0.30 THEN 'yield' WHEN y <= 0.15 AND typical < 25 THEN 'conflict' WHEN y IS NULL AND typical < 25 THEN 'price' ELSE 'unchanged' END AS verdict FROM v)
SELECT security_id, verdict, CASE WHEN verdict IN ('yield', 'price') THEN 100.0::DOUBLE WHEN verdict = 'conflict' THEN NULL ELSE 1.0::DOUBLE END AS scale FROM c"""
)
def v4_unit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.unit_classes(bars(spark, sf_dir), actions(spark, sf_dir).where("action_type = 'dividend'"))


@query(
    with_tables(BARS)
    + """SELECT security_id, trade_date, round(open * s, 6) AS open, round(high * s, 6) AS high, round(low * s, 6) AS low, round(close * s, 6) AS close, volume
FROM (SELECT *, CASE WHEN security_id % 2 = 0 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM bars)"""
)
def v5_apply_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bars(spark, sf_dir)
    scales = found.select("security_id").distinct().withColumn("scale", F.when(F.col("security_id") % 2 == 0, 100.0).otherwise(1.0))
    return p.apply_scales(found, scales).select("security_id", "trade_date", "open", "high", "low", "close", "volume")


@query(
    with_tables(BARS, ACTIONS)
    + """, s AS (SELECT * FROM actions WHERE action_type = 'split'),
b AS (SELECT s.*, b.close AS before FROM s ASOF LEFT JOIN bars b ON s.security_id = b.security_id AND s.ex_date > b.trade_date),
f AS (SELECT b.*, a.close AS after FROM b ASOF LEFT JOIN bars a ON b.security_id = a.security_id AND b.ex_date <= a.trade_date)
SELECT action_id, security_id, ex_date, CASE WHEN before IS NULL OR after IS NULL THEN 'NO_PRICE_CONTEXT' WHEN abs(ln(new_shares / old_shares)) < ln(1.35) THEN 'SMALL_UNVERIFIABLE'
  WHEN abs(ln(before / after) - ln(new_shares / old_shares)) <= ln(1.25) THEN 'REAL' WHEN abs(ln(before / after)) <= ln(1.25) THEN 'PRE_APPLIED' ELSE 'UNCLEAR' END AS verdict FROM f"""
)
def v7_split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.split_audit(actions(spark, sf_dir).where("action_type = 'split'"), bars(spark, sf_dir)).select("action_id", "security_id", "ex_date", "verdict")


@query(with_tables(BARS) + "SELECT security_id, list_sort(list(close))[len(list(close)) // 2 + 1] AS upper_median, list_sort(list(close))[ceil(len(list(close)) * 0.9)::INT] AS p90, round(quantile_cont(close, 0.9), 6) AS linear_p90 FROM bars GROUP BY 1")
def g13_g14_g15_medians_and_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("security_id").agg(
        upper_median(F.col("close")).alias("upper_median"), nearest_rank(F.col("close"), 0.9).alias("p90"), F.round(F.percentile("close", 0.9), 6).alias("linear_p90")
    )


@query(
    with_tables(BARS)
    + """SELECT security_id, trade_date, round(quantile_cont(close * volume, 0.5) OVER (PARTITION BY security_id ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 4) AS median_traded FROM bars"""
)
def g16_median_traded_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = p.series().rowsBetween(-59, 0)
    return bars(spark, sf_dir).select("security_id", "trade_date", F.round(F.percentile(F.col("close") * F.col("volume"), 0.5).over(window), 4).alias("median_traded"))


@query(with_tables(ACTIONS) + "SELECT security_id, year(ex_date)::INT AS year, round(sum(amount), 4) AS paid, count(*) AS payments FROM actions WHERE action_type = 'dividend' GROUP BY ALL")
def g17_annual_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions(spark, sf_dir).where("action_type = 'dividend'").groupBy("security_id", F.year("ex_date").alias("year")).agg(F.round(F.sum("amount"), 4).alias("paid"), F.count("*").alias("payments"))


@query(
    with_tables(BARS, ACTIONS)
    + """, d AS (SELECT a.*, b.close FROM (SELECT * FROM actions WHERE action_type = 'dividend') a ASOF JOIN bars b ON a.security_id = b.security_id AND a.ex_date >= b.trade_date),
f AS (SELECT security_id, median(amount) AS family FROM actions WHERE action_type = 'dividend' GROUP BY 1)
SELECT action_id, CASE WHEN amount / close > 0.25 THEN 'over_yield' WHEN amount < 2 THEN 'below_floor' WHEN amount > 20 * family THEN 'over_family' ELSE 'keep' END AS label FROM d JOIN f USING (security_id)"""
)
def v6_dividend_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = actions(spark, sf_dir).where("action_type = 'dividend'")
    family = paid.groupBy("security_id").agg(F.median("amount").alias("family"))
    priced = asof_join(paid, bars(spark, sf_dir).select("security_id", "trade_date", "close"), ["security_id"], "ex_date", "trade_date", {"close": "close"}).where("close IS NOT NULL")
    label = F.when(F.col("amount") / F.col("close") > 0.25, "over_yield").when(F.col("amount") < 2, "below_floor").when(F.col("amount") > 20 * F.col("family"), "over_family").otherwise("keep")
    return priced.join(family, "security_id").select("action_id", label.alias("label"))
