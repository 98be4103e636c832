"""Queries over reported figures and universe membership."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import fundamentals as f
from tidemark.operators import universe as u
from tidemark.plans.fixtures import BARS, FACTS, SPELLS, bars, facts, spells, table, with_tables
from tidemark.plans.registry import query

LATEST = "QUALIFY row_number() OVER (PARTITION BY security_id, line_item, period_end ORDER BY revision DESC) = 1"


@query(with_tables(FACTS) + f"SELECT security_id, line_item, period_end, revision, cents, available_on FROM facts {LATEST}")
def g1_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.latest_revision(facts(spark, sf_dir)).select("security_id", "line_item", "period_end", "revision", "cents", "available_on")


@query(
    with_tables(FACTS)
    + f"SELECT security_id, line_item, period_end, revision, cents FROM facts WHERE line_item IN ('1-URGENT', '2-HIGH') AND period_end BETWEEN DATE '1993-01-01' AND DATE '1996-12-31' AND available_on <= DATE '1996-09-30' {LATEST}"
)
def n1_point_in_time_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = f.point_in_time(facts(spark, sf_dir), date(1996, 9, 30), items=["1-URGENT", "2-HIGH"], start=date(1993, 1, 1), end=date(1996, 12, 31))
    return found.select("security_id", "line_item", "period_end", "revision", "cents")


N2 = """, o AS (SELECT security_id, line_item, period_end, source_id, currency, available_on, cents // 5000000 AS v FROM facts),
k AS (SELECT *, lag(v) OVER w AS pv, lag(currency) OVER w AS pc, lag(available_on) OVER w AS pa, row_number() OVER w AS n FROM o WINDOW w AS (PARTITION BY security_id, line_item, period_end ORDER BY available_on, source_id)),
c AS (SELECT *, CASE WHEN n = 1 THEN 'new' WHEN pv IS NOT DISTINCT FROM v THEN 'unchanged' ELSE 'revision' END AS kind FROM k)
SELECT source_id, kind, (sum((kind = 'revision')::INT) OVER (PARTITION BY security_id, line_item, period_end ORDER BY available_on, source_id))::INT AS sequence,
  CASE WHEN pc <> currency THEN 'currency_change' WHEN pa >= available_on THEN 'knowledge_not_increasing' END AS error FROM c"""


@query(with_tables(FACTS) + N2)
def n2_classify_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = facts(spark, sf_dir).withColumn("v", F.floor(F.col("cents") / 5000000))
    return f.classify_observations(coarse, value="v").select("source_id", "kind", "sequence", "error")


@query(
    with_tables(FACTS)
    + """, k AS (SELECT security_id, line_item, period_end, revision, available_on - (source_id % 60)::INT AS a FROM facts WHERE revision <> 1),
x AS (SELECT *, row_number() OVER w - 1 AS n, lag(a) OVER w AS pa FROM k WINDOW w AS (PARTITION BY security_id, line_item, period_end ORDER BY revision)),
y AS (SELECT *, CASE WHEN revision <> n THEN 'gap' WHEN pa > a THEN 'not_monotone' END AS fault FROM x)
SELECT security_id, line_item, period_end, min(fault) AS fault, count(*) AS rows FROM y WHERE fault IS NOT NULL GROUP BY ALL"""
)
def w34_revision_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = facts(spark, sf_dir).where("revision <> 1").withColumn("available_on", F.date_sub("available_on", (F.col("source_id") % 60).cast("int")))
    return f.revision_faults(broken)


MAPPING = [("1-URGENT", "revenue", "as_reported", "verified"), ("2-HIGH", "cost", "flip", "verified"), ("3-MEDIUM", "profit", "as_reported", "provisional"), ("4-NOT SPECIFIED", None, "as_reported", "excluded")]
MAPPING_SQL = ", mp(provider_item, canonical, sign, review_status) AS (VALUES ('1-URGENT', 'revenue', 'as_reported', 'verified'), ('2-HIGH', 'cost', 'flip', 'verified'), ('3-MEDIUM', 'profit', 'as_reported', 'provisional'), ('4-NOT SPECIFIED', NULL, 'as_reported', 'excluded'))"


def normalised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = facts(spark, sf_dir).select("source_id", "security_id", F.col("line_item").alias("provider_item"), F.col("cents").alias("value"))
    return f.normalise(items, spark.createDataFrame(MAPPING, "provider_item string, canonical string, sign string, review_status string"))


@query(with_tables(FACTS) + MAPPING_SQL + "SELECT source_id, canonical, CASE WHEN sign = 'flip' THEN -cents ELSE cents END AS value FROM facts JOIN mp ON line_item = provider_item WHERE review_status <> 'excluded'")
def n3_normalised_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(spark, sf_dir)[0].select("source_id", "canonical", "value")


@query(with_tables(FACTS) + MAPPING_SQL + "SELECT source_id, line_item AS provider_item, CASE WHEN review_status IS NULL THEN 'unmapped' ELSE 'excluded' END AS reason FROM facts LEFT JOIN mp ON line_item = provider_item WHERE review_status IS NULL OR review_status = 'excluded'")
def n3_unmapped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(spark, sf_dir)[1].select("source_id", "provider_item", "reason")


@query(with_tables(FACTS) + MAPPING_SQL + "SELECT source_id, canonical, -cents AS value FROM facts JOIN mp ON line_item = provider_item WHERE canonical = 'cost'")
def n4_sign_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("revenue", "positive"), ("cost", "positive"), ("profit", "any")], "canonical string, convention string")
    return f.sign_violations(normalised(spark, sf_dir)[0], rules).select("source_id", "canonical", "value")


@query(with_tables(FACTS) + "SELECT line_item AS provider_item, count(*) AS rows, count(DISTINCT security_id) AS securities, list_sort(list(abs(cents)))[len(list(cents)) // 2 + 1] AS typical FROM facts GROUP BY 1")
def n7_item_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.item_profile(facts(spark, sf_dir).select("security_id", F.col("line_item").alias("provider_item"), F.col("cents").alias("value")))


CONVERTED = """, fx AS (SELECT DISTINCT 'USD' AS base, period_end AS date, 0.75::DOUBLE + (year(period_end) % 10) / 100.0 AS rate FROM facts WHERE year(period_end) <> 1995),
j AS (SELECT source_id, line_item, cents / 100.0 AS v, currency, rate, CASE WHEN line_item = '5-LOW' THEN 'not_monetary' WHEN currency = 'GBP' THEN 'same_currency' WHEN rate IS NULL THEN 'no_rate' WHEN date + 1 > DATE '1997-06-30' THEN 'rate_not_known' ELSE 'converted' END AS note
  FROM facts LEFT JOIN fx ON currency = base AND period_end = date)
SELECT source_id, note, CASE WHEN note IN ('not_monetary', 'same_currency') THEN round(v, 4) WHEN note = 'converted' THEN round(v * rate, 4) END AS value, CASE WHEN note = 'converted' THEN 'GBP' ELSE currency END AS currency, currency AS original_currency FROM j"""


@query(with_tables(FACTS) + CONVERTED)
def n5_currency_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts(spark, sf_dir).withColumn("value", F.col("cents") / 100.0)
    rates = own.where(F.year("period_end") != 1995).select(F.lit("USD").alias("base"), F.lit("GBP").alias("quote"), F.col("period_end").alias("date"), (0.75 + F.year("period_end") % 10 / 100.0).alias("rate")).distinct()
    found = f.converted(own, rates, "GBP", monetary=F.col("line_item") != "5-LOW", known_at=date(1997, 6, 30))
    return found.select("source_id", "note", F.round("value", 4).alias("value"), "currency", "original_currency")


@query(
    "SELECT o_orderkey, CASE WHEN trusted THEN filed ELSE pe + days END AS available, CASE WHEN NOT trusted THEN 'period_end+' || days || 'd' END AS rule FROM (SELECT *, coalesce(filed - pe > 5, false) AS trusted FROM (SELECT o_orderkey, o_orderdate::DATE AS pe, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate::DATE + (o_orderkey % 40)::INT END AS filed, CASE WHEN o_orderpriority = '1-URGENT' THEN 120 ELSE 90 END AS days FROM orders))"
)
def f10_imputed_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders")
    rows = order.select(
        "o_orderkey", F.to_date("o_orderdate").alias("period_end"), F.when(F.col("o_orderkey") % 5 != 0, F.date_add("o_orderdate", (F.col("o_orderkey") % 40).cast("int"))).alias("filed_on"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "annual").otherwise("interim").alias("period_type"),
    )
    available, rule = f.imputed_availability()
    return rows.select("o_orderkey", available.alias("available"), rule.alias("rule"))


@query(
    with_tables(FACTS)
    + f""", l AS (SELECT * FROM facts {LATEST}),
w AS (SELECT security_id, period_end, count(DISTINCT line_item) AS n, count(DISTINCT currency) AS c, min(currency) AS currency, max(CASE WHEN line_item = '1-URGENT' THEN cents END) AS a, max(CASE WHEN line_item = '2-HIGH' THEN cents END) AS b
  FROM l WHERE line_item IN ('1-URGENT', '2-HIGH') GROUP BY ALL HAVING count(DISTINCT line_item) = 2),
m AS (SELECT *, coalesce(sum((c > 1)::INT) OVER (PARTITION BY security_id ORDER BY period_end DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS mixed FROM w)
SELECT security_id, period_end, currency, a AS "1-URGENT", b AS "2-HIGH", mixed AS mixed_currency_periods FROM m WHERE c = 1 QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY period_end DESC) = 1"""
)
def n9_consistent_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.snapshot(f.latest_revision(facts(spark, sf_dir)), ["1-URGENT", "2-HIGH"], "cents")


@query(with_tables(FACTS) + f", l AS (SELECT * FROM facts {LATEST}), r AS (SELECT *, row_number() OVER (PARTITION BY security_id, line_item ORDER BY period_end DESC) AS n FROM l) SELECT security_id, line_item, array_to_string(list(cents ORDER BY period_end), ',') AS vals FROM r WHERE n <= 3 GROUP BY ALL")
def g21_trailing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = f.trailing_values(f.latest_revision(facts(spark, sf_dir)), 3, "cents")
    return found.select("security_id", "line_item", F.array_join(F.col("values").cast("array<string>"), ",").alias("vals"))


@query(with_tables(FACTS) + "SELECT security_id, CASE WHEN count(DISTINCT currency) = 1 THEN sum(cents)::BIGINT END AS total, CASE WHEN count(DISTINCT currency) = 1 THEN min(currency) END AS currency, CASE WHEN count(DISTINCT currency) = 1 THEN 'ok' ELSE 'mixed_currencies' END AS status FROM facts GROUP BY 1")
def g19_g20_single_currency_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.guarded_sum(facts(spark, sf_dir), ["security_id"], "cents")


LAGS = "WITH l AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'annual' ELSE 'interim' END AS period_type, (o_orderkey % 130)::INT AS lag FROM orders)"


@query(LAGS + " SELECT period_type, count(*) AS filings, list_sort(list(lag))[ceil(count(*) * 0.5)::INT] AS p50, list_sort(list(lag))[ceil(count(*) * 0.75)::INT] AS p75, list_sort(list(lag))[ceil(count(*) * 0.9)::INT] AS p90, max(lag) AS longest, list_sort(list(lag))[ceil(count(*) * 0.9)::INT] > CASE WHEN period_type = 'annual' THEN 120 ELSE 90 END AS trigger FROM l GROUP BY 1")
def c11_filing_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders")
    rows = order.select(F.to_date("o_orderdate").alias("period_end"), F.date_add("o_orderdate", (F.col("o_orderkey") % 130).cast("int")).alias("filed_on"), F.when(F.col("o_orderpriority") == "1-URGENT", "annual").otherwise("interim").alias("period_type"))
    return f.filing_lags(rows, ["period_type"], {"annual": 120, "interim": 90})


@query(
    with_tables(SPELLS)
    + """, v AS (SELECT * FROM spells WHERE (recorded_on IS NULL OR recorded_on <= DATE '1997-01-01') AND (superseded_on IS NULL OR superseded_on > DATE '1997-01-01'))
SELECT DISTINCT universe, security_id FROM v WHERE valid_from <= DATE '1996-06-30' AND (valid_to IS NULL OR DATE '1996-06-30' < valid_to) AND universe IN (SELECT universe FROM v GROUP BY 1 HAVING min(valid_from) <= DATE '1996-06-30')"""
)
def x1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.members(spells(spark, sf_dir), date(1996, 6, 30), date(1997, 1, 1))


@query(with_tables(SPELLS) + "SELECT security_id, universe, valid_from, valid_to FROM spells WHERE security_id = 7")
def x3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.history(spells(spark, sf_dir), 7).select("security_id", "universe", "valid_from", "valid_to")


@query(with_tables(SPELLS) + 'SELECT universe, min(valid_from) AS start, CASE WHEN NOT bool_or(valid_to IS NULL) THEN max(valid_to) END AS "end", count(DISTINCT security_id) AS securities FROM spells GROUP BY 1')
def x4_universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.coverage(spells(spark, sf_dir))


@query(
    with_tables(SPELLS)
    + """SELECT universe, security_id, valid_from, valid_to, recorded_on, CASE WHEN valid_to IS NULL AND superseded_on IS NULL AND universe = 3 THEN DATE '1999-01-01' ELSE superseded_on END AS superseded_on FROM spells
UNION ALL SELECT universe, security_id, valid_from, DATE '1998-12-31', DATE '1999-01-01', superseded_on FROM spells WHERE valid_to IS NULL AND superseded_on IS NULL AND universe = 3"""
)
def x6_close_open_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.closed(spells(spark, sf_dir), F.col("universe") == 3, date(1998, 12, 31), date(1999, 1, 1))


CHANGES = with_tables(SPELLS) + """, one AS (SELECT universe, security_id, min(valid_from) AS a, max(valid_to) AS z FROM spells GROUP BY ALL),
ev AS (SELECT universe, security_id, a AS effective, 'added' AS change FROM one UNION ALL SELECT universe, security_id, z, 'removed' FROM one WHERE z > a)"""


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spells(spark, sf_dir).groupBy("universe", "security_id").agg(F.min("valid_from").alias("a"), F.max("valid_to").alias("z"))
    added = one.select("universe", "security_id", F.col("a").alias("effective"), F.lit("added").alias("change"))
    return added.unionByName(one.where("z > a").select("universe", "security_id", F.col("z").alias("effective"), F.lit("removed").alias("change")))


@query(CHANGES + " SELECT universe, security_id, a AS valid_from, CASE WHEN z > a THEN z END AS valid_to, NULL::VARCHAR AS fault FROM one")
def w35_replayed_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.replay(change_events(spark, sf_dir))


@query(CHANGES + ", d AS (SELECT universe, effective, sum(CASE WHEN change = 'added' THEN 1 ELSE -1 END)::BIGINT AS step FROM ev GROUP BY ALL) SELECT universe, effective, step, (sum(step) OVER (PARTITION BY universe ORDER BY effective))::BIGINT AS members FROM d")
def x8_running_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.sizes(change_events(spark, sf_dir))


@query(
    with_tables(SPELLS)
    + """, ours AS (SELECT DISTINCT universe, security_id FROM spells WHERE valid_from <= DATE '1996-01-01' AND (valid_to IS NULL OR DATE '1996-01-01' < valid_to) AND universe IN (SELECT universe FROM spells GROUP BY 1 HAVING min(valid_from) <= DATE '1996-01-01')),
theirs AS (SELECT c_nationkey AS universe, c_custkey AS security_id FROM customer WHERE c_acctbal > 1000)
SELECT *, 'missing' AS side FROM (FROM theirs EXCEPT FROM ours) UNION ALL SELECT *, 'unexpected' FROM (FROM ours EXCEPT FROM theirs)"""
)
def x8_checkpoint_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = table(spark, sf_dir, "customer").where("c_acctbal > 1000").select(F.col("c_nationkey").alias("universe"), F.col("c_custkey").alias("security_id"))
    return u.checkpoint_gaps(spells(spark, sf_dir), published, date(1996, 1, 1))


@query(
    with_tables(BARS, SPELLS)
    + """, mo AS (SELECT DISTINCT last_day(d::DATE) AS month_end FROM (SELECT unnest(generate_series(last_day(min(valid_from))::TIMESTAMP, last_day(max(coalesce(valid_to, valid_from)))::TIMESTAMP, INTERVAL 15 DAY)) AS d FROM spells) WHERE last_day(d::DATE) <= (SELECT last_day(max(coalesce(valid_to, valid_from))) FROM spells)),
e AS (SELECT DISTINCT universe, security_id, month_end FROM spells JOIN mo ON valid_from <= month_end AND (valid_to IS NULL OR month_end < valid_to)),
s AS (SELECT security_id, last_day(trade_date) AS month_end, count(*) AS bars FROM bars GROUP BY ALL)
SELECT universe, month_end, count(*) AS expected, count(bars) AS resolved, count(*) FILTER (bars >= 5) AS with_prices, round(100 * (1 - count(*) FILTER (bars >= 5) / count(*)), 6) AS gap_pct FROM e LEFT JOIN s USING (security_id, month_end) GROUP BY ALL"""
)
def g23_member_month_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.member_months(spells(spark, sf_dir), bars(spark, sf_dir), 5).withColumn("gap_pct", F.round("gap_pct", 6))


@query(
    r"""SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(lower(p_name || ' Group PLC'), '[^a-z0-9]+', ' ', 'g')), ' '),
  lambda w: w <> '' AND w NOT IN ('plc', 'ltd', 'limited', 'inc', 'corp', 'corporation', 'company', 'co', 'group', 'holdings', 'sa', 'ag', 'nv')), ' ') AS name FROM part"""
)
def f18_normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", u.normalised_name(F.concat("p_name", F.lit(" Group PLC"))).alias("name"))


@query(
    """WITH w AS (SELECT p_partkey, list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS a, list_filter(string_split(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS jaccard FROM w"""
)
def f19_token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.round(u.token_jaccard(u.name_tokens(F.col("p_name")), u.name_tokens(F.col("p_type"))), 9).alias("jaccard"))


@query()
def f20_fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names with a letter lost against those of all customers; difflib's ratio has no SQL."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return u.fuzzy_matches(names.select(F.concat(F.col("name"), F.lit(" plc")).alias("name")), names, margin=0.0)
