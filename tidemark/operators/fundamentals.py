"""Reported figures: point-in-time queries, revisions, normalisation, currency conversion and consistent snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import upper_median
from tidemark.operators.temporal import Instant, as_of

KEY = ("security_id", "line_item", "period_end")


def latest_revision(df: DataFrame, key: Sequence[str] = KEY, revision: str = "revision") -> DataFrame:
    """The row with the highest revision of each key."""
    turn = Window.partitionBy(*key).orderBy(F.desc(revision))
    return df.withColumn("_n", F.row_number().over(turn)).where("_n = 1").drop("_n")


def point_in_time(df: DataFrame, instant: Instant, *, items: Sequence[str] | None = None, securities: Sequence | None = None, start: Instant | None = None, end: Instant | None = None, available: str = "available_on") -> DataFrame:
    """What was known at the instant: filters first, so that they reach the scan, then the knowledge cut, then each
    key's latest revision. An unknown item is an error, as a typing slip would else look like missing data."""
    if items is not None:
        known = {r[0] for r in df.select("line_item").where(F.col("line_item").isin(list(items))).distinct().collect()}
        if lost := set(items) - known:
            raise ValueError(f"unknown line items: {sorted(lost)}")
        df = df.where(F.col("line_item").isin(list(items)))
    if securities is not None:
        df = df.where(F.col("security_id").isin(list(securities)))
    if start is not None:
        df = df.where(F.col("period_end") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("period_end") <= F.lit(end))
    return latest_revision(as_of(df, instant, available))


def classify_observations(df: DataFrame, key: Sequence[str] = KEY, value: str = "cents", order: Sequence[str] = ("available_on", "source_id")) -> DataFrame:
    """Every observation as new, unchanged or revision, with the revision's number; a change of currency and a time of
    knowledge that doesn't increase are marked as errors."""
    turn = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(value).over(turn)
    first = F.row_number().over(turn) == 1
    kind = F.when(first, "new").when(before.eqNullSafe(F.col(value)), "unchanged").otherwise("revision")
    marked = df.withColumn("kind", kind).withColumn("_currency", F.lag("currency").over(turn)).withColumn("_available", F.lag(order[0]).over(turn))
    error = F.when(F.col("_currency").isNotNull() & (F.col("_currency") != F.col("currency")), "currency_change").when(F.col("_available") >= F.col(order[0]), "knowledge_not_increasing")
    number = F.sum((F.col("kind") == "revision").cast("int")).over(turn.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("error", error).withColumn("sequence", number.cast("int")).drop("_currency", "_available")


def revision_faults(df: DataFrame, key: Sequence[str] = KEY, revision: str = "revision", available: str = "available_on") -> DataFrame:
    """Keys whose revisions have a gap, or whose times of knowledge don't increase with the revision."""
    turn = Window.partitionBy(*key).orderBy(revision)
    gap = F.col(revision) != F.row_number().over(turn) - 1
    late = F.lag(available).over(turn) > F.col(available)
    marked = df.withColumn("_fault", F.when(gap, "gap").when(late, "not_monotone"))
    return marked.where("_fault IS NOT NULL").groupBy(*key).agg(F.min("_fault").alias("fault"), F.count("*").alias("rows"))


def normalise(items: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provider items as canonical ones, with the sign turned where the mapping says so; and the unmapped with a reason.

    items: provider_item, value, ...; mapping: provider_item, canonical, sign (as_reported or flip), review_status.
    """
    joined = items.join(F.broadcast(mapping) if _small(mapping) else mapping, "provider_item", "left")
    reason = F.when(F.col("review_status").isNull(), "unmapped").when(F.col("review_status") == "excluded", "excluded").when(F.col("canonical").isNull(), "no_canonical")
    marked = joined.withColumn("reason", reason)
    mapped = marked.where("reason IS NULL").withColumn("value", F.when(F.col("sign") == "flip", -F.col("value")).otherwise(F.col("value"))).drop("reason")
    return mapped, marked.where("reason IS NOT NULL").drop("canonical", "sign", "review_status")


#: Most rows of a table that is broadcast; larger ones are joined by shuffle.
SMALL = 100_000


def _small(df: DataFrame) -> bool:
    """Whether a table has at most SMALL rows; counts no further."""
    return df.limit(SMALL + 1).count() <= SMALL


def sign_violations(mapped: DataFrame, conventions: DataFrame) -> DataFrame:
    """Values against their item's sign convention (positive or negative; any doesn't bind)."""
    joined = mapped.join(conventions, "canonical")
    return joined.where(((F.col("convention") == "positive") & (F.col("value") < 0)) | ((F.col("convention") == "negative") & (F.col("value") > 0)))


def item_profile(items: DataFrame) -> DataFrame:
    """How often each provider item occurs and its typical size, the upper median of absolute values."""
    return items.groupBy("provider_item").agg(F.count("*").alias("rows"), F.count_distinct("security_id").alias("securities"), upper_median(F.abs("value")).alias("typical"))


def converted(df: DataFrame, rates: DataFrame, to: str, *, monetary: Column | None = None, places: int = 6, known_at: Instant | None = None) -> DataFrame:
    """Values in another currency at the rate of their period's end, rounded half to even, with an audit trail.

    rates: base, quote, date, rate (units of quote for one of base); a reversed pair is never inverted. Rates are known
    on the day after their own. Rows that aren't monetary pass unchanged. A missing rate, or one not known yet, gives a
    null value and a note instead of an error.
    """
    own = rates.where(F.col("quote") == to).select(F.col("base").alias("currency"), F.col("date").alias("period_end"), "rate", F.date_add("date", 1).alias("_known"))
    joined = df.join(own, ["currency", "period_end"], "left")
    is_money = monetary if monetary is not None else F.lit(True)
    late = F.col("_known") > F.lit(known_at) if known_at is not None else F.lit(False)
    note = F.when(~is_money, "not_monetary").when(F.col("currency") == to, "same_currency").when(F.col("rate").isNull(), "no_rate").when(late, "rate_not_known").otherwise("converted")
    value = F.when(F.col("note").isin("not_monetary", "same_currency"), F.col("value")).when(F.col("note") == "converted", F.bround(F.col("value") * F.col("rate"), places))
    out = joined.withColumn("note", note).withColumn("original_value", F.col("value")).withColumn("original_currency", F.col("currency")).withColumn("value", value)
    return out.withColumn("currency", F.when(F.col("note") == "converted", F.lit(to)).otherwise(F.col("currency"))).drop("_known")


def imputed_availability(period_end: str = "period_end", filed: str = "filed_on", period_type: str = "period_type") -> tuple[Column, Column]:
    """(available, rule): the filing day if it is more than five days after the period's end, else the end plus 120
    days for annual figures and 90 for others."""
    trusted = F.coalesce(F.datediff(filed, period_end) > 5, F.lit(False))
    days = F.when(F.col(period_type) == "annual", 120).otherwise(90)
    rule = F.when(~trusted, F.concat(F.lit("period_end+"), days.cast("string"), F.lit("d")))
    return F.when(trusted, F.col(filed)).otherwise(F.date_add(period_end, days)), rule


def snapshot(df: DataFrame, items: Sequence[str], value: str = "value") -> DataFrame:
    """Of each security the newest period that has all items in one currency: period_end, currency, a column for each
    item, and how many newer periods were passed over because their currencies differ."""
    wide = df.where(F.col("line_item").isin(list(items))).groupBy("security_id", "period_end").agg(
        F.count_distinct("line_item").alias("_items"), F.count_distinct("currency").alias("_currencies"), F.min("currency").alias("currency"),
        *[F.max(F.when(F.col("line_item") == i, F.col(value))).alias(i) for i in items],
    ).where(F.col("_items") == len(items))
    newest = Window.partitionBy("security_id").orderBy(F.desc("period_end"))
    mixed = F.sum((F.col("_currencies") > 1).cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, -1))
    ranked = wide.withColumn("mixed_currency_periods", F.coalesce(mixed, F.lit(0))).where("_currencies = 1").withColumn("_n", F.row_number().over(newest))
    return ranked.where("_n = 1").drop("_n", "_items", "_currencies")


def trailing_values(df: DataFrame, count: int, value: str = "value") -> DataFrame:
    """The last `count` periods' values of each security and item, oldest first."""
    newest = Window.partitionBy("security_id", "line_item").orderBy(F.desc("period_end"))
    recent = df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= count)
    ordered = F.array_sort(F.collect_list(F.struct("period_end", F.col(value).alias("v"))))
    return recent.groupBy("security_id", "line_item").agg(F.transform(ordered, lambda x: x["v"]).alias("values"))


def guarded_sum(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Sums that are null, with a status, where more than one currency would be added."""
    found = df.groupBy(*by).agg(F.sum(value).alias("_sum"), F.count_distinct("currency").alias("currencies"), F.min("currency").alias("_currency"))
    single = F.col("currencies") == 1
    return found.select(*by, F.when(single, F.col("_sum")).alias("total"), F.when(single, F.col("_currency")).alias("currency"), F.when(single, "ok").otherwise("mixed_currencies").alias("status"))


def filing_lags(df: DataFrame, by: Sequence[str], assumed: dict[str, int]) -> DataFrame:
    """Nearest-rank percentiles of filing lags by period class, and whether the 90th exceeds the assumed lag; below
    three filings there is no conclusion."""
    from tidemark.functions.stats import nearest_rank

    lag = F.datediff("filed_on", "period_end")
    out = df.where("filed_on IS NOT NULL").groupBy(*by).agg(F.count("*").alias("filings"), *[nearest_rank(lag, p / 100).alias(f"p{p}") for p in (50, 75, 90)], F.max(lag).alias("longest"))
    limit = F.coalesce(*[F.when(F.col("period_type") == k, F.lit(v)) for k, v in assumed.items()])
    return out.withColumn("trigger", F.when(F.col("filings") >= 3, F.col("p90") > limit))


def mapping_faults(mapping: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """What is wrong with a mapping table: items mapped twice, canonical items that the taxonomy (canonical, statement)
    lacks or has in another statement, unknown signs, and exclusions with a target."""
    twice = mapping.groupBy("provider_item").agg(F.count("*").alias("_n")).where("_n > 1").select("provider_item", F.lit("mapped_twice").alias("fault"))
    known = mapping.where("canonical IS NOT NULL").join(taxonomy.withColumnRenamed("statement", "_statement"), "canonical", "left")
    lost = known.where("_statement IS NULL").select("provider_item", F.lit("unknown_canonical").alias("fault"))
    wrong = known.where("_statement <> statement").select("provider_item", F.lit("other_statement").alias("fault"))
    sign = mapping.where(~F.col("sign").isin("as_reported", "flip")).select("provider_item", F.lit("unknown_sign").alias("fault"))
    kept = mapping.where("review_status = 'excluded' AND canonical IS NOT NULL").select("provider_item", F.lit("excluded_with_target").alias("fault"))
    return twice.unionByName(lost).unionByName(wrong).unionByName(sign).unionByName(kept)


def normalisation_summary(mapped: DataFrame, unmapped: DataFrame) -> DataFrame:
    """Counts of mapped items by canonical and of unmapped ones by reason."""
    done = mapped.groupBy(F.col("canonical").alias("name")).agg(F.count("*").alias("items")).withColumn("outcome", F.lit("mapped"))
    left = unmapped.groupBy(F.col("reason").alias("name")).agg(F.count("*").alias("items")).withColumn("outcome", F.lit("unmapped"))
    return done.unionByName(left)


def canonicalised(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Provider items with verified mappings as canonical records: sign, imputed availability and its rule."""
    mapped, _ = normalise(items, mapping.where("review_status = 'verified'"))
    available, rule = imputed_availability("period_end", "filed_on", "period_type")
    return mapped.select("security_id", "statement", F.col("canonical").alias("line_item"), "period_end", "period_type", "currency", "value", available.alias("available_on"), rule.isNotNull().alias("availability_imputed"), rule.alias("imputation_rule"))
