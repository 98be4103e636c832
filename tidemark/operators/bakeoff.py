"""Checks of a provider's data against known facts, weighted scoring and ranking. Every check returns findings:
provider, entry, check, outcome (pass, fail, not_applicable, error) and a note."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import relative_difference
from tidemark.functions.values import plausible_time
from tidemark.operators.temporal import asof_join

PASS, FAIL, NOT_APPLICABLE, ERROR = "pass", "fail", "not_applicable", "error"
CHECKS: dict[str, Callable[..., DataFrame]] = {}
KEYS = ("provider", "entry")
FINDING = (*KEYS, "check", "outcome", "note")


def check(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a check, a function of DataFrames, under a name of its own."""

    def register(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in CHECKS:
            raise ValueError(f"check {name} is registered twice")
        CHECKS[name] = run
        return run

    return register


def finding(df: DataFrame, name: str, outcome: Column, note: Column) -> DataFrame:
    return df.select(*KEYS, F.lit(name).alias("check"), outcome.alias("outcome"), note.alias("note"))


@check("split_ratio")
def split_ratio(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected splits (new_shares, old_shares on ex_date) against a provider's: exact, or inverted, or on another day."""
    rows = expected.alias("e").join(actual.alias("a"), [F.col("e.provider") == F.col("a.provider"), F.col("e.entry") == F.col("a.entry"), F.abs(F.datediff("e.ex_date", "a.ex_date")) <= 7], "left")
    same = (F.col("e.new_shares") * F.col("a.old_shares") == F.col("a.new_shares") * F.col("e.old_shares")) & F.col("a.new_shares").isNotNull()
    turned = F.col("e.new_shares") * F.col("a.new_shares") == F.col("a.old_shares") * F.col("e.old_shares")
    rank = F.when(same & (F.col("e.ex_date") == F.col("a.ex_date")), 0).when(same, 1).when(turned, 2).when(F.col("a.new_shares").isNotNull(), 3).otherwise(4)
    best = rows.groupBy(F.col("e.provider").alias("provider"), F.col("e.entry").alias("entry"), F.col("e.ex_date").alias("ex_date")).agg(F.min(rank).alias("_r"))
    note = F.element_at(F.array(*[F.lit(x) for x in ("exact", "other_date", "inverted_ratio", "other_ratio", "missing")]), F.col("_r") + 1)
    return finding(best, "split_ratio", F.when(F.col("_r") == 0, PASS).otherwise(FAIL), note)


@check("dividend_amount")
def dividend_amount(expected: DataFrame, actual: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Expected dividends against a provider's on the same day, within a relative tolerance; a factor of 100 is named."""
    rows = expected.alias("e").join(actual.select(*KEYS, "ex_date", F.col("amount").alias("found")).alias("a"), [*KEYS, "ex_date"], "left")
    gap = relative_difference(F.col("found"), F.col("amount"))
    hundred = (relative_difference(F.col("found"), F.col("amount") * 100) <= tolerance) | (relative_difference(F.col("found") * 100, F.col("amount")) <= tolerance)
    note = F.when(F.col("found").isNull(), "missing").when(gap <= tolerance, "within").when(hundred, "unit").otherwise("amount")
    return finding(rows, "dividend_amount", F.when(gap <= tolerance, PASS).otherwise(FAIL), note)


@check("delisted_history")
def delisted_history(expected: DataFrame, bars: DataFrame, days: int = 5) -> DataFrame:
    """A delisted entry's history ends within `days` of its delisting: without rows, overrun and shortfall fail."""
    last = bars.groupBy(*KEYS).agg(F.max("trade_date").alias("last"))
    rows = expected.groupBy(*KEYS).agg(F.min("delisted_on").alias("delisted_on")).join(last, list(KEYS), "left")
    gap = F.datediff("last", "delisted_on")
    note = F.when(F.col("last").isNull(), "no_rows").when(gap > days, "overrun").when(gap < -days, "shortfall").otherwise("within")
    return finding(rows, "delisted_history", F.when(F.abs(gap) <= days, PASS).otherwise(FAIL), note)


@check("history_depth")
def history_depth(bars: DataFrame, years: int = 20) -> DataFrame:
    span = bars.groupBy(*KEYS).agg(F.datediff(F.max("trade_date"), F.min("trade_date")).alias("days"))
    return finding(span, "history_depth", F.when(F.col("days") >= years * 365, PASS).otherwise(FAIL), F.col("days").cast("string"))


@check("raw_versus_adjusted")
def raw_versus_adjusted(bars: DataFrame, actions: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Whether a provider's adjusted close is what its own actions give: the largest relative error of the rebuilt one.

    bars: close, provider_adjusted and rebuilt (from the actions); entries without actions or an adjusted series don't
    apply, and an adjusted series equal to the raw one fails.
    """
    counted = actions.groupBy(*KEYS).agg(F.count("*").alias("_actions"))
    rows = bars.groupBy(*KEYS).agg(F.count("provider_adjusted").alias("_n"), F.max(relative_difference(F.col("rebuilt"), F.col("provider_adjusted"))).alias("_error"), F.max(relative_difference(F.col("close"), F.col("provider_adjusted"))).alias("_raw"))
    joined = rows.join(counted, list(KEYS), "left")
    outcome = F.when((F.col("_n") == 0) | F.col("_actions").isNull(), NOT_APPLICABLE).when(F.col("_raw") < 1e-9, FAIL).when(F.col("_error") <= tolerance, PASS).otherwise(FAIL)
    note = F.when(F.col("_n") == 0, "no_adjusted_series").when(F.col("_actions").isNull(), "no_actions").when(F.col("_raw") < 1e-9, "equals_raw").when(F.col("_error") <= tolerance, "within").otherwise("reconstruction")
    return finding(joined, "raw_versus_adjusted", outcome, note)


@check("ticker_change")
def ticker_change(expected: DataFrame, bars: DataFrame, days: int = 7, jump: float = 0.25) -> DataFrame:
    """Over a change of ticker the history goes on: at most `days` apart and not more than `jump` in price."""
    take = lambda p: {"trade_date": f"{p}_date", "close": f"{p}_close"}
    rows = asof_join(expected, bars, list(KEYS), "changed_on", "trade_date", take("before"), strict=True)
    rows = asof_join(rows, bars, list(KEYS), "changed_on", "trade_date", take("after"), forward=True)
    gap, move = F.datediff("after_date", "before_date"), F.abs(F.col("after_close") / F.nullif(F.col("before_close"), F.lit(0.0)) - 1)
    note = F.when(gap.isNull(), "no_history").when(gap > days, "gap").when(move > jump, "jump").otherwise("continuous")
    return finding(rows, "ticker_change", F.when((gap <= days) & (move <= jump), PASS).otherwise(FAIL), note)


@check("timestamp_presence")
def timestamp_presence(statements: DataFrame, least: float = 0.9) -> DataFrame:
    """The part of statements with a filing day; the note has it in thousandths."""
    share = statements.groupBy(*KEYS).agg(F.avg(F.col("filed_on").isNotNull().cast("double")).alias("_share"))
    return finding(share, "timestamp_presence", F.when(F.col("_share") >= least, PASS).otherwise(FAIL), F.floor(F.col("_share") * 1000).cast("string"))


@check("timestamp_plausibility")
def timestamp_plausibility(statements: DataFrame, today: str, share: float = 0.9) -> DataFrame:
    """The first rule that fails: all equal to the period's end; any before 1980 or in the future; one lag, or the first
    of a month, in at least `share` of three or more."""
    day, lag = F.col("filed_on"), F.datediff("filed_on", "period_end")
    rows = statements.where("filed_on IS NOT NULL").withColumn("_lag", lag)
    modal = rows.groupBy(*KEYS, "_lag").agg(F.count("*").alias("_c")).groupBy(*KEYS).agg(F.max("_c").alias("_modal"))
    found = rows.groupBy(*KEYS).agg(
        F.count("*").alias("_n"), F.bool_and(day == F.col("period_end")).alias("_ends"), F.bool_or((F.year(day) < 1980) | (day > F.lit(today).cast("date"))).alias("_odd"), F.avg((F.dayofmonth(day) == 1).cast("double")).alias("_first")
    ).join(modal, list(KEYS))
    note = F.when(F.col("_ends"), "period_ends").when(F.col("_odd"), "impossible").when((F.col("_n") >= 3) & (F.col("_modal") / F.col("_n") >= share), "one_lag").when((F.col("_n") >= 3) & (F.col("_first") >= share), "firsts_of_months").otherwise("plausible")
    return finding(found.withColumn("_note", note), "timestamp_plausibility", F.when(F.col("_note") == "plausible", PASS).otherwise(FAIL), F.col("_note"))


@check("availability_class")
def availability_class(statements: DataFrame) -> DataFrame:
    """How well knowledge can be dated: filed and revised days, filed days alone, or imputed only (which fails)."""
    found = statements.groupBy(*KEYS).agg(F.count("filed_on").alias("_filed"), F.count("revised_on").alias("_revised"))
    note = F.when((F.col("_filed") > 0) & (F.col("_revised") > 0), "point_in_time").when(F.col("_filed") > 0, "filing_dates").otherwise("imputed_only")
    return finding(found, "availability_class", F.when(F.col("_filed") > 0, PASS).otherwise(FAIL), note)


@check("restatement_visibility")
def restatement_visibility(expected: DataFrame, statements: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Known restatements (original and restated value) show both values of an item and period, or only one."""
    hit = lambda c: F.max((relative_difference(F.col("value"), F.col(c)) <= tolerance).cast("int"))
    rows = expected.join(statements, [*KEYS, "line_item", "period_end"], "left").groupBy(*KEYS, "line_item", "period_end").agg(hit("original").alias("_o"), hit("restated").alias("_r"))
    note = F.when((F.col("_o") == 1) & (F.col("_r") == 1), "both").when(F.col("_r") == 1, "restated_only").when(F.col("_o") == 1, "original_only").otherwise("neither")
    return finding(rows, "restatement_visibility", F.when(note == "both", PASS).otherwise(FAIL), note)


@check("payload_presence")
def payload_presence(payloads: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    return finding(payloads, "payload_presence", F.when(size > 0, PASS).otherwise(FAIL), size.cast("string"))


def pending_cells(providers: DataFrame, entries: DataFrame, datasets: DataFrame, done: DataFrame) -> DataFrame:
    """The cells of a run that aren't done: each provider, entry and dataset. All three are lists of a few names."""
    return providers.crossJoin(F.broadcast(entries)).crossJoin(F.broadcast(datasets)).join(done, ["provider", "entry", "dataset"], "left_anti")


def scored(findings: DataFrame, criteria: DataFrame, vetoes: Sequence[str] = (), floor: float = 0.5) -> DataFrame:
    """A provider's score: pass ratios by criterion, weighted over the criteria that could be measured.

    criteria: check, criterion, weight. Findings that don't apply are not counted; a vetoing criterion below `floor`
    bars the provider.
    """
    ratio = F.sum((F.col("outcome") == PASS).cast("int")) / F.nullif(F.count_if(F.col("outcome") != NOT_APPLICABLE), F.lit(0))
    by = findings.join(criteria, "check").groupBy("provider", "criterion").agg(ratio.alias("ratio"), F.max("weight").alias("weight")).where("ratio IS NOT NULL")
    barred = F.bool_or(F.col("criterion").isin(*vetoes) & (F.col("ratio") < floor)) if vetoes else F.lit(False)
    return by.groupBy("provider").agg((F.sum(F.col("ratio") * F.col("weight")) / F.sum("weight")).alias("score"), F.count("*").alias("measured"), F.any_value(barred).alias("barred") if not vetoes else barred.alias("barred"))


def ranked(scores: DataFrame, margin: float = 0.05) -> DataFrame:
    """Providers by score, barred ones last, and whether the first one's lead decides."""
    order = Window.orderBy("barred", F.desc("score"), "provider")
    lead = F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0))
    out = scores.withColumn("rank", F.row_number().over(order)).withColumn("_lead", lead)
    return out.withColumn("recommendation", F.when(F.col("barred"), "barred").when((F.col("rank") == 1) & (F.col("_lead") >= margin), "recommended").when(F.col("rank") == 1, "inconclusive").otherwise("not_first")).drop("_lead")


def run_checks(checks: Mapping[str, Callable[[], DataFrame]], cells: DataFrame, root: str) -> DataFrame:
    """The findings of all checks, each written below `root` by itself, so that one that raises loses no other's.

    A check that raises, while its plan is made or while it runs, gives an error finding for every cell (provider,
    entry) in place of its findings.
    """
    for name, run in checks.items():
        path = f"{root}/{name}"
        try:
            run().select(*FINDING).write.mode("overwrite").parquet(path)
        except (PySparkException, ValueError, KeyError, ArithmeticError) as lost:
            failed = finding(cells.distinct(), name, F.lit(ERROR), F.lit(type(lost).__name__))
            failed.write.mode("overwrite").parquet(path)
    return cells.sparkSession.read.schema(", ".join(f"{c} string" for c in FINDING)).parquet(*[f"{root}/{name}" for name in checks])


def append_cells(findings: DataFrame, path: str) -> None:
    """Adds findings to a run's JSON lines."""
    findings.write.mode("append").json(path)


def completed_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells (provider, entry, dataset) that a run's JSON lines hold already; none before the first write."""
    fields = "provider string, entry string, dataset string"
    try:
        return spark.read.schema(fields).json(path).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], fields)


def entry_faults(entries: DataFrame) -> DataFrame:
    """(entry, place, fault) of a list of entries (place, entry) that isn't coherent: a key that is there twice, or one
    that sorts before the key at the place before it. The list is one file's, so one window holds it."""
    turn = Window.orderBy("place")
    twice = F.row_number().over(Window.partitionBy("entry").orderBy("place")) > 1
    marked = entries.withColumn("fault", F.when(twice, "duplicate").when(F.col("entry") < F.lag("entry").over(turn), "unsorted"))
    return marked.where("fault IS NOT NULL").select("entry", "place", "fault")


def derived_availability(statements: DataFrame, lags: Mapping[tuple[str, str], int], today: str) -> DataFrame:
    """statements (market, period_type, period_end, filed_on) with available_on, imputed and rule.

    A plausible filing day counts as it is. Otherwise the period's end plus the days assumed for the market and type, by
    a rule that is named; without a period's end nothing is derived.
    """
    end, filed = F.col("period_end"), F.col("filed_on")
    usable = F.coalesce(plausible_time(filed, end, F.lit(today).cast("date")), F.lit(False))
    days = F.coalesce(*[F.when((F.col("market") == m) & (F.col("period_type") == p), F.lit(n)) for (m, p), n in lags.items()])
    rule = F.concat("market", F.lit("-"), "period_type", F.lit("-lag-"), days.cast("string"), F.lit("d"))
    return statements.withColumns({
        "available_on": F.when(usable, filed).otherwise(F.date_add(end, days)), "imputed": ~usable, "rule": F.when(~usable & end.isNotNull(), rule),
    })
