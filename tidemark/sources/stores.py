"""Stores on Parquet: pinned schemas, append-only idempotent writes, partition pruning, and sinks that never overwrite."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tidemark.operators.temporal import Instant, first_overlap

PRICES = (
    "security_id string, trade_date date, open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6), volume bigint, "
    "currency string, source string, ingested_at timestamp, provider_adjusted_close decimal(18,6)"
)
FUNDAMENTALS = (
    "security_id string, statement string, line_item string, period_end date, period_type string, currency string, value decimal(38,6), filed_at timestamp, "
    "available_at timestamp, revised_at timestamp, revision_sequence int, source string, availability_imputed boolean, imputation_rule string"
)
MEMBERSHIP = "universe string, security_id string, valid_from date, valid_to date, recorded_at timestamp, superseded_at timestamp, source string"
MASTER = {
    "entities": "entity_id string, name string, country string", "securities": "security_id string, entity_id string, security_type string, name string",
    "listings": "security_id string, mic string, valid_from date, valid_to date, recorded_at timestamp, superseded_at timestamp",
    "status_periods": "security_id string, status string, valid_from date, valid_to date, recorded_at timestamp, superseded_at timestamp",
    "identifiers": "security_id string, kind string, value string, valid_from date, valid_to date, recorded_at timestamp, superseded_at timestamp",
}


def schema_of(fields: str) -> StructType:
    return StructType.fromDDL(fields)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if lost := set(columns) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(lost)}")


def pinned(df: DataFrame, fields: str) -> DataFrame:
    """The columns of a pinned schema, cast; a missing one is an error, an extra one is dropped."""
    wanted = schema_of(fields)
    require_columns(df, wanted.names)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def stored(spark: SparkSession, root: str, fields: str, partition: str | None = None) -> DataFrame | None:
    """A store as it lies, or None before the first write."""
    wanted = schema_of(fields + (f", {partition} int" if partition else ""))
    try:
        spark.read.parquet(root)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return spark.read.schema(wanted).parquet(root)


def append_once(df: DataFrame, root: str, fields: str, key: Sequence[str], partition: str, of: str, *, deduplicate: bool = True) -> int:
    """Appends the rows whose key isn't stored yet, and returns how many: a second write of the same rows adds nothing.

    Of incoming rows with one key the first by `key` and content stays (deduplicate). Only the partitions that the rows
    touch are read for the anti-join.
    """
    spark = df.sparkSession
    new = pinned(df, fields).withColumn(partition, F.year(of))
    if deduplicate:
        turn = Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_last() for c in schema_of(fields).names])
        new = new.withColumn("_n", F.row_number().over(turn)).where("_n = 1").drop("_n")
    held = stored(spark, root, fields, partition)
    if held is not None:
        years = [r[0] for r in new.select(partition).distinct().collect()]  # one row a year
        there = held.where(F.col(partition).isin(years)).select(*[F.col(c).alias(f"_held_{c}") for c in key]).distinct()
        # a null in the key equals a null: writing such a row again adds nothing either
        new = new.join(there, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_held_{c}")) for c in key]), "left_anti")
    new = new.persist()
    try:
        count = new.count()
        if count:
            new.write.mode("append").partitionBy(partition).parquet(root)
        return count
    finally:
        new.unpersist()


def write_prices(bars: DataFrame, root: str) -> int:
    return append_once(bars, root, PRICES, ["security_id", "trade_date", "source"], "trade_year", "trade_date")


def read_prices(spark: SparkSession, root: str, *, securities: Sequence[str] | None = None, start: date | None = None, end: date | None = None, sources: Sequence[str] | None = None, known: Instant | None = None) -> DataFrame:
    """Bars from start to end, both included, known at an instant. The years of the bounds become predicates of the
    partition column, as a predicate on the date alone prunes nothing."""
    df = spark.read.schema(schema_of(PRICES + ", trade_year int")).parquet(root)
    if start is not None:
        df = df.where((F.col("trade_year") >= start.year) & (F.col("trade_date") >= F.lit(start)))
    if end is not None:
        df = df.where((F.col("trade_year") <= end.year) & (F.col("trade_date") <= F.lit(end)))
    for name, values in (("security_id", securities), ("source", sources)):
        if values is not None:
            df = df.where(F.col(name).isin(list(values)))
    if known is not None:
        df = df.where(F.col("ingested_at") <= F.lit(known))
    return df.drop("trade_year")


def write_fundamentals(records: DataFrame, root: str) -> int:
    """Without deduplication of the incoming rows: a repeated revision is a fault of the input and must show."""
    key = ["security_id", "statement", "line_item", "period_end", "period_type", "revision_sequence"]
    return append_once(records, root, FUNDAMENTALS, key, "period_year", "period_end", deduplicate=False)


def read_fundamentals(spark: SparkSession, root: str, *, securities: Sequence[str] | None = None, items: Sequence[str] | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    df = spark.read.schema(schema_of(FUNDAMENTALS + ", period_year int")).parquet(root)
    if start is not None:
        df = df.where((F.col("period_year") >= start.year) & (F.col("period_end") >= F.lit(start)))
    if end is not None:
        df = df.where((F.col("period_year") <= end.year) & (F.col("period_end") <= F.lit(end)))
    if securities is not None:
        df = df.where(F.col("security_id").isin(list(securities)))
    if items is not None:
        df = df.where(F.col("line_item").isin(list(items)))
    return df.drop("period_year")


def known_line_items(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schema_of(FUNDAMENTALS)).parquet(root).select("line_item").distinct()


def partition_counts(spark: SparkSession, root: str, partition: str, small: int = 10_000) -> DataFrame:
    """Rows by partition, and whether a partition is small."""
    counted = spark.read.parquet(root).groupBy(partition).agg(F.count("*").alias("rows"))
    return counted.withColumn("small", F.col("rows") < small)


def write_universe(records: DataFrame, root: str, registered: Sequence[str], known: DataFrame) -> None:
    """Replaces the membership of the universes in the records, after all checks: names, overlaps, orphans."""
    rows = pinned(records, MEMBERSHIP)
    names = {r[0] for r in rows.select("universe").distinct().collect()}
    if lost := names - set(registered):
        raise ValueError(f"universes that aren't registered: {sorted(lost)}")
    current = rows.where("superseded_at IS NULL")
    if clash := first_overlap(current, ["universe", "security_id"]).limit(1).collect():
        raise ValueError(f"spells overlap: {clash[0].universe} {clash[0].security_id}")
    if orphan := rows.join(known, "security_id", "left_anti").limit(1).collect():
        raise ValueError(f"no such security: {orphan[0].security_id}")
    ordered = rows.orderBy(*[F.col(c).asc_nulls_last() for c in ("universe", "security_id", "valid_from", "valid_to")])
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("universe").parquet(root)


def read_universe(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schema_of(MEMBERSHIP)).parquet(root)


def dataset_version(spark: SparkSession, root: str) -> str:
    """When the newest file of a dataset was written."""
    stamp = spark.read.parquet(root).select(F.max("_metadata.file_modification_time")).first()[0]
    return stamp.isoformat() if stamp else "empty"


def write_master(tables: dict[str, DataFrame], root: str) -> None:
    """The five tables of the security master, each sorted with nulls last."""
    for name, fields in MASTER.items():
        rows = pinned(tables[name], fields)
        rows.orderBy(*[F.col(c).asc_nulls_last() for c in rows.columns]).write.mode("overwrite").parquet(f"{root}/{name}")


def read_master(spark: SparkSession, root: str, views: bool = False) -> dict[str, DataFrame]:
    found = {name: spark.read.schema(schema_of(fields)).parquet(f"{root}/{name}") for name, fields in MASTER.items()}
    if views:
        for name, df in found.items():
            df.createOrReplaceTempView(name)
    return found


def write_new(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """A sink for derived data: an error if it is there already."""
    df.write.mode("errorifexists").partitionBy(*partition).parquet(path)


def write_factor_values(frame: DataFrame, root: str) -> str:
    """Values of one tagged factor at one version, under a path of their own that may not exist yet."""
    require_columns(frame, ["security_id", "status", "value", "factor", "factor_version", "end"])
    tags = frame.select("factor", "factor_version").distinct().limit(2).collect()
    if len(tags) != 1 or tags[0].factor is None:
        raise ValueError("values of exactly one tagged factor are needed")
    path = f"{root}/name={tags[0].factor}/version={tags[0].factor_version}"
    write_new(frame.drop("factor", "factor_version"), path, ["end"])
    return path


def write_run(root: str, run_id: str, meta: dict, tables: dict[str, DataFrame]) -> None:
    """A backtest run: its configuration as JSON and its tables."""
    import json

    spark = next(iter(tables.values())).sparkSession
    write_json(spark, f"{root}/{run_id}/meta", [json.dumps(meta, sort_keys=True, default=str)])
    for name, df in tables.items():
        write_new(df, f"{root}/{run_id}/{name}")


def write_json(spark: SparkSession, path: str, rows: Sequence[str]) -> None:
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("errorifexists").text(path)


def load_actions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Corporate actions of several tables as one, with the columns that a table lacks as nulls."""
    found = None
    for path in paths:
        df = spark.read.parquet(path)
        found = df if found is None else found.unionByName(df, allowMissingColumns=True)
    if found is None:
        raise ValueError("no tables of actions")
    return found


def load_delistings(spark: SparkSession, path: str) -> DataFrame:
    """Ended securities of a table as actions; no actions where there is no table."""
    fields = "security_id string, ex_date date, last_trading_date date, reason string, available_at timestamp, source string"
    held = optional_table(spark, path, fields)
    return held.select("*", F.lit("delisting").alias("action_type"), F.lit(True).alias("available_at_imputed"))


def optional_table(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A table, or an empty one with its schema where there is none."""
    held = stored(spark, path, fields)
    return held if held is not None else spark.createDataFrame([], schema_of(fields))
