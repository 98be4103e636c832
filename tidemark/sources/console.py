"""A SQL console: views over globbed Parquet, with columns from file names, and pivots of factor values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_views(spark: SparkSession, paths: Mapping[str, str], named: Mapping[str, str] | None = None) -> list[str]:
    """Registers a view for each path that exists, schemas of its files merged; named: view to the column that holds the
    name of the folder above the file. Views without data are left out, as a console over a young store must open."""
    made = []
    for view, path in paths.items():
        try:
            df = spark.read.option("mergeSchema", "true").parquet(path)
        except Exception as e:  # noqa: BLE001
            if getattr(e, "getCondition", lambda: None)() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                continue
            raise
        if named and view in named:
            df = df.withColumn(named[view], F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))
        df.createOrReplaceTempView(view)
        made.append(view)
    return made


def run(spark: SparkSession, text: str, limit: int = 100) -> DataFrame:
    r"""The result of a statement, or the columns of a view for \d view; \dt lists the views."""
    words = text.strip().split()
    if words[:1] == ["\\d"] and len(words) == 2:
        return spark.sql(f"DESCRIBE {words[1]}")
    if words == ["\\dt"]:
        return spark.sql("SHOW VIEWS")
    return spark.sql(text).limit(limit)


def factor_panel(values: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row for each (security_id, end) and a column for each factor, of ok values alone. Without names they are found,
    one row a factor."""
    found = names or sorted(r[0] for r in values.select("name").distinct().collect())
    return values.where("status = 'ok'").groupBy("security_id", "end").pivot("name", found).agg(F.max("value"))


def metric_comparison(runs: DataFrame) -> DataFrame:
    """Metrics by row and experiments by column, of each experiment's latest run (experiment, run_id, started_at, metrics)."""
    latest = runs.groupBy("experiment").agg(F.max_by("metrics", F.struct("started_at", "run_id")).alias("metrics"))
    flat = latest.select("experiment", F.explode("metrics").alias("metric", "value"))
    names = sorted(r[0] for r in flat.select("experiment").distinct().collect())
    return flat.groupBy("metric").pivot("experiment", names).agg(F.first("value"))


def mirrored_registry(rows: DataFrame) -> DataFrame:
    """Registry rows (id, payload) flattened: the fields of the JSON payload as columns."""
    fields = "struct<name:string,state:string,hypothesis:string,created_at:string,tags:array<string>>"
    return rows.select("id", F.from_json("payload", fields).alias("p")).select("id", "p.*")
