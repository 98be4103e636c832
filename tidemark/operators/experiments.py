"""The experiment registry: designs, runs, conclusions and comparisons.

A registry is metadata, a few rows a day, so it lies as JSON lines in a folder that Spark reads and appends to; every
change is a new line and the latest line of an id counts.
"""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: The states an experiment may go to from each state.
STEPS = {"designed": {"running", "abandoned"}, "running": {"completed", "abandoned"}, "completed": {"running", "concluded", "abandoned"}, "concluded": set(), "abandoned": set()}
FIELDS = "id string, kind string, at string, payload string"


def content_hash(value: Mapping, fields: Sequence[str] | None = None) -> str:
    """SHA-256 of the JSON of a mapping's fields with sorted keys."""
    own = {k: v for k, v in value.items() if fields is None or k in fields}
    return hashlib.sha256(json.dumps(own, sort_keys=True, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Registry:
    """Experiments and runs under a folder."""

    spark: SparkSession
    root: str

    def _append(self, kind: str, key: str, payload: Mapping) -> None:
        row = [(key, kind, datetime.now(timezone.utc).isoformat(), json.dumps(payload, sort_keys=True, default=str))]
        self.spark.createDataFrame(row, FIELDS).coalesce(1).write.mode("append").json(self.root)

    def rows(self, kind: str) -> DataFrame:
        """The latest line of each id of a kind."""
        try:
            df = self.spark.read.schema(FIELDS).json(self.root)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            df = self.spark.createDataFrame([], FIELDS)
        return df.where(F.col("kind") == kind).groupBy("id").agg(F.max_by("payload", "at").alias("payload"), F.min("at").alias("created_at"))

    def get(self, kind: str, key: str) -> dict:
        found = self.rows(kind).where(F.col("id") == key).collect()
        if not found:
            raise KeyError(f"no {kind} {key}")
        return json.loads(found[0].payload)

    def design(self, key: str, hypothesis: str, config: Mapping, tags: Sequence[str] = (), confirmatory: bool = False) -> dict:
        """Registers an experiment; its configuration is hashed and can't be changed under the same id."""
        made = {"state": "designed", "hypothesis": hypothesis, "config": dict(config), "config_hash": content_hash(config), "tags": sorted(tags), "confirmatory": confirmatory}
        if self.rows("experiment").where(F.col("id") == key).count():
            if self.get("experiment", key)["config_hash"] != made["config_hash"]:
                raise ValueError(f"{key} is registered with another configuration")
            return self.get("experiment", key)
        self._append("experiment", key, made)
        return made

    def move(self, key: str, state: str, **more: object) -> dict:
        held = self.get("experiment", key)
        if state not in STEPS[held["state"]]:
            raise ValueError(f"{key} can't go from {held['state']} to {state}")
        self._append("experiment", key, held := {**held, "state": state, **more})
        return held

    def run(self, key: str, execute: Callable[[dict], Mapping[str, float]], manifest: Mapping[str, str]) -> str:
        """Runs an experiment and records its metrics with the manifest of what it read; a failing run is recorded too."""
        held = self.move(key, "running")
        run_id = f"{key}-{self.rows('run').where(F.col('id').startswith(key + '-')).count() + 1:03d}"
        record = {"experiment": key, "config_hash": held["config_hash"], "manifest": {"python": platform.python_version(), **manifest}}
        try:
            metrics = flattened(execute(held["config"]))
        except Exception as e:
            self._append("run", run_id, {**record, "error": str(e)[:300]})
            self.move(key, "abandoned", note="its run failed")
            raise
        self._append("run", run_id, {**record, "metrics": metrics})
        self.move(key, "completed")
        return run_id

    def rerun_agrees(self, run_id: str, execute: Callable[[dict], Mapping[str, float]], tolerance: float = 0.0) -> bool:
        """Whether running again gives the same metrics."""
        held = self.get("run", run_id)
        again = flattened(execute(self.get("experiment", held["experiment"])["config"]))
        return again.keys() == held["metrics"].keys() and all(abs(again[k] - v) <= tolerance for k, v in held["metrics"].items())

    def conclude(self, key: str, verdict: str, run_id: str, reproduced: bool = False) -> list[str]:
        """Ends an experiment on a run on record; a confirmatory one must have been reproduced. Returns warnings: more
        than five variants of a hypothesis without a test out of sample."""
        run, held = self.get("run", run_id), self.get("experiment", key)
        if run["experiment"] != key or "metrics" not in run:
            raise ValueError(f"{run_id} isn't a finished run of {key}")
        if held["confirmatory"] and not reproduced:
            raise ValueError("a confirmatory experiment must be reproduced first")
        self.move(key, "concluded", verdict=verdict, on_run=run_id)
        row = variants(self.experiments()).where(F.col("hypothesis") == held["hypothesis"]).first()
        return ["more than five variants and none out of sample"] if row.variants > 5 and not row.out_of_sample else []

    def experiments(self) -> DataFrame:
        shape = "struct<state:string,hypothesis:string,config_hash:string,tags:array<string>,confirmatory:boolean,verdict:string>"
        return self.rows("experiment").select("id", "created_at", F.from_json("payload", shape).alias("p")).select("id", "created_at", "p.*").orderBy("created_at", "id")

    def runs(self) -> DataFrame:
        shape = "struct<experiment:string,config_hash:string,metrics:map<string,double>,error:string,manifest:map<string,string>>"
        return self.rows("run").select(F.col("id").alias("run_id"), F.col("created_at").alias("started_at"), F.from_json("payload", shape).alias("p")).select("run_id", "started_at", "p.*")


def flattened(metrics: Mapping, prefix: str = "") -> dict[str, float]:
    """Nested metrics under dotted names; what isn't a number is left out."""
    out: dict[str, float] = {}
    for k, v in metrics.items():
        if isinstance(v, Mapping):
            out |= flattened(v, f"{prefix}{k}.")
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out[f"{prefix}{k}"] = float(v)
    return out


def variants(experiments: DataFrame) -> DataFrame:
    """Experiments of each hypothesis, abandoned ones counted, and whether one was out of sample."""
    return experiments.groupBy("hypothesis").agg(F.count("*").alias("variants"), F.bool_or(F.array_contains("tags", "out_of_sample")).alias("out_of_sample"))


def manifest_difference(a: Mapping[str, str], b: Mapping[str, str]) -> dict[str, tuple[str | None, str | None]]:
    return {k: (a.get(k), b.get(k)) for k in sorted({*a, *b}) if a.get(k) != b.get(k)}


def html_report(title: str, tables: Mapping[str, DataFrame], most: int = 200) -> str:
    """A page with the first `most` rows of result tables; a table that has more says so."""
    import html

    parts = [f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        more = f"<p>Only the first {most} rows are shown.</p>" if len(rows) > most else ""
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if x is None else f'{x:.6g}' if isinstance(x, float) else str(x))}</td>" for x in r) + "</tr>" for r in rows[:most])
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>{more}")
    return "\n".join(parts)
