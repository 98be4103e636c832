"""Streams: bars from ticks under a watermark, and revisions by keyed state. The same plans run on batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REVISIONS = "key string, source_id bigint, value double, kind string, sequence int"


def bars(ticks: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Open, high, low, close and count of value by event_type and window; `late` sets a watermark on a stream."""
    rows = ticks.withWatermark("ts", late) if late else ticks
    turn = F.struct("ts", "event_id")
    found = rows.groupBy("event_type", F.window("ts", width).alias("w")).agg(
        F.min_by("value", turn).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", turn).alias("close"), F.count("*").alias("ticks")
    )
    return found.select("event_type", F.col("w.start").alias("start"), "open", "high", "low", "close", "ticks")


def revisions(observations: DataFrame) -> DataFrame:
    """Classifies a stream of (key, source_id, value) as new, unchanged or revision; a key's state is its last value and
    its number of revisions, so state grows with the keys, not with the stream. Within a batch rows go by source_id."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, sequence = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("source_id")
        out = []
        for source, value in zip(rows["source_id"], rows["value"], strict=True):
            kind = "new" if last is None else "unchanged" if value == last else "revision"
            sequence += kind == "revision"
            last = value
            out.append((key[0], source, value, kind, sequence))
        state.update((float(last), int(sequence)))
        yield pd.DataFrame(out, columns=["key", "source_id", "value", "kind", "sequence"])

    return observations.groupBy("key").applyInPandasWithState(step, REVISIONS, "last double, sequence int", "append", GroupStateTimeout.NoTimeout)
