from __future__ import annotations

from datetime import datetime

from tidemark.streaming import ticks

ROWS = [(1, "a", datetime(2021, 1, 1, 9, 10), 5.0), (2, "a", datetime(2021, 1, 1, 9, 50), 3.0), (3, "a", datetime(2021, 1, 1, 9, 50), 4.0), (4, "b", datetime(2021, 1, 1, 10, 0), 1.0)]
FIELDS = "event_id bigint, event_type string, ts timestamp, value double"


def drained(spark, df, name, mode):
    running = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        running.awaitTermination(120)
    finally:
        running.stop()
    return spark.table(name)


def test_stream_of_bars_equals_the_batch(spark, tmp_path):
    spark.createDataFrame(ROWS, FIELDS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in"))
    got = drained(spark, ticks.bars(stream, late="10 minutes"), "bars", "complete")
    want = ticks.bars(spark.createDataFrame(ROWS, FIELDS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert ("a", datetime(2021, 1, 1, 9), 5.0, 5.0, 3.0, 4.0, 3) in set(map(tuple, got.collect()))


def test_revisions_keep_state_between_batches(spark, tmp_path):
    fields = "key string, source_id bigint, value double"
    for k, rows in enumerate([[("x", 1, 1.0), ("x", 2, 1.0)], [("x", 3, 2.0), ("y", 4, 5.0)], [("x", 5, 2.0), ("x", 6, 1.0)]]):
        spark.createDataFrame(rows, fields).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = drained(spark, ticks.revisions(stream), "revised", "append")
    assert sorted((r.source_id, r.kind, r.sequence) for r in got.collect()) == [(1, "new", 0), (2, "unchanged", 0), (3, "revision", 1), (4, "new", 0), (5, "unchanged", 1), (6, "revision", 2)]
