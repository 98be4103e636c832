from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pytest
from pyarrow import fs

from tidemark.llm import warc

FIELDS = "page_id bigint, url string, html string, record_type string"
ROWS = [
    (1, "http://a/é x", "<p>one</p>", "clash"), (2, None, "<p>one</p>", None), (3, "http://b", "two\r\n\r\nWARC/1.1\r\n", None), (4, "u", None, None),
    (5, "u", "", None), (6, "u", "long é " * 5000, None), (7, "u", "long é " * 5000, None), (None, "u", "only null", None), (None, "u", "<p>one</p>", None), (3, "http://b", "two\r\n\r\nWARC/1.1\r\n", None),
]


def expected(least: int) -> list[tuple]:
    out = []
    for i, _, html, _ in ROWS:
        body = (html or "").encode()
        ids = [j for j, _, h, _ in ROWS if (h or "").encode() == body and j is not None]
        first = max(ids) if ids else None
        again = len(body) >= least and first is not None and i != first
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "chunk"), [(0, 1 << 18), (0, 7), (12, 1000)])
def test_round_trip(spark, least, chunk):
    got = warc.archive_pages(spark.createDataFrame(ROWS, FIELDS), least=least, chunk=chunk).collect()
    assert sorted(map(tuple, got), key=str) == expected(least)


def test_more_partitions_than_cores(spark):
    """Every partition's records are in the archives, however many there are."""
    pages = spark.range(500).selectExpr("id AS page_id", "'u' AS url", "concat('page ', id % 300) AS html").repartition(64)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert warc.archive_pages(pages).count() == 500
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_archives_and_chunk_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    chunks = warc.chunk_rows(warc.decided(spark.createDataFrame(ROWS, FIELDS), "page_id", "url", "html", 0), 100)
    listed = warc.write_archives(chunks, folder)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(tmp_path.glob("*.warc.gz")))
    assert len(re.findall(rb"^WARC/1.1\r\nWARC-Type: (?:response|revisit)\r$", raw, re.M)) == len(ROWS) and raw.endswith(b"\r\n\r\n")
    parts: dict[str, list] = {}
    for r in warc.read_chunks(listed, folder, 100).collect():
        parts.setdefault(r.record_id, []).append(r)
    long = sorted(parts[warc.record_id(7)], key=lambda r: r.chunk_no)
    body = b"".join(bytes(r.data) for r in long)
    assert body == ROWS[6][2].encode() and len(long) == -(-len(body) // 100)
    assert [r.payload_sha1 for r in long] == [hashlib.sha1(body[: 100 * (k + 1)]).hexdigest() for k in range(len(long))]
    assert [r.last for r in long] == [False] * (len(long) - 1) + [True]


def test_plain_archives_are_read_and_damage_is_seen(spark, tmp_path):
    record = warc.head(1, "u", hashlib.sha1(b"x").hexdigest(), 1, None) + b"y\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record)
    with fs.LocalFileSystem().open_input_stream(str(tmp_path / "a.warc")) as stream:
        assert [(n, d, last) for _, n, d, _, _, last in warc.chunks_of(stream, 10)] == [(0, b"y", True)]
    with pytest.raises(Exception, match="differs from its header"):
        warc.read_records(spark.createDataFrame([("a.warc",)], "path string"), f"file://{tmp_path}").collect()


def test_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], FIELDS)).collect() == []
