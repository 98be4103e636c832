"""Operator 9: WARC archives as a chunked record table.

Which record is a response and which one revisits it is decided over ids, digests and lengths alone; then the payloads
are dealt to archives of about a target size, by id and digest, so that the copies of a common page don't meet in one
task. Payloads travel as rows of a record and a chunk number, cut in the JVM, so that no Python worker holds a whole
payload. The writer streams a partition's chunks into one archive, a gzip member for each record; the reader streams
archives back into the chunk table, whose rows carry the length and the SHA-1 of the payload so far, and the last chunk
of a record gives the record's row. Archives lie in the shared folder and are reached by URI. A partition is written
under a name of its own and then moved to its final name, so a task that runs again after a lost executor replaces its
archive with an equal one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, gone_at_exit, scratch

#: Bytes of payload in a chunk row, and of an archive in one read.
CHUNK = 256 << 10
#: Bytes of payload behind an archive, and bytes and chunks that the reader hands on at once.
ARCHIVE_BYTES, AT_ONCE_BYTES, AT_ONCE = 128 << 20, 2 << 20, 500
#: The date of every record: an archive depends on its rows alone.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'page {page_id}'.encode()).hexdigest())}>"


def decided(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(page_id, url, payload, sha1, payload_bytes, refers_to): refers_to is null for responses.

    Only ids, digests and lengths are grouped by digest; payloads are joined with what follows from that by the id and
    the digest together, in as many partitions as archives are wanted.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    total = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    archives = max(1, spark.sparkContext.defaultParallelism, -(-total // ARCHIVE_BYTES))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(html, "UTF-8").alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    rows = rows.withColumn("row_key", F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(":"), "sha1"))
    digests = rows.where(F.col("payload_bytes") >= least).select("page_id", "sha1", "payload_bytes", "row_key")
    firsts = digests.groupBy(F.col("sha1").alias("of_sha1"), F.col("payload_bytes").alias("of_bytes")).agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies")).where("copies > 1")
    again = digests.join(firsts, (F.col("sha1") == F.col("of_sha1")) & (F.col("payload_bytes") == F.col("of_bytes")))
    again = again.where(F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id")))
    refers = again.groupBy(F.col("row_key").alias("again_key")).agg(F.max("response_id").alias("refers_to"))
    return rows.repartition(archives, "row_key").join(refers, F.col("row_key") == F.col("again_key"), "left").select("page_id", "url", "payload", "sha1", "payload_bytes", "refers_to")


def chunk_rows(records: DataFrame, chunk: int) -> DataFrame:
    """A row for each chunk of a response's payload, in order; at least one for each record. Revisits carry no payload."""
    last = F.when(F.col("refers_to").isNotNull() | (F.col("payload_bytes") == 0), 0).otherwise(F.floor((F.col("payload_bytes") - 1) / chunk))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk)))
    return records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last.cast("int")))).select("page_id", "url", "sha1", "payload_bytes", "refers_to", "chunk_no", data.alias("data"))


def head(page_id: int | None, url: str | None, sha1: str, size: int, refers_to: int | None) -> bytes:
    """The WARC header and the HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url) if url else "urn:unknown"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32(sha1)}", f"X-Payload-Length: {size}"]
    lines += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers_to is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes the chunk rows into archives in `folder`, one for each partition, and returns (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        final, temporary = f"{root}/part-{task.partitionId():05d}.warc.gz", f"{root}/.part-{task.partitionId():05d}-{uuid.uuid4().hex}"
        out, packer, records = None, None, 0
        for batch in batches:
            for row in zip(*(batch.column(n) for n in ("page_id", "url", "sha1", "payload_bytes", "refers_to", "chunk_no", "data")), strict=True):
                page_id, url, sha1, size, refers_to, number, data = (x.as_py() for x in row)
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(temporary, compression=None)
                if number == 0:
                    if packer:
                        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    packer, records = zlib.compressobj(1, zlib.DEFLATED, 31), records + 1
                    out.write(packer.compress(head(page_id, url, sha1, size, refers_to)))
                if data:
                    out.write(packer.compress(data))
        if out is not None:
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            out.close()
            if store.get_file_info(final).type != fs.FileType.NotFound:
                store.delete_file(final)
            store.move(temporary, final)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{task.partitionId():05d}.warc.gz"]), pa.array([records], pa.int64())], ["path", "records"])

    # the partition of a task names its archive; its list is written first, so that no later plan merges the partitions
    spark, listed = chunks.sparkSession, scratch(chunks.sparkSession, "archive-list")
    chunks.mapInArrow(run, "path string, records bigint").write.parquet(listed)
    gone_at_exit(spark, listed)
    return spark.read.schema("path string, records bigint").parquet(listed)


class Unpacked:
    """The bytes of a stream of gzip members (or of a plain stream), a bounded part at a time."""

    def __init__(self, stream, chunk: int) -> None:  # noqa: ANN001
        self.stream, self.chunk, self.buffer, self.raw, self.ended = stream, chunk, bytearray(), b"", False
        self.packed: bool | None = None
        self.unpacker = None

    def more(self) -> bool:
        raw = self.raw or self.stream.read(self.chunk)
        if not raw:
            self.ended = True
            return False
        if self.packed is None:
            self.packed = raw[:2] == b"\x1f\x8b"
        if not self.packed:
            self.buffer += raw
            return True
        self.unpacker = self.unpacker or zlib.decompressobj(31)
        self.buffer += self.unpacker.decompress(raw, self.chunk)
        self.raw = self.unpacker.unconsumed_tail or self.unpacker.unused_data
        if self.unpacker.eof:
            self.unpacker = None
        return True

    def take(self, most: int) -> bytes:
        """Up to `most` bytes; empty only at the end."""
        while not self.buffer and self.more():
            pass
        got = bytes(self.buffer[:most])
        del self.buffer[:most]
        return got

    def exactly(self, count: int) -> bytes:
        while len(self.buffer) < count and self.more():
            pass
        return self.take(count) if self.buffer else b""

    def until(self, mark: bytes) -> bytes:
        """The bytes before the next mark, which is skipped; for headers."""
        at = self.buffer.find(mark)
        while at < 0 and self.more():
            at = self.buffer.find(mark)
        if at < 0:
            return b""
        got = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return got


def chunks_of(stream, chunk: int) -> Iterator[tuple]:  # noqa: ANN001
    """(header fields, chunk number, data, payload bytes so far, SHA-1 so far, last) of each record of an archive."""
    source = Unpacked(stream, chunk)
    while True:
        lines = source.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if lines == [""]:
            return
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(fields["content-length"])
        if left and fields.get("content-type", "").startswith("application/http"):
            left -= len(source.until(b"\r\n\r\n")) + 4
        digest, number, size = hashlib.sha1(), 0, 0
        while True:
            data = source.exactly(min(chunk, left)) if left else b""
            if left and not data:
                raise ValueError("an archive ends inside a record")
            left, size = left - len(data), size + len(data)
            digest.update(data)
            yield fields, number, data, size, digest.copy().hexdigest(), not left
            number += 1
            if not left:
                break
        if source.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record has no end")


def _opened(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator:
    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                yield stream


CHUNKS = (
    "record_id string, chunk_no int, data binary, payload_sha1 string, payload_bytes bigint, last boolean, "
    "record_type string, page_id bigint, refers_to bigint, said_digest string, said_bytes bigint"
)


def read_chunks(archives: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table: record_id, chunk_no, data, payload_sha1 and payload_bytes (so far), last, and what the
    record's header says: record_type, page_id, refers_to, said_digest (base32), said_bytes."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        number = lambda x: None if x is None else int(x)

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return made

        for stream in _opened(folder, batches):
            for fields, chunk_no, data, size, sha1, last in chunks_of(stream, chunk):
                said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                header = fields["warc-type"], number(fields.get("x-page-id")), number(fields.get("x-refers-to-page")), said, number(fields.get("x-payload-length"))
                rows.append((fields["warc-record-id"], chunk_no, data, sha1, size, last, *header))
                held += len(data)
                if held >= AT_ONCE_BYTES or len(rows) >= AT_ONCE:
                    yield out()
                    held = 0
        if rows:
            yield out()

    return archives.select("path").mapInArrow(run, CHUNKS)


def read_records(archives: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """One row for each record, from the last rows of the chunk table: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    A response's length and digest are those of the payload as it was read; they must agree with its header. A revisit
    has those of its header, as its payload lies with the response that it refers to.
    """
    ends = read_chunks(archives, folder, chunk).where("last")
    digest = base32_of(F.col("payload_sha1"))
    differs = (F.col("record_type") == "response") & ~((F.col("payload_bytes") == F.col("said_bytes")) & (digest == F.col("said_digest")))
    checked = F.when(differs, F.raise_error(F.concat(F.lit("the payload of "), F.col("record_id"), F.lit(" differs from its header"))).cast("string")).otherwise(F.col("said_digest"))
    return ends.select("page_id", F.col("said_bytes").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


def base32_of(sha1: Column) -> Column:
    """The base32 form of a SHA-1 in hexadecimal digits: eight groups of five digits, each four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    group = lambda g: F.conv(F.substring(sha1, 5 * g + 1, 5), 16, 10).cast("int")
    letter = lambda g, k: F.substring(letters, F.shiftright(group(g), 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*[letter(g, k) for g in range(8) for k in range(4)])


def archive_pages(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, chunk: int = CHUNK, folder: str | None = None
) -> DataFrame:
    """Writes a record for each page into WARC archives, reads them back, and returns read_records() of them.

    Of pages with equal payloads of at least `least` bytes, the one with the largest id is a response and the others
    are revisits that refer to it; smaller payloads are all responses. Null html is an empty payload. A null id is
    below all others; if a payload has only null ids, or the largest id more than once, each of those rows is a
    response. A null url is written as urn:unknown. An empty table gives no archives and no rows; other columns are
    ignored. folder: where the archives go, a URI that all executors reach; by default one in the shared folder.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    own, folder = folder is None, folder or scratch(spark, "warc")
    listed = write_archives(chunk_rows(decided(pages, id_col, url_col, html_col, least), chunk), folder)
    if own:
        gone_at_exit(spark, folder)
    return read_records(listed.repartition(max(1, listed.count()), "path"), folder, chunk)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, list_aggregate(list_transform(range(40), lambda i: lpad(bin(('0x' || substr(sha1(body), i + 1, 1))::INT::BIGINT), 4, '0')), 'string_agg', '') AS bits FROM p),
f AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY bits, payload_bytes) AS response_id,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1
      + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
      + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::BIGINT, 1)), 'string_agg', '') AS payload_digest
  FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN response_id IS NULL OR page_id IS NOT DISTINCT FROM response_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM response_id THEN response_id END AS refers_to
FROM f
"""
