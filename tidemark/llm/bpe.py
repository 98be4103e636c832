"""Operator 8: byte-level BPE by a global shuffle of distinct words.

Texts are dealt to blocks of bounded size. Each block finds its distinct pre-tokens and sends them, packed and without
positions, to the hash bucket of the word; there every distinct word of the corpus is encoded once. The ids return to
the block in the order in which its words left, so only ids travel back; the block, dealt by the same shuffle, walks
its texts again and puts the ids at the words' positions. Decoding joins the ids with the table of token bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, release

#: Bytes of text in a block, and the most buckets of distinct words: beyond, a block has too few words for each.
BLOCK_BYTES = 12 << 20
MOST_BUCKETS = 1 << 14
#: Equal rows of a task that go to one block, and words that a bucket's task remembers with their ids at once.
ALIKE, REMEMBERED = 64, 1 << 21


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("tidemark", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: b for b, i in ranks_of(path).items()}


def blocks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The texts dealt to blocks of about BLOCK_BYTES, and the number of blocks.

    A row holds the texts that one batch of the scan has for a block, compressed together: block, doc_ids, sizes, texts.
    The block follows from the row, the task and how often the task has met an equal row, so that repeated rows spread
    out, and a task that runs again deals the same rows to the same blocks.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    count = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, met, task = zstandard.ZstdCompressor(level=3), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            own = np.empty(len(ids), np.int32)
            for k, value in enumerate(batch.column(2).to_pylist()):
                own[k] = xxhash.xxh3_64_intdigest(struct.pack("<qqq", value, task, met[value] // ALIKE)) % count
                met[value] += 1
            order = np.argsort(own, kind="stable")
            starts = np.flatnonzero(np.diff(own[order], prepend=-1))
            for at in np.split(order, starts[1:]) if len(order) else []:
                raw = texts.take(pa.array(at)).to_pylist()
                sizes = np.fromiter(map(len, raw), "<u4", len(raw)).tobytes()
                columns = [pa.array([own[at[0]]], pa.int32()), pa.array([ids.take(pa.array(at)).to_pylist()], pa.list_(pa.int64())), pa.array([sizes]), pa.array([packer.compress(b"".join(raw))])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "sizes", "texts"])

    return rows.mapInArrow(pack, "block int, doc_ids array<bigint>, sizes binary, texts binary").repartition(count, "block"), count


def split(raw: bytes, sizes: bytes) -> Iterator[bytes]:
    start = 0
    for end in np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)).tolist():
        yield raw[start:end]
        start = end


def texts_of(table: pa.Table) -> Iterator[str]:
    unpacker = zstandard.ZstdDecompressor()
    for sizes, raw in zip(table.column("sizes"), table.column("texts"), strict=True):
        for text in split(unpacker.decompress(raw.as_py()), sizes.as_py()):
            yield text.decode("utf-8", "surrogatepass")


def by_bucket(words: Iterable[str], buckets: int) -> list[list[str]]:
    """Distinct pre-tokens, sorted, in the hash buckets of their bytes."""
    found: list[list[str]] = [[] for _ in range(buckets)]
    for word in sorted(words):
        found[xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % buckets].append(word)
    return found


def word_rows(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """(block, bucket, sizes, words): a block's distinct words of a bucket, packed."""

    def run(table: pa.Table) -> pa.Table:
        block, rows, packer = table.column("block")[0].as_py(), [], zstandard.ZstdCompressor(level=3)
        find, seen = regex.compile(pattern).findall, set()
        for text in texts_of(table):
            seen.update(find(text))
        for bucket, words in enumerate(by_bucket(seen, buckets)):
            if words:
                raw = [w.encode("utf-8", "surrogatepass") for w in words]
                rows.append((block, bucket, np.fromiter(map(len, raw), "<u4", len(raw)).tobytes(), packer.compress(b"".join(raw))))
        del seen
        release()
        names, kinds = ("block", "bucket", "sizes", "words"), (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds, strict=True)], names=list(names))

    return docs.groupBy("block").applyInArrow(run, "block int, bucket int, sizes binary, words binary")


def encoded_rows(words: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """(block, bucket, counts, ids) for word rows; each distinct word is encoded once, in its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = encoding(path, pattern)._encode_single_piece, {}
        packer, unpacker = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            for block, bucket, sizes, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                out = []
                if len(known) > REMEMBERED:
                    known.clear()
                for word in split(unpacker.decompress(raw), sizes):
                    if (ids := known.get(word)) is None:
                        ids = known[word] = np.array(encode(word), "<u4").tobytes()
                    out.append(ids)
                counts = np.fromiter(map(len, out), "<u4", len(out)) >> 2
                columns = [pa.array([block], pa.int32()), pa.array([bucket], pa.int32()), pa.array([packer.compress(counts.tobytes())]), pa.array([packer.compress(b"".join(out))])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "counts", "ids"])

    return words.repartition(buckets, "bucket").mapInArrow(run, "block int, bucket int, counts binary, ids binary")


class Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array) if keep_ids.

    ids are those that the tiktoken library gives for the vocabulary file `path` of ranks and the split `pattern`,
    without special tokens. Decoding takes the bytes of each id from the file's table. A null text is empty and has no
    ids; repeated rows each give a row; a null id stays null. Texts are never cut. An empty table gives no rows, and
    other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    dealt, count = blocks(docs, id_col, text_col)
    buckets = min(count, MOST_BUCKETS)
    ids = encoded_rows(word_rows(dealt, pattern, buckets), path, pattern, buckets)
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * keep_ids

    def run(texts: pa.Table, coded: pa.Table) -> pa.Table:
        find, numbers, places = regex.compile(pattern).findall, Numbers(), []
        for text in texts_of(texts):
            words = find(text)
            places.append(np.fromiter(map(numbers.__getitem__, words), "<u4", len(words)))
        found, unpacker = by_bucket(numbers, buckets), zstandard.ZstdDecompressor()
        pieces: list[bytes] = [b""] * len(numbers)
        for bucket, counts, raw in zip(*(coded.column(c).to_pylist() for c in ("bucket", "counts", "ids")), strict=True):
            sizes = np.frombuffer(unpacker.decompress(counts), "<u4") * 4
            for word, ids in zip(found[bucket], split(unpacker.decompress(raw), sizes.astype("<u4").tobytes()), strict=True):
                pieces[numbers[word]] = ids
        del found, numbers
        table, rows = token_bytes(path), []
        for place in places:
            own = b"".join(map(pieces.__getitem__, place.tolist()))
            ids = np.frombuffer(own, "<u4")
            decoded = hashlib.sha256(b"".join(map(table.__getitem__, ids.tolist()))).hexdigest()
            rows.append((len(ids), hashlib.sha256(own).hexdigest(), decoded) + ((ids.astype(np.int32),) if keep_ids else ()))
        del pieces, places, table
        release()
        doc_ids = [x for row in texts.column("doc_ids").to_pylist() for x in row]
        columns = [doc_ids, *(zip(*rows, strict=True) if rows else [()] * (len(kinds) - 1))]
        return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return dealt.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(run, schema)


def decode_documents(coded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes) from arrays of ids, by the file's table of token bytes; a null array gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            out = [None if x is None else b"".join(map(table.__getitem__, x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, bytes binary")
