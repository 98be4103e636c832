"""Operator 1: n-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets are one node. Tokens are put
into classes by the number of nodes that have them: 0 (one node), 1 (rare), 2 and 3 (frequent), and ordered by class,
then hash. With n tokens, two sets that link differ in at most d = n // 5 tokens of either set, so if a prefix holds
p_c tokens of each class c and the sum of max(0, p_c - k_c + 1) exceeds d, the linked sets share k_c prefix tokens of
some class: rare tokens are indexed alone (k = 1), frequent ones as combinations (k = 2 or 3), and the prefix is
extended until the sum is reached. Frequent classes are split further by hash, so that few combinations arise; the
split depends on a size level, and a set is indexed under its own level and the next, which covers every size that
can link with it. A set with more than d tokens of class 0 links with none and isn't indexed.

Sets that share an index entry are candidates, verified on the whole texts. Only the components of the links are
needed, so the first candidates are a star in each list of sets that share an entry; then, between sets of a list that
lie in different components, an exact bound from parity bitmaps of the sets leaves the pairs that could still link,
and all of these are verified.

Counting is packed: texts are dealt to blocks by node, a block sends its tokens to hash buckets as sorted arrays, and
gets back those of its tokens that another node has too, with their class.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MADE, bounded_batches, discard, release, stored

SHINGLE = 5
#: A link: at least this percentage of the union is shared. The bounds below are worked out for 80.
PERCENT = 80
#: Nodes that have a token of class 2 and of class 3, at least.
FREQUENT, VERY_FREQUENT = 64, 4096
#: Bytes of text behind a block of texts and behind a bucket of the count.
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 16 << 20
#: Members of a list that are held together.
LIST_PART = 4096
#: Pairs that the first pass over unresolved lists tries between two components of a list.
FIRST_TRIES = 8
REMEMBERED = 1 << 17
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words, remembered up to REMEMBERED words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(32))) * MULTIPLIER


def shingles(words: list[bytes], hashes: Hashes) -> np.ndarray:
    """The sorted hashes of the distinct shingles; of the whole sequence if it is shorter than one."""
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    count = len(words) - width + 1
    total = ids[:count] + np.uint64(width)
    for o in range(1, width):
        total = mixed(total) + ids[o : count + o]
    total = mixed(total)
    return np.unique(total ^ (total >> np.uint64(29)))


def words_in(text: bytes) -> list[bytes]:
    """Words of UTF-8 text with A-Z lowered; bytes.lower() and bytes.split() know ASCII alone."""
    return text.lower().split()


def node_of(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def links(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)) or not len(a):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def squeezed(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as the compressed byte planes of their steps."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def expanded(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def block_rows(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, nodes, sizes, texts, doc_ids, counts, of): the rows of (doc_id, text), packed by block.

    nodes, sizes and texts hold the sets of four tokens or more, dealt by node, each once for each task; doc_ids, counts
    and of hold each row's id, number of tokens and node, dealt in turn, so that neither copies nor repeated ids gather.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, packer = Hashes(), set(), zstandard.ZstdCompressor(level=3)
        # each task begins at a place of its own and goes on through all its batches, so that all blocks get as many rows
        turn = TaskContext.get().partitionId() * 0x9E3779B1
        for batch in batches:
            held: dict[int, list[tuple[bytes, bytes]]] = {}
            rows: dict[int, list[tuple[int | None, int, bytes]]] = {}
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                turn += 1
                words = words_in(value.as_buffer().to_pybytes()) if value.is_valid else []
                tokens = shingles(words, hashes)
                node = node_of(tokens)
                rows.setdefault(turn % blocks, []).append((doc_id, len(tokens), node))
                if len(tokens) >= 4 and node not in seen:
                    seen.add(node)
                    held.setdefault(int.from_bytes(node[:8], "little") % blocks, []).append((node, b" ".join(words)))
            for block in held.keys() | rows.keys():
                own, named = held.get(block, []), rows.get(block, [])
                sizes = np.fromiter((len(t) for _, t in own), "<u4", len(own)).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int32()), pa.array([b"".join(n for n, _ in own)]), pa.array([sizes]), pa.array([packer.compress(b"".join(t for _, t in own))]),
                        pa.array([[i for i, _, _ in named]], pa.list_(pa.int64())), pa.array([[n for _, n, _ in named]], pa.list_(pa.int64())), pa.array([b"".join(x for *_, x in named)]),
                    ],
                    ["block", "nodes", "sizes", "texts", "doc_ids", "counts", "of"],
                )

    schema = "block int, nodes binary, sizes binary, texts binary, doc_ids array<bigint>, counts array<bigint>, of binary"
    return docs.mapInArrow(run, schema).repartition(blocks, "block")


def sets_of(table: pa.Table) -> tuple[list[bytes], list[bytes], list[np.ndarray]]:
    """Nodes of a block in order, their texts and their tokens; a node that several tasks sent counts once."""
    texts: dict[bytes, bytes] = {}
    for nodes, sizes, raw in zip(*(table.column(c).to_pylist() for c in ("nodes", "sizes", "texts")), strict=True):
        whole, start = zstandard.decompress(raw), 0
        for k, size in enumerate(np.frombuffer(sizes, "<u4").tolist()):
            texts.setdefault(nodes[16 * k : 16 * k + 16], whole[start : start + size])
            start += size
    nodes, hashes = sorted(texts), Hashes()
    return nodes, [texts[n] for n in nodes], [shingles(texts[n].split(), hashes) for n in nodes]


def token_rows(dealt: DataFrame, bits: int) -> DataFrame:
    """(bucket, block, once, more, counts): a block's tokens of a bucket, those that one of its nodes has and the others."""

    def run(table: pa.Table) -> pa.Table:
        block, rows = table.column("block")[0].as_py(), []
        _, _, sets = sets_of(table)
        tokens, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]) >> np.uint64(32 - bits), return_counts=True)
        edges = np.searchsorted(tokens, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
        for bucket in range(1 << bits):
            own, times = tokens[edges[bucket] : edges[bucket + 1]].astype(np.uint32), counts[edges[bucket] : edges[bucket + 1]]
            if len(own):
                rows.append((bucket, block, squeezed(own[times == 1]), squeezed(own[times > 1]), times[times > 1].astype("<u4").tobytes()))
        del sets, tokens, counts
        release()
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds, strict=True)], names=["bucket", "block", "once", "more", "counts"])

    return dealt.groupBy("block").applyInArrow(run, "bucket int, block int, once binary, more binary, counts binary")


def class_rows(tokens: DataFrame) -> DataFrame:
    """(block, bucket, c1, c2, c3): the tokens of a block that another node has too, by class."""

    def run(table: pa.Table) -> pa.Table:
        values, times, owners = [], [], []
        for k, (once, more, counts) in enumerate(zip(*(table.column(c).to_pylist() for c in ("once", "more", "counts")), strict=True)):
            for own, count in ((expanded(once), None), (expanded(more), np.frombuffer(counts, "<u4"))):
                values.append(own)
                times.append(np.ones(len(own), np.int64) if count is None else count.astype(np.int64))
                owners.append(np.full(len(own), k, np.int32))
        value, count, owner = np.concatenate(values), np.concatenate(times), np.concatenate(owners)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        first = np.flatnonzero(np.diff(value.astype(np.int64), prepend=-1))
        total = np.add.reduceat(count[order], first) if len(first) else np.empty(0, np.int64)
        kind = np.repeat((total > 1).astype(np.int8) + (total >= FREQUENT) + (total >= VERY_FREQUENT), np.diff(np.append(first, len(value))))
        shared = np.flatnonzero(kind)
        shared = shared[np.argsort(owner[shared], kind="stable")]
        cuts, rows = np.searchsorted(owner[shared], np.arange(len(table) + 1)), []
        for k, (bucket, block) in enumerate(zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), strict=True)):
            at = shared[cuts[k] : cuts[k + 1]]
            if len(at):
                rows.append((block, bucket, *(squeezed(value[at[kind[at] == c]]) for c in (1, 2, 3))))
        del values, times, owners, value, count, owner, order, first, total, kind, shared
        release()
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds, strict=True)], names=["block", "bucket", "c1", "c2", "c3"])

    return tokens.groupBy("bucket").applyInArrow(run, "block int, bucket int, c1 binary, c2 binary, c3 binary")


#: The least set size of each size level: the powers of 5/4, rounded up.
LEVELS = [-(-(Fraction(5, 4) ** k).numerator // (Fraction(5, 4) ** k).denominator) for k in range(120)]


def level_of(n: int) -> int:
    return int(np.searchsorted(np.array(LEVELS, object), n, side="right")) - 1


def signatures(tokens: np.ndarray, kinds: np.ndarray) -> set[int]:
    """The index entries of a set, given its tokens' classes; none if it has too many tokens of its own."""
    n = len(tokens)
    need = n // 5 + 1
    if np.count_nonzero(kinds == 0) >= need:
        return set()
    order = np.lexsort((tokens, kinds))
    ordered, found = list(zip(tokens[order].tolist(), kinds[order].tolist(), strict=True)), set()
    for level in (level_of(n), level_of(n) + 1):
        # one part of a frequent class for each 20 tokens of the level's least size: no prefix needs more than the set has
        parts, held, reached = max(1, LEVELS[level] // 20), {}, 0
        for token, kind in ordered:
            own = held.setdefault((kind, token % parts if kind > 1 else 0), [])
            own.append(token)
            reached += len(own) >= max(1, kind)
            if reached >= need:
                break
        for (kind, _), own in held.items():
            if kind == 1:
                found.update(own)
            elif kind > 1:
                found.update(xxhash.xxh3_64_intdigest(np.array((level, *some), np.uint64).tobytes()) for some in itertools.combinations(own, kind))
    return found


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap whose differing bits between two sets never exceed the tokens in which the sets differ."""
    size = 1024
    while size < len(tokens):
        size *= 2
    bits = np.bincount(((tokens * MULTIPLIER) >> np.uint64(40)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


INDEX = "sig bigint, ref bigint, doc_id bigint, node binary, n bigint, bitmap binary, text binary"


def index_rows(dealt: DataFrame, classes: DataFrame, bits: int) -> DataFrame:
    """Three kinds of rows: index entries (sig, ref); for each indexed node ref, node, n, bitmap, text; and for each
    document, without sig and ref, its doc_id, n and node."""

    def run(table: pa.Table, coded: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(7)]

        def add(*rows: tuple) -> None:
            for column, values in zip(columns, zip(*rows, strict=True), strict=True):
                column.extend(values)

        for ids, counts, of in zip(*(table.column(c).to_pylist() for c in ("doc_ids", "counts", "of")), strict=True):
            if ids:
                add(*((None, None, i, of[16 * k : 16 * k + 16], n, None, None) for k, (i, n) in enumerate(zip(ids, counts, strict=True))))
        if len(table) and len(coded):
            block = table.column("block")[0].as_py()
            nodes, texts, sets = sets_of(table)
            known, kinds = [], []
            for bucket, *by_class in zip(*(coded.column(c).to_pylist() for c in ("bucket", "c1", "c2", "c3")), strict=True):
                for kind, raw in enumerate(by_class, 1):
                    own = expanded(raw).astype(np.uint64) | np.uint64(bucket << 32)
                    known.append(own)
                    kinds.append(np.full(len(own), kind, np.int8))
            key, kind = np.concatenate(known), np.concatenate(kinds)
            order = np.argsort(key)
            key, kind = key[order], kind[order]
            for number, (node, text, tokens) in enumerate(zip(nodes, texts, sets, strict=True)):
                short = tokens >> np.uint64(32 - bits)
                at = np.minimum(np.searchsorted(key, short), len(key) - 1)
                entries = signatures(tokens, np.where(key[at] == short, kind[at], 0))
                if entries:
                    ref = block << 32 | number
                    add((None, ref, None, node, len(tokens), parity(tokens), zstandard.compress(text)), *((np.uint64(x).astype(np.int64).item(), ref, *[None] * 5) for x in entries))
            del nodes, texts, sets, known, kinds, key, kind, order
        kinds_out = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        made = pa.table([pa.array(c, k) for c, k in zip(columns, kinds_out, strict=True)], names=["sig", "ref", "doc_id", "node", "n", "bitmap", "text"])
        del columns
        release()
        return made

    return dealt.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(run, INDEX)


def list_rows(entries: DataFrame) -> DataFrame:
    """(list, part, first, refs): the sets that share an entry, in parts; lists of one part are there once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, part, held = None, 0, 0, []
        out: list[tuple] = []

        def end(last: bool) -> None:
            nonlocal held, part
            if part or len(held) > 1:
                name = b"sig" + int(now).to_bytes(8, "little", signed=True) if part or not last else xxhash.xxh3_128_digest(np.array(held, np.int64).tobytes())
                out.append((name, part, first, held))
            held, part = [], part + 1

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["list", "part", "first", "refs"])

        for batch in batches:
            for sig, ref in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sig != now:
                    if held:
                        end(True)
                    now, first, part, held = sig, ref, 0, []
                elif len(held) == LIST_PART:
                    end(False)
                held.append(ref)
            if len(out) > 1000:
                yield batch_of()
        if held:
            end(True)
        if out:
            yield batch_of()

    ordered = entries.select("sig", "ref").repartition("sig").sortWithinPartitions("sig", "ref")
    return ordered.mapInArrow(run, "list binary, part int, first bigint, refs array<bigint>").dropDuplicates(["list", "part"])


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by their whole texts."""
    text = lambda name: nodes.select(F.col("ref").alias(name), F.col("text").alias(f"text_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, own = Hashes(), None, None
        for batch in batches:
            keep = []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, own = a, shingles(zstandard.decompress(one.as_py()).split(), hashes)
                keep.append(links(own, shingles(zstandard.decompress(two.as_py()).split(), hashes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(ref, label): the smallest ref that links reach from each end of an edge, by label spreading with jumps."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("ref")).agg(F.min("b").alias("least")).select("ref", F.least("ref", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("ref", "b"), "b").groupBy(F.col("a").alias("ref")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "ref").select("ref", F.least("label", "near").alias("next"), F.col("label").alias("before"))
        jump = labels.select(F.col("ref").alias("next"), F.col("label").alias("beyond"))
        last = MADE[-1]
        moved = stored(spread.join(jump, "next").select("ref", F.least("next", "beyond").alias("label"), "before"), "labels")
        discard(edges.sparkSession, [last])
        labels = moved.select("ref", "label")
        if moved.where(F.col("label") != F.col("before")).isEmpty():
            return labels


def open_pairs(lists: DataFrame, labels: DataFrame, nodes: DataFrame, most: int | None) -> DataFrame:
    """Pairs of a list's sets in different components that the bitmaps allow to link; the likeliest `most` between two
    components of a list, or all."""
    rows = lists.select("list", "part", F.explode("refs").alias("ref")).join(labels, "ref", "left").withColumn("label", F.coalesce("label", "ref"))
    unsettled = rows.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high"), (F.max("part") + 1).alias("parts")).where("low <> high")
    rows = rows.join(unsettled.select("list", "parts"), "list").join(nodes.select("ref", "n", "bitmap"), "ref")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("list", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "ref", "label", "n", "bitmap")

    def run(table: pa.Table) -> pa.Table:
        same = table.column("i")[0] == table.column("j")[0]
        n, ref, label, part = (table.column(c).to_numpy() for c in ("n", "ref", "label", "part"))
        order = np.lexsort((ref, n))
        n, ref, label, part = n[order], ref[order], label[order], part[order]
        raw = table.column("bitmap").to_pylist()
        maps = [np.frombuffer(raw[k], np.uint64) for k in order]
        folded: dict[int, np.ndarray] = {}

        def at_size(size: int) -> np.ndarray:
            if size not in folded:
                folded[size] = np.stack([np.bitwise_xor.reduce(m.reshape(-1, size), axis=0) if len(m) >= size else np.zeros(size, np.uint64) for m in maps])
            return folded[size]

        a, b, off = [], [], []
        ends = np.searchsorted(n, n * 100 // PERCENT, side="right")
        for k in range(len(n) - 1):
            other = np.arange(k + 1, ends[k])
            other = other[(label[other] != label[k]) & (same | (part[other] != part[k]))]
            if len(other):
                own = at_size(len(maps[k]))
                apart = np.bitwise_count(own[other] ^ own[k]).sum(1, dtype=np.int64)
                fits = 9 * apart <= n[other] + n[k]
                a.append(np.full(int(fits.sum()), k))
                b.append(other[fits])
                off.append(apart[fits])
        one, two, far = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (a, b, off))
        if most is not None and len(one):
            low, high = np.minimum(label[one], label[two]), np.maximum(label[one], label[two])
            by = np.lexsort((far, high, low))
            fresh = np.append(True, (np.diff(low[by]) != 0) | (np.diff(high[by]) != 0))
            rank = np.arange(len(by)) - np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))
            one, two = one[by][rank < most], two[by][rank < most]
        left, right = ref[one], ref[two]
        return pa.table([pa.array(np.minimum(left, right), pa.int64()), pa.array(np.maximum(left, right), pa.int64())], names=["a", "b"])

    return rows.groupBy("list", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id.

    Two documents link if 100 times the shared shingles is at least 80 times all shingles of both. component_id is the
    smallest doc_id that links reach. A text that is null or has no words has no shingles, links with nothing and is
    its own component. Repeated rows each give a row; a null id is larger than any other, so it names a component only
    if that has no other id. An empty table gives no rows, and other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))
    # as many buckets as keep their tokens bounded, but not so many that a block has less than 8 tokens for each: below
    # that the rows of the count are mostly their own overhead
    bits = min(max(4, (size // BUCKET_BYTES).bit_length()), max(4, (size // (64 * blocks)).bit_length()), 24)
    dealt = block_rows(rows, blocks)
    index = stored(index_rows(dealt, class_rows(token_rows(dealt, bits)), bits), "index", waves=4, size=size)
    nodes, entries, of = index.where("sig IS NULL AND ref IS NOT NULL"), index.where("sig IS NOT NULL"), index.where("sig IS NULL AND ref IS NULL")
    lists = stored(list_rows(entries), "lists", size=size // 4)
    stars = lists.select(F.col("first").alias("a"), F.explode("refs").alias("b")).where("a <> b").distinct()
    edges = stored(verified(stars, nodes), "links", size=size // 4)
    labels = components(edges)
    tried = None
    for most in (FIRST_TRIES, None):
        pairs = open_pairs(lists, labels, nodes, most)
        pairs = tried = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "tries", size=size // 16)
        more = stored(verified(pairs, nodes), "links")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            labels = components(edges)
    by_node = of.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = nodes.select("ref", "node").join(labels, "ref").select("node", "label")
    known = by_node.join(named, "node", "left").withColumn("key", F.coalesce(F.col("label").cast("string"), F.hex("node")))
    heads = known.groupBy("key").agg(F.min("least").alias("component_id"))
    found = known.join(heads, "key").select("node", "component_id")
    linked = of.where("n > 0").join(found, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(of.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row, so that only equal rows share a key (but for collisions of the hash)."""
    parts = []
    for field in docs.schema:
        value = F.col(f"`{field.name.replace('`', '``')}`")
        # maps have no hash, and a null leaves the hash as it was
        parts += [value.isNull(), F.to_json(F.struct(value)) if "map<" in field.dataType.simpleString() else value]
    return F.xxhash64(*parts)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns as they were.

    Rows are documents by all of their columns: equal rows count once, and rows that repeat a doc_id with other texts
    are documents of their own. The one with the smallest doc_id stays, one without an id only if all lack it, and of
    equal ids the one with the smallest hash, so reruns agree. A null or empty text links with nothing, so it stays.
    Further columns may have any name; an empty table stays empty.
    """
    name = "row_key"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    keyed = docs.withColumn(name, row_key(docs))
    found = near_duplicates(keyed, id_col=name).select(F.col("doc_id").alias(name), "component_id").distinct()
    ids = keyed.select(name, "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), F.col("doc_id").alias("doc_id"), F.col(name).alias("key")))
    kept = ids.join(found, name).groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias(name))
    return keyed.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
