"""Operator 5: exact top-k inner products over norm-sorted vectors.

Vectors are turned into integers, packed into blocks sorted by descending length, and rotated by the eigenvectors of
their second moments (the right singular vectors of the whole table), so that the leading rotated components carry most
of a product. The longest vectors give every query a first k-th best score. Then each block of queries meets the blocks
of candidates that could still matter: a block of queries needs vectors of at least the smallest ratio of its floors to
its lengths (Cauchy-Schwarz), and shorter blocks of candidates aren't sent to it. Within a pair of blocks, a query skips
candidates that are too short for it, and partial sums over leading components plus the product of the residual lengths bound the score, and only candidates
whose bound reaches the k-th best get their exact integer score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, stored

#: Vectors in a block of candidates and of queries; the longest vectors that set the first bounds.
CANDIDATES, QUERIES, SEEDS = 8192, 1024, 2048
#: Leading rotated components after which candidates are pruned.
CUTS = (8, 24)
#: Slack for rounding in the rotated sums, as a part of the product of lengths.
SLACK = 1e-9
#: Marks on the scale of lengths that tell which blocks of queries a block of candidates goes to.
MARKS = 1000

PACKED = "block long, longest double, ids binary, vectors binary, width int"
PAIRS = "query_id bigint, vec_id bigint, score bigint"


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, x, norm) with integer components; vectors null, empty or with null or non-finite components fall out."""
    x = F.transform(vector_col, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    fine = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    sound = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    rows = sound.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))


def moments(rows: DataFrame, width: int) -> np.ndarray:
    """The second moments of all rows, added up per batch and then over the batches; width x width whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["part", "m"])

    parts = rows.where(F.size("x") == width).select("x").mapInArrow(run, "part int, m array<double>")
    sums = parts.select(F.posexplode("m").alias("cell", "v")).groupBy("cell").agg(F.sum("v").alias("v"))
    total = np.zeros(width * width)
    for cell, v in sums.collect():
        total[cell] = v
    return total.reshape(width, width)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows of one width in blocks of at most `size`, each partition's vectors by descending length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, norms = [], [], []
        held = 0

        def out() -> pa.RecordBatch:
            i, n = np.concatenate(ids), np.concatenate(norms)
            x = np.concatenate(xs)
            order = np.lexsort((i, -n))
            first = int(i[order[0]])
            columns = [pa.array([first], pa.int64()), pa.array([float(n.max())]), pa.array([i[order].astype("<i8").tobytes()]), pa.array([x[order].astype("<i4" if np.abs(x).max(initial=0) < 1 << 31 else "<i8").tobytes()]), pa.array([x.shape[1]], pa.int32())]
            for part in (ids, xs, norms):
                part.clear()
            return pa.RecordBatch.from_arrays(columns, ["block", "longest", "ids", "vectors", "width"])

        for batch in batches:
            n = batch.num_rows
            for start in range(0, n, size):
                part = batch.slice(start, min(size, n - start))
                if held + part.num_rows > size and held:
                    yield out()
                    held = 0
                column = part.column(1)
                width = len(column[0])
                ids.append(part.column(0).to_numpy())
                xs.append(column.flatten().to_numpy().reshape(-1, width))
                norms.append(part.column(2).to_numpy())
                held += part.num_rows
        if held:
            yield out()

    return rows.select("vec_id", "x", "norm").mapInArrow(run, PACKED)


def unpack(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(vectors, "<i4" if len(vectors) == 4 * len(i) * width else "<i8").reshape(-1, width).astype(np.int64)


def kept(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, then smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def best_of(q_ids, q, floors, c_ids, c, longest, basis, k) -> list[tuple[int, np.ndarray, np.ndarray]]:  # noqa: ANN001
    """(query id, candidate ids, scores) of up to k candidates that reach the query's floor; own row excluded."""
    exact_in_float = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2.0**53
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    q_norm, c_norm = np.sqrt((qf**2).sum(1)), np.sqrt((cf**2).sum(1))
    qr, cr = qf @ basis, cf @ basis
    rest = lambda r, cut: np.sqrt(np.maximum((r[:, cut:] ** 2).sum(1), 0))
    cuts = [x for x in CUTS if x < q.shape[1]]
    c_rest, out = {cut: rest(cr, cut) for cut in cuts}, []
    q_rest = {cut: rest(qr, cut) for cut in cuts}
    for j in np.flatnonzero(q_norm * longest * (1 + SLACK) >= floors):
        slack = SLACK * q_norm[j] * longest
        # lengths descend, so the candidates whose length can reach the floor are a prefix
        reach = len(c_norm) if floors[j] <= 0 else int(np.searchsorted(-c_norm * q_norm[j], -(floors[j] - slack), side="right"))
        alive, partial, start = np.arange(reach), np.zeros(reach), 0
        for cut in cuts:
            if not len(alive):
                break
            whole = len(alive) == reach
            partial = partial + (cr[:reach, start:cut] if whole else cr[alive, start:cut]) @ qr[j, start:cut]
            good = partial + c_rest[cut][alive] * q_rest[cut][j] + slack >= floors[j]
            alive, partial, start = alive[good], partial[good], cut
        alive = alive[c_ids[alive] != q_ids[j]]
        if len(alive):
            scores = np.rint(cf[alive] @ qf[j]).astype(np.int64) if exact_in_float else c[alive] @ q[j]
            alive, scores = alive[scores >= floors[j]], scores[scores >= floors[j]]
            top = kept(scores, c_ids[alive], k)
            out.append((int(q_ids[j]), c_ids[alive][top], scores[top]))
    return out


def as_batch(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q = np.concatenate([np.full(len(i), a, np.int64) for a, i, _ in found] or [np.empty(0, np.int64)])
    i = np.concatenate([i for _, i, _ in found] or [np.empty(0, np.int64)])
    s = np.concatenate([s for *_, s in found] or [np.empty(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])


def top_products(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """One row for each query and rank: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those with the query's own id.
    Score: the inner product of the integer vectors floor(scale * x); ties go to the smaller id. Vectors that are null
    or empty, hold null or non-finite components, or have a null id take no part. Vectors of different widths don't
    meet. Repeated rows are candidates each, and a repeated query id is one query. An empty table gives no rows. Further
    columns are ignored. Scores must fit 64 bits: beyond that, products of huge finite components wrap around.

    The result is exact whatever the lengths. On vectors of nearly equal lengths without leading directions, as in the
    given tables, the bounds prune next to nothing, and the work is that of comparing every query with every row.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = stored(scaled(vectors, id_col, vector_col, scale), "scaled-vectors", waves=4)
    widths = [w for (w,) in rows.select(F.size("x")).distinct().collect()]
    results = [_of_width(rows.where(F.size("x") == w), w, k, every) for w in sorted(widths)]
    if not results:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pairs = results[0]
    for more in results[1:]:
        pairs = pairs.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _of_width(rows: DataFrame, width: int, k: int, every: int) -> DataFrame:
    basis = np.linalg.eigh(moments(rows, width))[1][:, ::-1].copy()
    # queries of one id count once; the longest vectors stand in for the whole table's top when floors are set
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    queries = stored(packed(asked, QUERIES), "query-blocks")
    seeds = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS)
    seed_block = packed(seeds.repartition(1), SEEDS).first()

    def with_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_ids, c = unpack(seed_block["ids"], seed_block["vectors"], width)
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = unpack(row["ids"], row["vectors"], width)
                floors = np.full(len(q_ids), -np.inf)
                place = {int(i): n for n, i in enumerate(q_ids)}
                for a, _, scores in best_of(q_ids, q, floors, c_ids, c, seed_block["longest"], basis, k):
                    if len(scores) >= k:
                        floors[place[a]] = scores[k - 1]
                lengths = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                needed = np.where(floors <= 0, 0.0, floors / np.maximum(lengths, 1e-300)).min(initial=np.inf) * (1 - SLACK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]], pa.int64()), pa.array([row["ids"]]), pa.array([row["vectors"]]), pa.array([floors.astype("<f8").tobytes()]), pa.array([float(max(needed, 0.0))])],
                    ["q_block", "q_ids", "q_vectors", "floors", "needed"],
                )

    asked_blocks = stored(queries.mapInArrow(with_floors, "q_block long, q_ids binary, q_vectors binary, floors binary, needed double"), "query-floors", waves=4)
    sorted_rows = rows.repartitionByRange(F.desc("norm"), "vec_id")
    blocks = packed(sorted_rows.sortWithinPartitions(F.desc("norm"), "vec_id"), CANDIDATES)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                q_ids, q = unpack(row["q_ids"], row["q_vectors"], width)
                c_ids, c = unpack(row["ids"], row["vectors"], width)
                found = best_of(q_ids, q, np.frombuffer(row["floors"], "<f8"), c_ids, c, row["longest"], basis, k)
                if found:
                    yield as_batch(found)

    # a row for each pair of blocks that can matter. Blocks of queries are numbered by the length that they need, so those
    # that a block of candidates goes to are the first few; how many is read off MARKS of the lengths, rounded up
    slot = asked_blocks.select("q_block", (F.row_number().over(Window.orderBy("needed", "q_block")) - 1).alias("slot"), "needed")
    numbered = stored(asked_blocks.drop("needed").join(slot, "q_block"), "query-slots", waves=4)
    steps = slot.withColumn("mark", F.ntile(MARKS).over(Window.orderBy("slot"))).groupBy("mark").agg(F.min("needed").alias("least"), (F.max("slot") + 1).alias("upto"))
    marks = [(least, upto) for _, least, upto in sorted(steps.collect())]
    upto = F.lit(0)
    for least, count in _thinned(marks):
        upto = F.when(F.col("longest") * (1 + SLACK) >= least, F.lit(count)).otherwise(upto)
    dealt = blocks.withColumn("upto", upto).where("upto > 0").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("upto") - 1)))
    return dealt.join(numbered.drop("needed"), "slot").repartition("slot", "block").mapInArrow(meet, PAIRS)


def _thinned(marks: list[tuple[float, int]], most: int = 50) -> list[tuple[float, int]]:
    """At most `most` steps: each joins some neighbours, with the least length and the largest count of them."""
    width = -(-len(marks) // most) or 1
    return [(marks[k][0], marks[min(k + width, len(marks)) - 1][1]) for k in range(0, len(marks), width)]


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 20
"""
