"""Operator 2: quality classifier by Naive Bayes support vectors.

A text's features are indicators of hashed n-grams of three kinds: words (one and two), character classes (one to
four) and repetition patterns of four words in a row. Each indicator is scaled by the log-count ratio of the classes,
and a linear hinge-loss model is fitted to the scaled indicators by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches
from tidemark.llm.sampling import MOST_BYTES, PER_CLASS, is_held_out, labelled_sample

#: Hashed features of words, then of character classes, then of repetition patterns.
WORD_BITS, CLASS_BITS = 18, 16
PATTERNS = 64
N_FEATURES = (1 << WORD_BITS) + 4 * (1 << CLASS_BITS) + PATTERNS
SMOOTHING, COST, PASSES = 1.0, 0.1, 12
#: The fitted weights are pulled towards their mean size by this part (0: Naive Bayes, 1: support vectors).
BLEND = 0.5
#: Words of a batch that are remembered with their hashes.
REMEMBERED = 1 << 19


def _classes() -> np.ndarray:
    """A class for each code below 0x3000: 0 white space, 1 small, 2 capital, 3 digit, 4 other letter, else the sign itself."""
    found = np.full(0x3000, 5, np.uint8)
    for code in range(0x3000):
        c = chr(code)
        if c.isspace():
            found[code] = 0
        elif c.isalpha():
            found[code] = 1 if c.islower() else 2 if c.isupper() else 4
        elif c.isdigit():
            found[code] = 3
        elif code < 128:
            found[code] = 6 + code % 58
    return found


CLASSES = _classes()


class Hashes(dict):
    """64-bit hashes of words, remembered up to REMEMBERED words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def features(text: str, hashes: Hashes) -> np.ndarray:
    """The distinct features of a whole text, sorted."""
    raw = text.lower().encode("utf-8", "surrogatepass").split()
    words = np.fromiter(map(hashes.__getitem__, raw), np.uint64, len(raw))
    parts = [words >> np.uint64(64 - WORD_BITS)]
    if len(words) > 1:
        parts.append((words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - WORD_BITS))
    offset = 1 << WORD_BITS
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.where(codes < 0x3000, CLASSES[np.minimum(codes, 0x2FFF)], 4).astype(np.uint32)
    gram = kinds
    for n in range(1, 5):
        if n > 1:
            if len(kinds) < n:
                break
            gram = gram[:-1] * np.uint32(64) + kinds[n - 1 :]
        seen = gram if n < 3 else (gram * np.uint32(2654435761)) >> np.uint32(32 - CLASS_BITS)
        present = np.zeros(1 << CLASS_BITS, bool)
        present[seen] = True
        parts.append(np.flatnonzero(present).astype(np.uint64) + np.uint64(offset + (n - 1) * (1 << CLASS_BITS)))
    if len(words) > 3:
        a, b, c, d = words[:-3], words[1:-2], words[2:-1], words[3:]
        code = sum(((x == y).astype(np.uint64) << np.uint64(k) for k, (x, y) in enumerate(((a, b), (a, c), (a, d), (b, c), (b, d), (c, d)))), np.uint64(0))
        parts.append(code + np.uint64(N_FEATURES - PATTERNS))
    return np.unique(np.concatenate(parts)).astype(np.int64)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = bias + the weights of a text's features."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        z = self.slope * (self.bias + float(self.weights[found].sum())) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int) -> tuple[np.ndarray, float]:
    """Hinge-loss weights over scaled indicators, and a bias, by dual coordinate descent."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] for r in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    turns = np.random.default_rng(7)
    for _ in range(passes):
        for i in turns.permutation(len(rows)):
            gradient = y[i] * (values[i] @ w[rows[i]] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton steps with a weak pull to (1, 0)."""
    size = max(1e-9, float(np.abs(margins).mean()))
    x, t = margins / size, (labels * 0.98 + 0.01)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 0.1 * (a - 1), (p - t).sum() + 0.1 * b])
        h = p * (1 - p)
        hessian = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hessian, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3) / size, b


def fit(sample: list[tuple[str, int]]) -> Model:
    """The model of a labelled sample. With one class or none: 0.5 for every text."""
    labels = np.array([y for _, y in sample], float)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(N_FEATURES), 0.0, 1.0, 0.0)
    hashes = Hashes()
    rows = [features(t, hashes) for t, _ in sample]
    checked = np.arange(len(rows)) % 5 == 4

    def solve(use: np.ndarray) -> tuple[np.ndarray, float]:
        counts = [np.full(N_FEATURES, SMOOTHING), np.full(N_FEATURES, SMOOTHING)]
        for i in np.flatnonzero(use):
            counts[int(labels[i])][rows[i]] += 1
        seen = counts[0] + counts[1] > 2 * SMOOTHING + 1
        ratio = np.where(seen, np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()), 0.0)
        share = np.array([np.mean(labels[use] == v) for v in (0, 1)])
        cost = COST * 0.5 / np.maximum(share[labels[use].astype(int)], 1e-9)
        w, bias = descend([rows[i] for i in np.flatnonzero(use)], ratio, labels[use] * 2 - 1, cost, PASSES)
        used = w != 0
        mean = np.abs(w[used]).mean() if used.any() else 0.0
        return ratio * ((1 - BLEND) * mean * used + BLEND * w), bias * BLEND

    if len(np.unique(labels[checked])) == 2 and len(np.unique(labels[~checked])) == 2:
        weights, bias = solve(~checked)
        margins = np.array([bias + weights[rows[i]].sum() for i in np.flatnonzero(checked)])
        slope, shift = calibrated(margins, labels[checked])
    else:
        weights, bias = solve(np.ones(len(rows), bool))
        slope, shift = calibrated(np.array([bias + weights[r].sum() for r in rows]), labels)
    return Model(weights.astype(np.float32), bias, slope, shift)


def score_quality(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    The model is fitted on a sample of at most `per_class` labelled rows of each class, which ends once its texts come
    to `most_bytes`, none of them held out; every text is then scored whole. A null text is scored as an empty one;
    repeated rows each give a row; a null id stays null and is held out as the empty text is. Without labels of both
    classes every score is 0.5. An empty table gives no rows and other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(fit(labelled_sample(docs, labels, label, id_col=id_col, text_col=text_col, per_class=per_class, most_bytes=most_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = model.value, Hashes()
        for batch in batches:
            scores = pa.array([own.score(features(t.as_py() or "", hashes)) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
