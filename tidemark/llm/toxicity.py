"""Operator 7: convolutional toxicity classifier in numpy.

A word's embedding is the sum of hashed rows of the word and of its beginnings, so unseen forms of a known stem keep
its meaning. Filters of several widths slide over the embeddings, each filter's largest value over the whole text is
pooled, and a linear layer gives the logit. All of it starts at random and is trained by Adagrad on a bounded sample:
in each epoch half of the words are left out by chance, so that a text can't be learnt by its rarest word, and the
epoch that does best on a fifth of the sample is kept. That fifth also calibrates the thresholds, one for each
language, which is guessed from the letters of the text alone; the score is shifted so that a language's threshold
lies at 0.5.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches
from tidemark.llm.sampling import MOST_BYTES, PER_CLASS, is_held_out, streamed_sample

WORDS = re.compile(r"\w+")
ROW_BITS, SIZE, FILTERS, WIDTHS = 18, 8, 8, (1, 2, 3)
#: Beginnings of a word that have rows of their own, besides the whole word.
STEMS = (4, 5, 6)
EPOCHS, BATCH, RATE, CLEAN_WEIGHT = 6, 32, 0.1, 2.0
#: Part of the words that an epoch leaves out, and the pull of embeddings and of filters towards zero.
LEFT_OUT, ROW_PULL, FILTER_PULL = 0.5, 1e-3, 1e-4
#: Texts of a class that a language needs among the calibration texts for a threshold of its own; else the common one.
LEAST_OF_CLASS = 10
#: Words that are remembered with their rows, and the words and texts that are scored at once. Filters have values for
#: AT_ONCE places at a time, in a longer text too.
REMEMBERED, AT_ONCE, TEXTS_AT_ONCE = 1 << 18, 1 << 17, 512

#: Letters that tell languages apart.
LETTERS = {"de": "äöüß", "fr": "éèêçàùâîôûœ", "es": "ñóíáú"}
SPECIAL = re.compile("[" + "".join(LETTERS.values()) + "]")
OF_LETTER = {c: lang for lang, letters in LETTERS.items() for c in letters}


def language(lowered: str) -> str:
    """A guess from the letters: the language of most special letters, or 'plain' if fewer than one in 200 is special."""
    found = SPECIAL.findall(lowered)
    if len(found) * 200 <= len(lowered):
        return "plain"
    counts = dict.fromkeys(LETTERS, 0)
    for c in found:
        counts[OF_LETTER[c]] += 1
    return max(counts, key=lambda k: (counts[k], k))


def hashes(word: str) -> list[int]:
    """The hashes of a word and of its stems."""
    parts = ["=" + word, *(word[:n] if len(word) > n else f"{n}{word}" for n in STEMS)]
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in parts]


def rows_of(found: list[int]) -> tuple[int, ...]:
    """The rows of hashes; the first row belongs to padding."""
    return tuple(1 + h % ((1 << ROW_BITS) - 1) for h in found)


class Rows(dict):
    """The rows of a word and of its stems."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        self[word] = found = rows_of(hashes(word))
        return found


class Notes(dict):
    """The note of a word: a hash and rows, noted when the word comes up and again if it has been forgotten."""

    def __init__(self) -> None:
        self.hashes, self.rows = array("Q"), array("i")

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = hashes(word)
        self[word] = note = len(self.hashes)
        self.hashes.append(found[0])
        self.rows.extend(rows_of(found))
        return note


@dataclass
class Net:
    rows: np.ndarray
    filters: list[np.ndarray]  # for each width: width x SIZE x FILTERS
    offsets: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0


PADS = [0] * (max(WIDTHS) - 1)


class Texts:
    """Texts as numbers of words, each followed by as many padding words as the widest filter needs.

    Word 0 is padding, or a word left out: its embedding is zero. table holds the rows of each number's word.
    """

    def __init__(self, texts: list[np.ndarray], table: np.ndarray, dense: bool = False) -> None:
        # dense: the texts use most words of the table, so that it is embedded whole
        parts = [np.append(t, PADS) if len(t) else np.array([0, *PADS]) for t in texts]
        lengths = np.array([len(p) for p in parts])
        self.words, self.table, self.dense = np.concatenate(parts).astype(np.int32), table, dense
        self.starts = np.cumsum(lengths) - lengths
        self.ends = self.starts + lengths - len(PADS)
        # where no filter may start: on padding it would reach into the next text
        self.uncounted = (self.ends[:, None] + np.arange(len(PADS))).ravel()

    @classmethod
    def of(cls, texts: list[list[str]], rows: Rows) -> Texts:
        """From lists of words, numbered among themselves."""
        return cls(*numbered(texts, rows), dense=True)


def numbered(texts: list[list[str]], rows: Rows) -> tuple[list[np.ndarray], np.ndarray]:
    """The texts as numbers of their distinct words, from 1, and the table of the words' rows."""
    numbers: dict[str, int] = {}
    found = [np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.int64, len(words)) for words in texts]
    return found, np.array([(0,) * (len(STEMS) + 1), *(rows[w] for w in numbers)], np.int64)


def gathered(sample: Iterable[tuple[str, int]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a sample as numbers of distinct words, the table of the words' rows, the labels and the languages.

    A text is let go once its words are hashed, and no list of its words is made; a number takes four bytes.
    """
    notes, found, labels, langs = Notes(), [], [], []
    for text, y in sample:
        lowered = text.lower()
        found.append(np.fromiter(map(notes.__getitem__, map(re.Match.group, WORDS.finditer(lowered))), np.int32))
        labels.append(y)
        langs.append(language(lowered))
    # a word's notes share its hash; words are numbered from 1 by their first notes
    _, first, same = np.unique(np.array(notes.hashes), return_index=True, return_inverse=True)
    order = np.sort(first)
    number = (np.searchsorted(order, first) + 1).astype(np.int32)[same]
    for i, own in enumerate(found):
        found[i] = number[own]
    table = np.zeros((len(order) + 1, len(STEMS) + 1), np.int32)
    table[1:] = np.array(notes.rows).reshape(-1, len(STEMS) + 1)[order]
    return found, table, np.array(labels, float), np.array(langs)


@dataclass
class Pass:
    """A forward pass: the distinct words, each place's distinct word, their embeddings, for each text the largest value of
    every filter, before the rectifier, and, if asked for, the place of that value by width."""

    distinct: np.ndarray
    place: np.ndarray
    embedded: np.ndarray
    tops: np.ndarray
    won: list[np.ndarray]


def embeddings(net: Net, table: np.ndarray) -> np.ndarray:
    """The sums of the rows of each line of the table, AT_ONCE lines at a time."""
    out = np.empty((len(table), SIZE), net.rows.dtype)
    for low in range(0, len(table), AT_ONCE):
        out[low : low + AT_ONCE] = net.rows[table[low : low + AT_ONCE]].sum(1)
    return out


def pooled(parts: list[np.ndarray], place: np.ndarray, texts: Texts, top: np.ndarray, won: np.ndarray | None) -> None:
    """Puts each text's largest value of every filter of a width into top, and the first place of that value into won.

    parts: each distinct word's share in a value, by its position under the filter. The values of AT_ONCE places exist
    at a time, however long a text is.
    """
    every = np.arange(FILTERS)
    for low in range(0, len(place), AT_ONCE):
        high = min(low + AT_ONCE, len(place))
        total = parts[0][place[low:high]]
        for o in range(1, len(parts)):
            ahead = parts[o][place[low + o : high + o]]
            total[: len(ahead)] += ahead
        begin, end = np.searchsorted(texts.uncounted, (low, high))
        total[texts.uncounted[begin:end] - low] = -np.inf
        first, last = np.searchsorted(texts.starts, low, "right") - 1, np.searchsorted(texts.starts, high)
        if won is None:
            at = np.maximum(texts.starts[first:last], low) - low
            np.maximum(top[first:last], np.maximum.reduceat(total, at, axis=0), out=top[first:last])
            continue
        for k in range(first, last):
            a, b = max(texts.starts[k], low), min(texts.ends[k], high)
            if a < b:
                best = total[a - low : b - low].argmax(0)
                value = total[a - low + best, every]
                if a > texts.starts[k]:  # the text began in an earlier block
                    kept = value <= top[k]
                    best, value = np.where(kept, won[k] - a, best), np.where(kept, top[k], value)
                won[k], top[k] = a + best, value


def forward(net: Net, texts: Texts, places: bool = False) -> Pass:
    if texts.dense:
        distinct, place = np.arange(len(texts.table)), texts.words
    else:
        used = np.zeros(len(texts.table), bool)
        used[texts.words] = True
        distinct, place = np.flatnonzero(used), (np.cumsum(used, dtype=np.int32) - np.int32(1))[texts.words]
    embedded = embeddings(net, texts.table[distinct])
    embedded[distinct == 0] = 0
    tops, won = [], []
    for weights in net.filters:
        parts = [embedded @ w for w in weights]
        tops.append(np.full((len(texts.starts), FILTERS), -np.inf, parts[0].dtype))
        won += [np.zeros((len(texts.starts), FILTERS), np.int64)] if places else []
        pooled(parts, place, texts, tops[-1], won[-1] if places else None)
    return Pass(distinct, place, embedded, np.concatenate(tops, axis=1) + net.offsets, won)


def logits(net: Net, texts: Texts) -> np.ndarray:
    return np.maximum(forward(net, texts).tops, 0) @ net.out + net.bias


def started() -> Net:
    """A network with random embeddings, filters and output weights."""
    chance = np.random.default_rng(3)
    table = chance.normal(0, 0.1, (1 << ROW_BITS, SIZE))
    filters = [chance.normal(0, 0.5 / w**0.5, (w, SIZE, FILTERS)) for w in WIDTHS]
    return Net(table, filters, np.zeros(FILTERS * len(WIDTHS)), chance.normal(0, 0.3, FILTERS * len(WIDTHS)), -1.0)


class Steps:
    """Adagrad on the logistic loss, classes weighted alike; gradients reach only the words that won the pooling."""

    def __init__(self, net: Net, labels: np.ndarray) -> None:
        self.net = net
        self.weight = 0.5 / np.maximum(np.array([np.mean(labels == v) for v in (0, 1)]), 1e-9)
        self.rows, self.bias = np.full_like(net.rows, 1e-2), 1e-2
        self.flat = {name: np.full_like(getattr(net, name), 1e-2) for name in ("out", "offsets")}
        self.filters = [np.full_like(f, 1e-2) for f in net.filters]

    def take(self, batch: Texts, y: np.ndarray) -> None:
        net, seen = self.net, forward(self.net, batch, places=True)
        lifted = np.maximum(seen.tops, 0)
        p = 1 / (1 + np.exp(-np.clip(lifted @ net.out + net.bias, -30, 30)))
        error = (p - y) * self.weight[y.astype(int)] / len(y)
        back = np.outer(error, net.out) * (seen.tops > 0)
        moved = np.zeros_like(seen.embedded)
        for k, (width, weights) in enumerate(zip(WIDTHS, net.filters, strict=True)):
            own, change = back[:, k * FILTERS : (k + 1) * FILTERS], FILTER_PULL * weights
            for o in range(width):
                words = seen.place[np.minimum(seen.won[k] + o, len(seen.place) - 1)]
                change[o] += np.einsum("nfs,nf->sf", seen.embedded[words], own)
                np.add.at(moved, words, own[:, :, None] * weights[o].T[None])
            self.filters[k] += change**2
            weights -= RATE * change / np.sqrt(self.filters[k])
        for name, change in (("out", lifted.T @ error + 1e-4 * net.out), ("offsets", back.sum(0))):
            self.flat[name] += change**2
            getattr(net, name)[...] -= RATE * change / np.sqrt(self.flat[name])
        self.bias += error.sum() ** 2
        net.bias -= RATE * float(error.sum()) / self.bias**0.5
        hit = np.flatnonzero((np.abs(moved).sum(1) > 0) & (seen.distinct > 0))
        if len(hit):
            at, inverse = np.unique(batch.table[seen.distinct[hit]].ravel(), return_inverse=True)
            change = ROW_PULL * net.rows[at]
            np.add.at(change, inverse, np.repeat(moved[hit], len(STEMS) + 1, 0))
            self.rows[at] += change**2
            net.rows[at] -= RATE * change / np.sqrt(self.rows[at])


def in_parts(net: Net, texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    return np.concatenate([logits(net, Texts(texts[k : k + 64], table)) for k in range(0, len(texts), 64)])


def train(texts: list[np.ndarray], table: np.ndarray, labels: np.ndarray, checked: np.ndarray) -> tuple[Net, np.ndarray]:
    """The network of the epoch that tells the checked texts apart best, and their logits; all are checked if none is left out."""
    net, chance = started(), np.random.default_rng(13)
    use = np.flatnonzero(~checked) if checked.any() else np.arange(len(texts))
    held = np.flatnonzero(checked) if checked.any() else use
    steps, best = Steps(net, labels[use]), None
    for _ in range(EPOCHS):
        order = chance.permutation(use)
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            some = [np.where(chance.random(len(texts[i])) < LEFT_OUT, 0, texts[i]) for i in chosen]
            steps.take(Texts(some, table), labels[chosen])
        z = in_parts(net, [texts[i] for i in held], table)
        right = rightness(z, labels[held])[0].max()
        if best is None or right > best[0]:
            best = right, Net(net.rows.astype(np.float32), [f.astype(np.float32) for f in net.filters], net.offsets.copy(), net.out.copy(), net.bias), z
    return best[1], best[2]


def rightness(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much is right with a threshold in each gap of the sorted logits, clean texts weighing CLEAN_WEIGHT times as much; the gaps' middles."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    right = CLEAN_WEIGHT * np.append(0, np.cumsum(y == 0)) / max(1, (y == 0).sum()) + (y == 1).sum() / max(1, (y == 1).sum()) - np.append(0, np.cumsum(y == 1)) / max(1, (y == 1).sum())
    return right, np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap of logits at which most is right."""
    right, middles = rightness(z, y)
    return float(middles[right >= right.max() - 1e-12].mean())


def fit(sample: Iterable[tuple[str, int]]) -> Net | None:
    """The network of a labelled sample, which is read once; None with one class or none."""
    texts, table, labels, langs = gathered(sample)
    if not len(labels) or labels.min() == labels.max():
        return None
    checked = np.arange(len(texts)) % 5 == 4
    if len(np.unique(labels[checked])) < 2 or len(np.unique(labels[~checked])) < 2:
        checked[:] = False
    net, z = train(texts, table, labels, checked)
    held = np.flatnonzero(checked) if checked.any() else np.arange(len(texts))
    y, langs = labels[held], langs[held]
    net.threshold = best_threshold(z, y)
    for lang in np.unique(langs):
        own = langs == lang
        if min((y[own] == 0).sum(), (y[own] == 1).sum()) >= LEAST_OF_CLASS:
            net.thresholds[str(lang)] = best_threshold(z[own], y[own])
    return net


def score_texts(net: Net | None, texts: list[str | None], rows: Rows) -> np.ndarray:
    """A score for each text, from 0 to 1."""
    if net is None:
        return np.full(len(texts), 0.5)
    lowered = [(t or "").lower() for t in texts]
    out, held, size = [], [], 0

    def flush() -> None:
        nonlocal size
        if held:
            out.append(logits(net, Texts.of(held, rows)))
            held.clear()
            size = 0
            if len(rows) > REMEMBERED:
                rows.clear()

    for t in lowered:
        words = WORDS.findall(t)
        held.append(words)
        size += len(words)
        if size >= AT_ONCE or len(held) >= TEXTS_AT_ONCE:
            flush()
    flush()
    z = np.concatenate(out) if out else np.empty(0)
    shift = np.array([net.thresholds.get(language(t), net.threshold) for t in lowered])
    return 1 / (1 + np.exp(-np.clip(z - shift, -30, 30))) if len(z) else z


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    The network is fitted on a sample of at most `per_class` labelled rows of each class, which ends once its texts
    come to `most_bytes`, none of them held out; every text is then scored whole. A null text is scored as an empty
    one; repeated rows each give a row; a null id stays null. Without labels of both classes every score is 0.5. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    net = spark.sparkContext.broadcast(fit(streamed_sample(docs, labels, label, id_col=id_col, text_col=text_col, per_class=per_class, most_bytes=most_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows()
        for batch in batches:
            scores = pa.array(score_texts(net.value, batch.column(2).to_pylist(), rows), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
