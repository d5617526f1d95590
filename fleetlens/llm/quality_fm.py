"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions in linear
time. Features of a text: its distinct words, hashed, each with its share of the words (as a square root, scaled to length
one); bins of structure statistics (capitals, marks, digits, repeated lines and words, line and word lengths); and, as
metadata, a bin of the text's length. Labels, lang, source and doc_id are never features.

The model is fitted by AdaGrad on at most SAMPLE labelled texts (a bound of the model, drawn by hash of the text), each
with at most its distinct words; only feature numbers reach the driver. Scores are made inside tasks.

Defined results: null and empty texts have structure features only and get a score; without labelled rows, or with one
class only, every score is the share of ones (0.5 without rows); repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, held_out, ragged, slices, write_shared

#: Labelled texts that a model is fitted on, at most: three quarters of label 1, a quarter of label 0.
SAMPLE = 3000
WORD_SLOTS = 1 << 15
FACTORS = 6
EPOCHS = 12
THRESHOLD = 0.3
BINS = 12
# Order of the structure statistics; each has BINS slots after the word slots.
STATISTICS = ("capital", "mark", "digit", "space", "bar", "bang", "word_length", "distinct", "repeated_line", "line_length", "marked_word", "length")
SLOTS = WORD_SLOTS + BINS * len(STATISTICS)

_KIND = np.zeros((6, 256), np.float64)
_KIND[0, 0x41:0x5B] = 1
_KIND[1, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 1
_KIND[2, 0x30:0x3A] = 1
_KIND[3, [0x20, *range(0x09, 0x0E)]] = 1
_KIND[4, 0x7C] = 1
_KIND[5, 0x21] = 1


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def structure(text: pa.Array, w: Words, distinct: np.ndarray) -> np.ndarray:
    """A bin (0 .. BINS-1) of each statistic for each text."""
    b, offsets = w.bytes, w.offsets
    n = np.maximum(np.diff(offsets), 1)
    shares = [sums_between(_KIND[k][b], offsets) / n for k in range(6)]
    words = np.maximum(w.per_row, 1)
    is_mark = _KIND[1][b[w.end - 1]] if len(w.end) else np.zeros(0)
    marked = np.bincount(w.row, weights=is_mark, minlength=len(n)) / words
    line_breaks = sums_between((b == 0x0A).astype(np.int64), offsets)
    # Lines are spans between line breaks; a line repeats an earlier one of its text if hashes agree.
    first = np.zeros(len(b) + 1, bool)
    first[offsets[:-1]] = True
    first[1:][b == 0x0A] = True
    first[len(b)] = False
    start = np.flatnonzero(first)
    row = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(b)), offsets[row + 1])
    keys = np.stack([row.astype(np.uint64), w.span_hash(start, end)])[:, end - start > 1]
    different = np.unique(keys, axis=1)
    repeated = (np.bincount(keys[0].astype(np.int64), minlength=len(n)) - np.bincount(different[0].astype(np.int64), minlength=len(n))) / (line_breaks + 1)
    log = lambda x: np.log2(x + 1)
    share = lambda x: np.where(x > 0, np.ceil(np.clip(12 + np.log2(np.maximum(x, 1e-9)) * 1.5, 1, BINS - 1)), 0)
    bins = [share(s) for s in shares] + [log(sums_between(1 - _KIND[3][b], offsets) / words) * 2, (distinct / words) * (BINS - 1), share(repeated), log(words / (line_breaks + 1)), marked * (BINS - 1), log(n) * 0.6]
    return np.clip(np.stack(bins, axis=1), 0, BINS - 1).astype(np.int64)


def featurise(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts, one after the other, and how many each has."""
    w = Words(text, "plain")
    n = len(text)
    key = np.sort(w.row * WORD_SLOTS + (w.hash & np.uint64(WORD_SLOTS - 1)).astype(np.int64))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    row, slot = key[at] // WORD_SLOTS, key[at] % WORD_SLOTS
    value = np.sqrt(count / np.maximum(w.per_row, 1)[row])
    per = np.bincount(row, minlength=n)
    bins = structure(text, w, per) + WORD_SLOTS + BINS * np.arange(len(STATISTICS))
    rows = np.concatenate([row, np.repeat(np.arange(n), len(STATISTICS))])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([slot, bins.ravel()])[order], np.concatenate([value, np.full(bins.size, 0.5)])[order], per + len(STATISTICS)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, slot: np.ndarray, value: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid; the pairs' sum by the sum-of-squares identity."""
        ends = np.cumsum(counts)
        starts = ends - counts
        vx = self.factor[slot] * value[:, None]
        pairs = 0.5 * (np.add.reduceat(vx, starts, axis=0) ** 2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.weight[slot] * value, starts) + pairs


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(slot: np.ndarray, value: np.ndarray, counts: np.ndarray, label: np.ndarray, seed: int = 7) -> Machine:
    """AdaGrad over mini-batches, logistic loss, small L2."""
    rng = np.random.default_rng(seed)
    share = float(label.mean()) if len(label) else 0.5
    m = Machine(float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros(SLOTS), rng.normal(0, 0.02, (SLOTS, FACTORS)))
    if not len(label) or not 0 < share < 1:
        return Machine(float(np.log((share + 1e-6) / (1 - share + 1e-6))), m.weight, m.factor * 0)
    ends = np.cumsum(counts)
    starts = ends - counts
    g_bias, g_w, g_v = 1e-6, np.full(SLOTS, 1e-6), np.full((SLOTS, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for part in np.array_split(order, max(1, len(order) // 64)):
            pick = np.concatenate([np.arange(starts[i], ends[i]) for i in part])
            s, x, c = slot[pick], value[pick], counts[part]
            error = sigmoid(m.margin(s, x, c)) - label[part]
            e = np.repeat(error, c)
            vx = m.factor[s] * x[:, None]
            total = np.repeat(np.add.reduceat(vx, np.cumsum(c) - c, axis=0), c, axis=0)
            used, back = np.unique(s, return_inverse=True)
            d_w = np.bincount(back, weights=e * x, minlength=len(used)) / len(part) + 1e-5 * m.weight[used]
            each = (e * x)[:, None] * (total - vx)
            d_v = np.stack([np.bincount(back, weights=each[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1) / len(part) + 1e-5 * m.factor[used]
            g_w[used] += d_w**2
            g_v[used] += d_v**2
            g_bias += error.mean() ** 2
            m.weight[used] -= 0.2 * d_w / np.sqrt(g_w[used])
            m.factor[used] -= 0.05 * d_v / np.sqrt(g_v[used])
            m.bias -= 0.1 * error.mean() / np.sqrt(g_bias)
    return m


def sample_labelled(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int]) -> DataFrame:
    """doc_id, text, y of labelled rows that are not held out: of each label at most so many, the first in the order of a hash.

    The ids drawn are bounded, so they are broadcast and documents are not shuffled.
    """
    known = labels.filter(F.col(column).isin(0, 1)).filter(~held_out()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    order = (F.xxhash64(F.lit(column), "doc_id"), "doc_id")
    parts = [known.filter(F.col("y") == y).orderBy(*order).limit(n) for y, n in most.items()]
    drawn = parts[0]
    for p in parts[1:]:
        drawn = drawn.unionByName(p)
    # An id may stand for many rows: equal ones count once, and of the rest as many stay as ids were asked for.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "h"])
    bounded = [rows.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(column), "doc_id"), "doc_id", "h").limit(n) for y, n in most.items()]
    out = bounded[0]
    for b in bounded[1:]:
        out = out.unionByName(b)
    return write_shared(out.select("doc_id", "text", "y"), f"{column}-sample")


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Machine:
    """A machine fitted on a bounded sample of labelled rows."""

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                slot, value, counts = featurise(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("y").cast(pa.int32()), ragged(slot.astype(np.int32), counts, pa.int32()), ragged(value.astype(np.float32), counts, pa.float32())], names=["doc_id", "y", "slot", "value"])

    rows = sample_labelled(docs, labels, "quality", {1: most * 3 // 4, 0: most // 4}).mapInArrow(each, "doc_id long, y int, slot array<int>, value array<float>").toArrow().sort_by("doc_id")
    counts = np.diff(rows.column("slot").combine_chunks().offsets.to_numpy()) if len(rows) else np.zeros(0, np.int64)
    values = lambda c: rows.column(c).combine_chunks().values.to_numpy() if len(rows) else np.zeros(0)
    return fit(values("slot").astype(np.int64), values("value").astype(np.float64), counts.astype(np.int64), rows.column("y").to_numpy().astype(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    m = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(Machine(m.bias, m.weight.astype(np.float32), m.factor.astype(np.float32)))  # SLOTS rows

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                slot, value, counts = featurise(part.column("text"))
                score = sigmoid(shared.value.margin(slot, value.astype(np.float32), counts).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(each, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
