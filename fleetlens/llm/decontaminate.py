"""Benchmark decontamination by spaced-seed hashing.

A mask names the positions of a window that count; the others may hold any word. Every window of every benchmark item is
hashed under each mask, and so is every window of every document. Windows whose hashes meet are hits; around a hit the item
is laid along the document at the hit's offset. A document is contaminated if any segment has MIN_MATCHED equal words (or
all but a tenth of a shorter item) and a share of MIN_SHARE of equal words. The segment that is reported is the best by +1
for an equal word and -2 for another if it meets both limits, else the one with most equal words of those with the share.
Words are lower-cased runs of letters and digits, so marks between words do not hide a passage. An item with fewer words
than the contiguous mask has no window; it is looked for whole, by a mask of its own length.

Recall: a passage is found if one window of a mask falls on equal words. Of 300 passages of 30 words with 5, 10, 15 and 18
in a hundred words substituted, all were found.

Documents look their hashes up in the benchmark's sorted hashes before anything is shuffled, as long as these are at most
BROADCAST_HASHES (8 bytes each); beyond that the same hashes are joined by a shuffle. Either way hits are then joined with
the windows and the items, which go to all tasks up to BROADCAST_ROWS rows. A passage that many items share is tried at each
of them: the work is documents that hold it times items that hold it, spread over tasks by document.

Defined results: null and empty texts on either side have no words and no hits; items of one to six words are found whole
only; repeated rows, rows with one doc_id, and rows with a null doc_id give one result for the id in `contaminated`;
`remove_contaminated` goes by rows: a row goes if its own text is contaminated, whatever its id; an empty table gives no
hits; all columns pass through `remove_contaminated`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, packed, ragged, signed, slices, write_shared

#: 1: the word at this place counts. Weight 7 of 11, and a contiguous one for passages that are cut short.
MASKS = ("11101001011", "11011000111", "10110110101", "1111111")
MIN_MATCHED = 12
MIN_SHARE = 0.8
MISMATCH = 2
BROADCAST_HASHES = 1 << 22
#: Rows of the benchmark's windows or items, or keys of contaminated texts, that are sent to all tasks, at most.
BROADCAST_ROWS = 1 << 20
#: Words of the shortest item that has a window; shorter ones have a mask each.
SHORT = min(map(len, MASKS))
#: A match of fewer words is everyday language: it is reported, but `remove_contaminated` leaves the document.
LEAST_REMOVED = 3


def window_hashes(w: Words, mask: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window under a mask, and the window's hash; k: the mask's number."""
    span, h = len(mask), w.hash
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.row[: len(h) - span + 1] == w.row[span - 1 :])
    total = np.zeros(len(at), np.uint64)
    for j in (j for j, c in enumerate(mask) if c == "1"):
        total = (total + h[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return at, mix(total, k)


def all_hashes(w: Words, short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in its row, hash and span of every window under MASKS and under the masks of items of `short` words."""
    masks = [*enumerate(MASKS), *((100 + n, "1" * n) for n in short)]
    found = [window_hashes(w, mask, k) for k, mask in masks]
    at, key = (np.concatenate(x) for x in zip(*found))
    first = np.cumsum(w.per_row) - w.per_row
    return w.row[at], at - first[w.row[at]], key, np.repeat([len(m) for _, m in masks], [len(a) for a, _ in found])


def benchmark_index(bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, item_id, item_pos) of every window; (item_id, item_words) of every item. Both written."""

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), "plain")
                rows, pos, key, span = all_hashes(w, list(range(1, SHORT)))
                use = (span >= SHORT) | (w.per_row[rows] == span)
                rows, pos, key = rows[use], pos[use], key[use]
                order = np.argsort(rows, kind="stable")
                counts = np.bincount(rows, minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").cast(pa.int64()), ragged(signed(w.hash), w.per_row, pa.int64()), ragged(pos[order].astype(np.int32), counts, pa.int32()), ragged(signed(key[order]), counts, pa.int64())],
                    names=["item_id", "item_words", "pos", "key"],
                )

    items = bench.select("item_id", "text").mapInArrow(each, "item_id long, item_words array<long>, pos array<int>, key array<long>").filter("size(key) > 0")
    items = write_shared(items, "benchmark-items")
    index = items.select("item_id", F.explode(F.arrays_zip("pos", "key")).alias("w")).select(F.col("w.key").alias("key"), "item_id", F.col("w.pos").alias("item_pos")).distinct()
    return write_shared(index, "benchmark-windows"), items.select("item_id", "item_words").distinct()


def text_keys() -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2")]


HITS = "doc_id long, t1 long, t2 long, words array<long>, pos array<int>, key array<long>"


def hit_rows(docs: DataFrame, known: np.ndarray | None, short: list[int]) -> DataFrame:
    """doc_id, t1, t2, the text's word hashes, and the place and hash of its windows (those in known, if it is given); no row without one."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def each(batches):
        table = shared.value
        if table is not None:
            seen = np.zeros(1 << 24, bool)
            seen[(table & np.uint64((1 << 24) - 1)).astype(np.int64)] = True
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), "plain")
                rows, pos, key, _ = all_hashes(w, short)
                if table is not None:
                    some = np.flatnonzero(seen[(key & np.uint64((1 << 24) - 1)).astype(np.int64)])
                    some = some[table[np.minimum(np.searchsorted(table, key[some]), len(table) - 1)] == key[some]] if len(table) else some[:0]
                    rows, pos, key = rows[some], pos[some], key[some]
                if not len(rows):
                    continue
                order = np.argsort(rows, kind="stable")
                counts = np.bincount(rows, minlength=len(part))
                hit = np.flatnonzero(counts)
                took = lambda c: part.column(c).cast(pa.int64()).take(pa.array(hit))  # noqa: E731, B023
                words = ragged(signed(w.hash), w.per_row, pa.int64()).take(pa.array(hit))
                yield pa.RecordBatch.from_arrays(
                    [took("doc_id"), took("t1"), took("t2"), words, ragged(pos[order].astype(np.int32), counts[hit], pa.int32()), ragged(signed(key[order]), counts[hit], pa.int64())],
                    names=["doc_id", "t1", "t2", "words", "pos", "key"],
                )

    return docs.select("doc_id", "text", *text_keys()).mapInArrow(each, HITS)


def best_segment(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and equal words of the best segment of an alignment (+1 for an equal word, -MISMATCH for another)."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
    gain = score - np.minimum.accumulate(score)
    end = int(gain.argmax())
    start = int(score[: end + 1].argmin())
    return start, end, int(same[start:end].sum())


def widest_segment(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and equal words of the segment with most equal words among those with a share of MIN_SHARE."""
    share = round(100 * MIN_SHARE)
    score = np.concatenate([[0], np.cumsum(np.where(same, 100 - share, -share))])  # a segment has the share if its sum is not negative
    high = np.maximum.accumulate(score[::-1])[::-1]  # the highest score from each place on, falling
    end = np.searchsorted(-high, -score, "right") - 1  # the last place with no lower score
    equal = np.concatenate([[0], np.cumsum(same)])
    start = int((equal[end] - equal).argmax())
    at = np.flatnonzero(same[start : end[start]]) + start
    return (int(at[0]), int(at[-1]) + 1, len(at)) if len(at) else (0, 0, 0)


def aligned(batches):
    for batch in batches:
        out = []
        words, items = batch.column("words"), batch.column("item_words")
        given = (batch.column(c).to_pylist() for c in ("doc_id", "t1", "t2", "item_id", "shift"))
        for i, (doc, t1, t2, item, shift) in enumerate(zip(*given)):
            d, b = words[i].values.to_numpy(), items[i].values.to_numpy()
            low, high = max(0, -shift), min(len(b), len(d) - shift)
            same = d[low + shift : high + shift] == b[low:high]
            least = min(MIN_MATCHED, np.ceil(0.9 * len(b)))
            start, end, equal = best_segment(same)
            if equal < least or equal < MIN_SHARE * (end - start):
                start, end, equal = widest_segment(same)
            if equal >= least:
                out.append((doc, t1, t2, item, equal, end - start, len(b), low + shift + start))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=FOUND.replace(" long", "").split(", "))


FOUND = "doc_id long, t1 long, t2 long, item_id long, matched long, aligned long, item_words long, first_word long"


def small(df: DataFrame) -> DataFrame:
    """A written table, sent to all tasks if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def passages(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """FOUND: every place where a row holds an item's passage; t1, t2 stand for the row's text."""
    index, items = benchmark_index(bench)
    known = None
    if index.count() <= BROADCAST_HASHES:
        known = np.unique(index.select("key").distinct().toPandas()["key"].to_numpy(np.int64).view(np.uint64))
    short = sorted(r[0] for r in items.select(F.size("item_words")).filter(F.size("item_words") < SHORT).distinct().collect())  # SHORT numbers at most
    hits = write_shared(hit_rows(docs, known, short).withColumn("row", F.xxhash64("doc_id", "t1", "t2")), "hits")
    places = hits.select("row", F.explode(F.arrays_zip("pos", "key")).alias("w")).select("row", F.col("w.key").alias("key"), F.col("w.pos").alias("pos"))
    pairs = places.join(small(index), "key").select("row", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    tries = pairs.join(hits.drop("pos", "key").dropDuplicates(["row"]), "row").join(small(items), "item_id")
    return tries.select("doc_id", "t1", "t2", "item_id", "shift", "words", "item_words").mapInArrow(aligned, FOUND)


def contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, aligned, item_words, first_word: each document that holds an item's passage, with its best place."""
    best = passages(docs, bench).groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", (-F.col("aligned")).alias("a"), (-F.col("first_word")).alias("f"), "item_words")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.matched").alias("matched"), (-F.col("b.a")).alias("aligned"), F.col("b.item_words").alias("item_words"), (-F.col("b.f")).alias("first_word"))


def remove_contaminated(docs: DataFrame, bench: DataFrame, least: int = LEAST_REMOVED) -> DataFrame:
    """The rows of docs whose text holds no passage of at least so many equal words."""
    bad = write_shared(passages(docs, bench).filter(F.col("matched") >= least).select("t1", "t2").distinct(), "contaminated-texts")
    return docs.select(packed().alias("row"), *text_keys()).join(small(bad), ["t1", "t2"], "left_anti").select("row.*")
