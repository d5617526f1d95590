"""Shared helpers of the corpus operators: joins with hot groups, and numpy views of Arrow text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import new_path, scratch, write_shared  # noqa: F401

#: Bytes of text that a task handles at once in numpy; rows are never cut.
SLICE_BYTES = 1 << 20
#: Groups of which one small row each is sent to all tasks, at most.
BROADCAST_GROUPS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing A-Z).
_PLAIN = np.ones(256, bool)
_PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SEPARATORS = {"space": _SPACE, "plain": _PLAIN}

_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with groups, a written table of one row for each value of the keys, with n_rows, its number of rows.

    Up to BROADCAST_GROUPS groups are sent to all tasks. Of more, those with most rows are; each of the others has at most a
    BROADCAST_GROUPS-th of all rows, and these are joined by a shuffle. So no hot group is one task. Keys are never null.
    """
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), keys, how)
    hot = write_shared(groups.orderBy(F.desc("n_rows"), *keys).limit(BROADCAST_GROUPS), "hot-groups")
    names = F.broadcast(hot.select(*keys))
    rest = rows.join(names, keys, "left_anti").join(groups.join(names, keys, "left_anti"), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def write_clean(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written and read back; the intermediate tables that it made on the way are removed."""
    path = new_path(spark, name)
    with scratch(spark):
        df = make()
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed() -> Column:
    """All columns of a row in one, so that names of helper columns beside it clash with none of them."""
    return F.struct("*")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's text is divisible by 5 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown when a longer text comes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES + 1024), base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.cumprod(out)
    return have[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 30):
    """Parts of a batch with about `limit` bytes of text each (one row at least), and at most so many rows."""
    text = batch.column(column)
    sizes = np.diff(offsets_of(text))
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + limit, "right"))))
        yield batch.slice(at, to - at)
        at = to


def offsets_of(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    return np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text array, and each row's first byte (and the end); a null is as an empty text."""
    if text.null_count:
        text = text.fill_null("")
    offsets = offsets_of(text)
    data = text.buffers()[2] if len(text) else None
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


class Words:
    """The words of some rows: where each starts and ends in the bytes, its row, and a 64-bit hash of it in lower case (A-Z)."""

    def __init__(self, text: pa.Array, kind: str = "space"):
        self.bytes, self.offsets = flat(text)
        b, n = self.bytes, len(self.bytes)
        inside = ~SEPARATORS[kind][b]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        self.per_row = np.bincount(self.row, minlength=len(self.offsets) - 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[b] * powers(_BASE, n), out=self._sums[1:])
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, from prefix sums of a polynomial; equal for equal bytes wherever they stand."""
        raw = (self._sums[end] - self._sums[start]) * powers(_BACK, len(self.bytes) + 1)[start]
        return mix(raw + (end - start).astype(np.uint64))


def hash_of(word: str) -> int:
    """The hash that Words gives this word."""
    return int(Words(pa.array([word.replace(" ", "\x00")]), "space").hash[0])


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def ragged(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.Array:
    """A list column from all its values, and how many belong to each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def row_sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums by row (float64)."""
    return np.bincount(row, weights=values, minlength=n)
