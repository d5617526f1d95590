"""Periodic run detection by multi-scale minimizers.

A run is a stretch of words with smallest period q (words q apart are equal) of at least max(24, 3 q) words that no
neighbour extends. Words become exact integers (a dictionary for each slice of rows), and all texts of a slice are laid
one behind the other, longest first, with a number of its own behind each, so that nothing periodic crosses a text.

* Periods to SHORT are found by comparing the words with themselves at every lag.
* Longer ones have scales. The scale of periods low..high (high = 1.5 low) hashes stretches of high words, and selects each
  that is smallest in one of the windows of 2 low - high + 1 starts that hold it. A run of 3 q words holds a whole window
  and its copy q words on, where the same start is selected; a stretch of q words or more does not come again inside a
  period (a rotation of a primitive word is another word). So some selected start and the next one with the same hash are q
  apart: these pairs seed the extension, which compares the words themselves. No run is missed, and none is made up.

Work is linear in the words at each scale, and a text takes part in the scales that it is long enough for. Every row is
worked on by itself: nothing is shuffled or broadcast, and long texts are not cut.

Defined results: null, empty and blank texts have no words, no runs, and the digest of nothing; a null doc_id does not
change words (h counts as not divisible by 10); repeated rows and shared ids are rows of their own; an empty table gives no
rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, powers, slices

#: Shortest run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Periods up to this are found by comparing at their lag.
SHORT = 15

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_BASE = 0xD1342543DE82EF95


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """The original word at each place, where the id's checksum asks for a repeated passage; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(b"%d" % doc_id)
    g, rest = divmod(h, 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def same_stretches(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of every maximal stretch with this period and at least so many words."""
    if len(ids) <= lag:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids[:-lag] == ids[lag:]).view(np.int8), [0]))))
    begins, ends = edges[::2], edges[1::2] + lag
    keep = ends - begins >= least
    return list(zip(begins[keep].tolist(), ends[keep].tolist()))


def primes_of(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def is_smallest(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of two periods or more has no smaller one; smaller ones would divide it."""
    block = ids[start : start + period]
    return not any(np.array_equal(block[period // f :], block[: -(period // f)]) for f in primes_of(period))


def grown(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch with this period around the words at and at + lag, in steps that double."""
    end, step = at, 64
    while end + lag < len(ids):
        a, b = ids[end : min(end + step, len(ids) - lag)], ids[end + lag : end + lag + step]
        off = np.flatnonzero(a != b)
        if len(off):
            end += int(off[0])
            break
        end, step = end + len(a), step * 2
    start, step = at, 64
    while start > 0:
        low = max(0, start - step)
        off = np.flatnonzero(ids[low:start] != ids[low + lag : start + lag])
        if len(off):
            start = low + int(off[-1]) + 1
            break
        start, step = low, step * 2
    return start, end + lag


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every window of so many values, by windows that double."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def seeds(sums: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected starts and lags of equal neighbours among the minimizers of a scale. sums: prefix sums of the word hashes."""
    n = len(sums) - 1
    window = 2 * low - high + 1
    starts = n - high + 1
    if starts < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = mix((sums[high:] - sums[: starts]) * powers(_BASE, n + 1)[n - starts + 1 :][::-1])
    least = sliding(h, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate((edge, least, edge)), window, np.maximum) == h)
    order = np.argsort(h[at], kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    keep = (h[a] == h[b]) & (b - a >= low) & (b - a <= high)
    return a[keep], (b - a)[keep]


def runs(ids: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in texts laid one behind the other, longest first; sizes: their words, and one number between."""
    out = []
    for q in range(1, SHORT + 1):
        out += [(a, b, q) for a, b in same_stretches(ids, q, max(LEAST_WORDS, LEAST_PERIODS * q)) if q == 1 or is_smallest(ids, a, q)]
    ends = np.cumsum(sizes)
    low = SHORT + 1
    sums = None
    while len(sizes) and LEAST_PERIODS * low <= sizes[0]:
        high = low + low // 2
        long_enough = int(np.searchsorted(-sizes, -LEAST_PERIODS * low, "right"))
        n = int(ends[long_enough - 1])
        if sums is None:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(ids[:n].astype(np.uint64), 3) * powers(_BASE, n), out=sums[1:])
        at, lag = seeds(sums[: n + 1], low, high)
        order = np.lexsort((at, lag))
        last, upto = 0, -1
        for k, d in zip(at[order].tolist(), lag[order].tolist()):
            if d == last and k + d < upto:
                continue
            a, b = grown(ids, k, d)
            last, upto = d, b
            if b - a >= LEAST_PERIODS * d and is_smallest(ids, a, d):
                out.append((a, b, d))
        low = high + 1
    return out


def digest_row(doc: int | None, words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """The row of a text; found: start, end and period of its runs."""
    found = sorted((a, b - a, q) for a, b, q in found)
    best = None
    for a, size, q in sorted(found, key=lambda r: (r[0], r[2])):
        if best is None or size * best[2] > best[1] * q:
            best = (a, size, q)
    if found:
        kept = np.ones(len(words) + 1, bool)
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, [a + q for a, _, q in found], 1)
        np.add.at(edges, [a + size for a, size, _ in found], -1)
        kept = np.cumsum(edges)[:-1] == 0
        words = [w for w, k in zip(words, kept.tolist()) if k]
    lines = "".join(f"{a},{size},{q}\n" for a, size, q in sorted(found, key=lambda r: (r[0], r[2])))
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def rows_of(ids: list[int | None], texts: list[bytes]) -> list[tuple]:
    """The rows of some texts, in their order."""
    words = []
    for doc, text in zip(ids, texts):
        own = text.split()  # at the bytes 0x20 and 0x09-0x0D
        at = planted(len(own), doc)
        words.append(own if at is None else [own[k] for k in at.tolist()])
    counts = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] >= LEAST_WORDS]
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if len(order):
        flat = pa.array([w for k in order for w in words[k]], pa.binary()).dictionary_encode()
        number, sizes = flat.indices.to_numpy().astype(np.int64), counts[order] + 1
        all_ids = np.empty(int(sizes.sum()), np.int64)
        between = np.zeros(len(all_ids), bool)
        between[np.cumsum(sizes) - 1] = True
        all_ids[~between] = number
        all_ids[between] = -1 - np.arange(len(order))
        begins = np.cumsum(sizes) - sizes
        for a, b, q in runs(all_ids, sizes):
            k = int(np.searchsorted(begins, a, "right")) - 1
            at = int(begins[k])
            found[order[k]].append((a - at, b - at, q))
    return [digest_row(doc, w, f) for doc, w, f in zip(ids, words, found)]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Number of runs of every text, the one with most periods, and digests of all runs and of the text without repeats."""

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                rows = rows_of(part.column("doc_id").to_pylist(), texts)
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(each, SCHEMA)
