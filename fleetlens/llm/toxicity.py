"""Toxicity with noisy-channel deobfuscation.

A token that looks disguised (letters mixed with look-alike digits and marks, or set apart by marks or blanks, or held down)
is a lattice: each character may stand for several letters, be a separator or the end of a word, or repeat the one before
it. Viterbi decoding finds the likeliest plain words: channel costs of each reading plus a character trigram model counted
over all documents. Restored words are scored like plain ones. Letters with accents and doubled letters are common in clean
text, so they are no sign of a disguise by themselves: every word that has some is also scored with plain single letters.

Features are words and word beginnings, by hash, present once, twice, or three times and more. Those that mark toxic texts
are chosen by their G2 statistic in a bounded sample of labelled texts that are not held out (SAMPLE_TOXIC and SAMPLE_CLEAN
texts, drawn by hash), and weighted by a logistic regression over which of them a text has. Labels, lang, source and doc_id
are never features.

What opens the lattice: two marks or digits that look like letters beside a letter, or one beside two; a separator between
letters; a letter three times on end; up to two look-alike marks at the end; a letter outside Latin-1 beside ASCII ones; three
or more words of one character on end. Tokens without any letter (numbers) are none. Characters held down count three times
at most, so tokens of any length are decoded in linear time. A run set apart by blanks is cut into words by the language
model; as that may cut wrong, all its stretches of 3 to STRETCH letters are features besides.

Defined results: null and empty texts have no features and get the base score; without labelled texts of both classes all
scores are the share of ones (0 without rows); of several labels of one doc_id the largest counts; repeated rows get equal
scores; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, flat, held_out, mix, ragged, signed, slices
from .quality_fm import sample_labelled

SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 5000
#: Features of a model, at most; and the least G2 of one (random features of this sample stay far below).
FEATURES, LEAST_G2 = 4096, 60.0
THRESHOLD = 0.5
#: Occurrences of a feature in a text that are told apart.
LEVELS = 3
#: Letters of the stretches of a spaced-out run that are looked at besides its words.
STRETCH = 16
#: Decoded tokens that a worker keeps.
KEPT_TOKENS = 200_000
#: Share of toxic texts that scores assume.
PRIOR = 0.35
#: Bytes of word beginnings that are features, of words that go on.
PREFIXES = (4, 5, 6, 7, 8)
# Letters that a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "&": "a",
}
SEPARATORS = " .-_*~'/\\:,;=#^"
KEEP_COST, SWAP_COST, DROP_COST, BREAK_COST, REPEAT_COST, WRONG_REPEAT_COST = 0.0, 0.7, 0.4, 1.0, 0.3, 1.5

#: Classes of the character model: 0 what ends a word, 1-26 letters, 27 other letters.
_CLASS = np.zeros(256, np.int64)
_CLASS[0x61:0x7B] = _CLASS[0x41:0x5B] = np.arange(1, 27)
_CLASS[0x80:] = 27
CLASSES = 28

_flag = lambda chars: np.isin(np.arange(256), [ord(c) for c in chars])
_IS_LOOKALIKE, _IS_SEPARATOR = _flag("".join(LOOKALIKES)), _flag(SEPARATORS)
_IS_LETTER = (_CLASS > 0) & (_CLASS < 27)
_IS_ALNUM = _IS_LETTER | _flag("0123456789") | (np.arange(256) >= 0x80)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: The plain letter of the Latin-1 letters that UTF-8 writes as 0xC3 and this byte; 0 where there is none.
_PLAIN_LETTER = np.array([ord(c) if b >= 0x80 and "a" <= (c := unicodedata.normalize("NFKD", chr(b + 0x40))[0].lower()) <= "z" and b < 0xC0 else 0 for b in range(256)], np.uint8)
HELD = re.compile(r"(.)\1{3,}", re.DOTALL)
WORD_ENDS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def character_counts(docs: DataFrame) -> np.ndarray:
    """Character trigrams of all documents, CLASSES to the third numbers."""
    n = CLASSES**3

    def count(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            for part in slices(batch):
                c = _CLASS[flat(part.column("text"))[0]]
                if len(c) > 2:
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=n)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    rows = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n, np.int64)
    out[rows["k"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(CLASSES, CLASSES, CLASSES)


def costs(counts: np.ndarray) -> np.ndarray:
    """-log2 P(c | a, b), with the pair's and the letter's own counts behind it where trigrams are few."""
    letter = counts.sum(axis=(0, 1)) + 1.0
    pair = counts.sum(axis=0) + 20 * letter / letter.sum()
    pair /= pair.sum(axis=1, keepdims=True)
    p = (counts + 20 * pair[None]) / (counts.sum(axis=2, keepdims=True) + 20)
    return -np.log2(p)


def readings(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each character of a token: what it may stand for ("" for nothing, a blank for the end of a word), and what that costs."""
    before = ""
    for c in HELD.sub(r"\1\1\1", token.lower()):
        plain = unicodedata.normalize("NFKD", c)[0].lower() if ord(c) > 127 else c
        each: dict[str, float] = {}
        if "a" <= plain <= "z":
            each[plain] = KEEP_COST if plain == c else SWAP_COST
        for letter in LOOKALIKES.get(c, ""):
            each[letter] = SWAP_COST
        if c in SEPARATORS or not each:
            each[""], each[" "] = DROP_COST, BREAK_COST
        elif c == before:
            each[""] = REPEAT_COST
            each = {k: v + (WRONG_REPEAT_COST if k else 0) for k, v in each.items()}
        elif c in "!|&<(+":
            each[""] = DROP_COST * 4
        yield list(each.items())
        before = c


class Decoder:
    """The plain words behind disguised tokens, by Viterbi over the last two letters; tokens seen lately are kept."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()
        self.seen: dict[str, list[str]] = {}

    def decode(self, token: str) -> str:
        """The likeliest words, a blank between them. Paths are linked lists of letters, shared where they have a common start."""
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in readings(token):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, path) in states.items():
                after = self.cost[a][b]
                for letter, extra in options:
                    if not letter or (letter == " " and not b):
                        key, total, way = (a, b), so_far + extra, path
                    else:
                        c = ord(letter) - 96 if letter != " " else 0
                        key, total, way = (b, c), so_far + extra + after[c], (path, letter)
                    if key not in new or total < new[key][0]:
                        new[key] = (total, way)
            states = new
        path = min(((s + (self.cost[a][b][0] if b else 0.0), k) for k, ((a, b), (s, _)) in enumerate(states.items())))[1]
        path, letters = list(states.values())[path][1], []
        while path:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def words(self, token: str) -> list[str]:
        """The restored words that the token does not show plainly."""
        found = self.seen.get(token)
        if found is None:
            found = sorted(set(self.decode(token).split()) - set(WORD_ENDS.split(token.lower())))
            if len(self.seen) >= KEPT_TOKENS:
                self.seen.clear()
            if len(token) < 200:
                self.seen[token] = found
        return found


def run_hashes(words: list[str]) -> np.ndarray:
    """Feature hashes of a decoded run: of its words, and of each distinct stretch of 3 to STRETCH letters."""
    _, h = feature_hashes(Words(pa.array(words, pa.string()), "plain"))
    w = Words(pa.array(["".join(words)]), "plain")
    n, out = len(w.bytes), [h]
    for size in range(3, min(STRETCH, n) + 1):
        i = np.arange(n - size + 1)
        h = w.span_hash(i, i + size)
        out.append(np.unique(mix(h, 21)))
        if size in PREFIXES:
            out.append(np.unique(mix(h[:-1], size)))
    return np.concatenate(out)


def disguised(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last byte, and whether it is spaced out, of what may hide a word; w: words between blanks."""
    b = w.bytes
    if not len(w.start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    at = np.arange(len(b))
    last = np.maximum.accumulate(np.where(_IS_ALNUM[b], at, -1))[w.end - 1]
    end = np.maximum(last + 1, w.start)
    sums = lambda flag: np.concatenate([[0], np.cumsum(flag)])
    inside = lambda total, a, e: total[np.maximum(e, a)] - total[a]
    low = _LOWER[b]
    held = np.zeros(len(b), bool)
    held[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _IS_LETTER[low[2:]]
    letter_sums, alike_sums = sums(_IS_LETTER[b]), sums(_IS_LOOKALIKE[b])
    tail = w.end - end
    open_end = (tail >= 1) & (tail <= 2) & (inside(alike_sums, end, w.end) == tail)
    end = np.where(open_end, w.end, end)
    letters, alike = inside(letter_sums, w.start, end), inside(alike_sums, w.start, end)
    # Separators with a letter (or what looks like one) on both sides.
    like = _IS_ALNUM[b] | _IS_LOOKALIKE[b]
    between = np.zeros(len(b), bool)
    between[1:-1] = _IS_SEPARATOR[b[1:-1]] & like[:-2] & like[2:]
    apart = inside(sums(between), np.minimum(w.start + 1, end), np.maximum(end - 1, w.start))
    triple = inside(sums(held), np.minimum(w.start + 2, end), end)
    foreign = inside(sums(b >= 0xC4), w.start, end)
    odd = (letters >= 1) & (letters + alike >= 3) & ((alike >= 2) | ((alike >= 1) & (letters >= 2)) | (triple >= 1) | (apart >= 1))
    odd |= (foreign >= 1) & (letters + foreign >= 3)
    odd |= (b[w.start] == 0xEF) & (foreign >= 3)  # full-width letters
    pick = np.flatnonzero(odd)
    # Runs of three or more words of one character each, in one text.
    one = (w.end - w.start == 1) & (_IS_LETTER | _IS_LOOKALIKE)[b[w.start]]
    joins = np.zeros(len(one) + 1, bool)
    joins[1:-1] = one[1:] & one[:-1] & (w.row[1:] == w.row[:-1])
    begins = np.flatnonzero(one & ~joins[:-1])
    ends = np.flatnonzero(one & ~joins[1:])
    long = ends - begins >= 2
    begins, ends = begins[long], ends[long]
    return np.concatenate([w.row[pick], w.row[begins]]), np.concatenate([w.start[pick], w.start[begins]]), np.concatenate([end[pick], w.end[ends]]), np.repeat([False, True], [len(pick), len(begins)])


def feature_hashes(w: Words, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of words (those in `of`) and word beginnings."""
    of = np.arange(len(w.start)) if of is None else of
    start, end, row = w.start[of], w.end[of], w.row[of]
    rows, hashes = [row], [mix(w.hash[of], 21)]
    for k in PREFIXES:
        long = np.flatnonzero(end - start > k)
        rows.append(row[long])
        hashes.append(mix(w.span_hash(start[long], start[long] + k), k))
    return np.concatenate(rows), np.concatenate(hashes)


def single_letters(w: Words) -> tuple[Words, np.ndarray]:
    """The same words with Latin-1 letters as plain ones and each letter once in a run; and the numbers of those that this changes."""
    b = w.bytes
    g = _LOWER[b]
    lead = np.zeros(len(b), bool)
    if len(b) > 1:
        base = _PLAIN_LETTER[b[1:]]
        lead[:-1] = (b[:-1] == 0xC3) & (base > 0)
        g[1:] = np.where(lead[:-1], base, g[1:])
    kept = np.flatnonzero(~lead)
    first = np.zeros(len(b) + 1, bool)
    first[w.offsets] = True
    begins = first[kept]
    begins[1:] |= first[kept[1:] - 1] & lead[kept[1:] - 1]
    again = np.zeros(len(kept), bool)
    again[1:] = (g[kept[1:]] == g[kept[:-1]]) & _IS_LETTER[g[kept[1:]]] & ~begins[1:]
    keep = ~lead
    keep[kept[again]] = False
    total = np.concatenate([[0], np.cumsum(keep)])
    text = pa.Array.from_buffers(pa.large_binary(), len(w.offsets) - 1, [None, pa.py_buffer(total[w.offsets].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(g[keep]))])
    size = w.end - w.start
    return Words(text, "plain"), np.flatnonzero(total[w.end] - total[w.start] < size)


def text_features(text: pa.Array, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the features of texts, disguised words restored."""
    plain = Words(text, "plain")
    row, h = feature_hashes(plain)
    rows, hashes = [row], [h]
    single, changed = single_letters(plain)
    if len(changed):
        row, h = feature_hashes(single, changed)
        rows.append(row)
        hashes.append(h)
    w = Words(text, "space")
    at, start, end, spaced = disguised(w)
    if len(at):
        _, first, which = np.unique(w.span_hash(start, end) ^ spaced.astype(np.uint64), return_index=True, return_inverse=True)
        tokens = [w.bytes[start[i] : end[i]].tobytes().decode("utf-8", "replace") for i in first.tolist()]
        found = [[] if s else decoder.words(t) for t, s in zip(tokens, spaced[first].tolist())]
        # Features of each distinct token, then those of every place where it stands.
        of, h = feature_hashes(Words(pa.array([x for f in found for x in f], pa.string()), "plain"))
        of, h = [np.repeat(np.arange(len(found)), [len(f) for f in found])[of]], [h]
        for k in np.flatnonzero(spaced[first]).tolist():
            h.append(run_hashes(decoder.decode(tokens[k]).split()))
            of.append(np.full(len(h[-1]), k))
        of, h = np.concatenate(of), np.concatenate(h)
        h, per = h[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(found))
        counts = per[which]
        begin = (np.cumsum(per) - per)[which]
        inside = np.cumsum(counts) - counts
        rows.append(np.repeat(at, counts))
        hashes.append(h[np.repeat(begin - inside, counts) + np.arange(int(counts.sum()))])
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class Model:
    """keys: hashes in order; weight: of each key, what its first, second and third occurrence add."""

    cost: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros((0, LEVELS)))
    bias: float = -20.0

    def found(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, key number and occurrences (LEVELS at most) of the keys among features, in order of rows."""
        if not len(self.keys):
            return (np.zeros(0, np.int64),) * 3
        table = np.zeros(1 << 16, bool)
        table[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        some = np.flatnonzero(table[(h & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
        good = self.keys[k] == h[some]
        pairs, n = np.unique(row[some][good] * len(self.keys) + k[good], return_counts=True)
        return pairs // len(self.keys), pairs % len(self.keys), np.minimum(n, LEVELS)

    def margin(self, row: np.ndarray, k: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(row, weights=np.cumsum(self.weight, axis=1)[k, times - 1] if len(k) else None, minlength=n)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    cost = costs(character_counts(docs))
    drawn = sample_labelled(docs, labels, "toxic", {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN})
    total = {r["y"]: r["n"] for r in drawn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n0 or not n1:
        return Model(cost, bias=20.0 if n1 else -20.0)
    shared = spark.sparkContext.broadcast(cost)

    def count(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            for part in slices(batch):
                row, h = text_features(part.column("text"), decoder)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                y = part.column("y").to_numpy()
                for level in range(LEVELS):  # 0: a feature's first place in a text, 1: its second, ...
                    at = np.ones(len(h), bool)
                    for back in range(1, level + 1):
                        at[:back] = False
                        at[back:] &= (h[back:] == h[:-back]) & (row[back:] == row[:-back])
                    more = at.copy()
                    more[: level + 1] = False
                    more[level + 1 :] &= (h[level + 1 :] == h[: -level - 1]) & (row[level + 1 :] == row[: -level - 1])
                    at &= ~more
                    key, back = np.unique(h[at], return_inverse=True)
                    toxic = np.bincount(back, weights=y[row[at]], minlength=len(key)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(np.full(len(key), level, np.int32)), pa.array(toxic), pa.array(np.bincount(back, minlength=len(key)) - toxic)], names=["h", "level", "t", "c"])

    table = drawn.select("text", "y").mapInArrow(count, "h long, level int, t long, c long").groupBy("h", "level").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    both = F.col("t") + F.col("c")
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    g2 = 2 * (part(F.col("t"), both * n1 / (n0 + n1)) + part(F.col("c"), both * n0 / (n0 + n1)) + part(n1 - F.col("t"), (n0 + n1 - both) * n1 / (n0 + n1)) + part(n0 - F.col("c"), (n0 + n1 - both) * n0 / (n0 + n1)))
    marks = table.filter(F.col("t") * n0 > 5 * F.col("c") * n1).select("h", "level", g2.alias("g2")).filter(F.col("g2") >= F.least(F.lit(LEAST_G2), F.lit(0.02 * (n0 + n1))))
    marks = marks.orderBy(F.desc("g2"), "h", "level").limit(FEATURES).toPandas()
    keys, slot = np.unique(marks["h"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    used = np.zeros((len(keys), LEVELS))
    used[slot, marks["level"].to_numpy()] = 1
    model = Model(cost, keys, used)
    given = spark.sparkContext.broadcast(model)

    def rows(batches):
        decoder = Decoder(given.value.cost)
        for batch in batches:
            for part in slices(batch):
                row, k, times = given.value.found(*text_features(part.column("text"), decoder))
                counts = np.bincount(row, minlength=len(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("y").cast(pa.int32()), ragged(k.astype(np.int32), counts, pa.int32()), ragged(times.astype(np.int32), counts, pa.int32())], names=["doc_id", "y", "k", "times"])

    got = drawn.mapInArrow(rows, "doc_id long, y int, k array<int>, times array<int>").toArrow().sort_by("doc_id")
    lists, times = got.column("k").combine_chunks(), got.column("times").combine_chunks().values.to_numpy()
    row, k, y = np.repeat(np.arange(len(got)), np.diff(lists.offsets.to_numpy())), lists.values.to_numpy(), got.column("y").to_numpy().astype(np.float64)
    share = np.where(y == 1, PRIOR / max(y.sum(), 1), (1 - PRIOR) / max((1 - y).sum(), 1))
    # Each occurrence up to the one counted is an input of its own.
    at = [np.flatnonzero(times > level) for level in range(LEVELS)]
    model.weight, model.bias = np.zeros_like(used), 0.0
    speed, speed_b = np.zeros_like(used), 0.0
    for _ in range(800):
        e = share * (1 / (1 + np.exp(-np.clip(model.margin(row, k, times, len(y)), -30, 30))) - y)
        slope = np.stack([np.bincount(k[i], weights=e[row[i]], minlength=len(keys)) for i in at], axis=1)
        speed = 0.9 * speed - 2.0 * (slope + 1e-4 * model.weight)
        speed_b = 0.9 * speed_b - 2.0 * e.sum()
        model.weight, model.bias = np.maximum(model.weight + speed, 0) * used, model.bias + speed_b
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # FEATURES keys at most

    def each(batches):
        model, decoder = shared.value, Decoder(shared.value.cost)
        for batch in batches:
            for part in slices(batch):
                n = len(part)
                z = model.margin(*model.found(*text_features(part.column("text"), decoder)), n)
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(each, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
