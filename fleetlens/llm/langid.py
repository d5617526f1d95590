"""Language identification by error-correcting output codes.

Every language has a codeword; codewords get longer with the number of languages, so that they stay far apart. One binary
classifier a bit, logistic regression over hashed character n-grams (byte trigrams inside words, and word beginnings and endings), predicts the bit.
A text's language is that whose codeword has the least loss, sum_b weight_b * log(1 + exp(-margin_b * code_b)); a bit
weighs what its classifier's training accuracy is above chance. score is the softmax of the negative losses, and ambiguous
marks texts whose two best codewords are close.

Classifiers are fitted on about SAMPLE texts with a lang (a bound of the model: drawn by hash, equal rows once, and one text at
least of each language). All values of lang are languages, but for those with fewer than least_texts texts (0 by default);
lang, source and doc_id are never features. Texts are counted in dense rows of n-grams, BLOCK texts at once.

Defined results: null texts, and texts without a letter, are `und` with score 0; without any language to learn, all are
`und`; with one language, all texts with letters get it; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, flat, held_out, slices, write_shared

SAMPLE = 2500
#: Languages with fewer texts are left out; 0: none is. A model holds MOST_LANGS languages; with more, ask for more texts of each.
LEAST_TEXTS = 0
MOST_LANGS = 1 << 14
#: Bits of a codeword of up to four languages; six more for each doubling.
BITS = 15
#: Texts whose n-grams are counted at once.
BLOCK = 256
SLOTS = 1 << 12
UND = "und"

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[0x41:0x5B] += 32
_LOWER[SEPARATORS["plain"]] = 0x20
_LOWER[0x30:0x3A] = 0x20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def code_bits(n: int) -> int:
    return BITS + 6 * max(0, (n - 1).bit_length() - 2)


def codebook(n: int, seed: int = 3) -> np.ndarray:
    """n codewords of +1 and -1, far apart: the best of many random codes by least distance between words and between bits."""
    rng, bits = np.random.default_rng(seed), code_bits(n)
    best, far = None, -1
    for _ in range(max(1, min(300, 3_000_000 // n**2)) if n > 1 else 1):
        code = rng.choice([-1, 1], (n, bits))
        same = (code @ code.T)[~np.eye(n, dtype=bool)]
        constant = (np.abs(code.sum(axis=0)) == n).sum() if n > 1 else 0
        apart = (bits - (same.max() if len(same) else 0)) / 2 - constant
        if apart > far:
            best, far = code, apart
    return best


def grams(text: pa.Array) -> np.ndarray:
    """A row of SLOTS n-gram shares for each text, scaled to length one."""
    b, offsets = flat(text)
    n = len(offsets) - 1
    # A blank stands between texts, so that no n-gram spans two of them.
    row = np.repeat(np.arange(n), np.diff(offsets) + 1)
    c = np.full(len(b) + n, 0x20, np.uint32)
    inside = np.ones(len(c), bool)
    inside[offsets[1:] + np.arange(n)] = False
    c[inside] = _LOWER[b]
    if len(c) < 3:
        return np.zeros((n, SLOTS), np.float32)
    g = (c[:-2] << 16) | (c[1:-1] << 8) | c[2:]
    use = (c[1:-1] != 0x20) & ((c[:-2] != 0x20) | (c[2:] != 0x20))
    slot = (g * np.uint32(2654435761)) >> np.uint32(32 - 12)
    at = row[1:-1][use] * SLOTS + slot[use]
    x = np.sqrt(np.bincount(at, minlength=n * SLOTS).reshape(n, SLOTS).astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def has_letter(text: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any alphabet; texts without an ASCII letter are looked through one character at a time."""
    b, offsets = flat(text)
    seen = np.concatenate([[0], np.cumsum(_LETTER[b])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in text[i].as_py() or "")
    return out


@dataclass
class Coder:
    langs: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Logistic losses of all bits, weighted, for each text and language: those of +1 and -1 differ by the margin."""
        margin = x @ self.weight + self.bias
        even = ((np.logaddexp(0, -margin) + np.logaddexp(0, margin)) / 2 * self.trust).sum(axis=1, keepdims=True)
        return even - (margin * self.trust / 2) @ self.code.T


def fit(x: np.ndarray, lang: list[str]) -> Coder:
    """Logistic regressions of all bits at once, by full gradient steps with momentum."""
    langs = sorted(set(lang))
    code = codebook(max(len(langs), 1))
    if not langs:
        return Coder([], code, np.zeros((SLOTS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.ones(code.shape[1]))
    which = np.array([langs.index(v) for v in lang])
    y = code[which].astype(np.float32)
    balance = (len(which) / np.bincount(which) / len(langs))[which].astype(np.float32)[:, None]
    w, b = np.zeros((SLOTS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(250):
        slope = -y * balance / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        vw = 0.9 * vw - 4.0 * (x.T @ slope / len(x) + 1e-5 * w)
        vb = 0.9 * vb - 4.0 * slope.mean(axis=0)
        w, b = w + vw, b + vb
    right = ((x @ w + b) * y > 0).mean(axis=0)
    return Coder(langs, code, w.astype(np.float32), b.astype(np.float32), np.maximum(right - 0.5, 0.01) * 2)


def train(docs: DataFrame, most: int = SAMPLE, least_texts: int = LEAST_TEXTS) -> Coder:
    """A coder fitted on about `most` texts, spread over the languages, with one of each at least. Equal rows count once."""
    order = F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1 << 30))
    known = docs.filter("lang is not null and text is not null").filter(~held_out()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text", order.alias("order"))
    first = F.min_by(F.struct("doc_id", "text", "order"), F.struct("order", "doc_id")).alias("first")
    counts = write_shared(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), first).filter(F.col("n") >= least_texts), "languages")
    n_langs = counts.count()
    if n_langs > MOST_LANGS:
        raise ValueError(f"{n_langs} languages are more than a model holds ({MOST_LANGS}): set least_texts")
    share = F.least(F.lit(1.0), max(1, most // max(n_langs, 1)) / F.col("n"))
    drawn = known.join(F.broadcast(counts.select("lang", "n")), "lang").filter(F.col("order") < share * (1 << 30)).select("doc_id", "lang", "text", "order")
    drawn = drawn.unionByName(counts.select("lang", "first.*")).dropDuplicates(["lang", "doc_id", "order"])
    # The share of a language is about what is asked for; the bound holds whatever the hashes are.
    drawn = write_shared(drawn.orderBy("order", "lang", "doc_id").limit(2 * most + n_langs).select("doc_id", "lang", "text"), "language-sample")

    def each(batches):
        for batch in batches:
            for part in slices(batch, rows=BLOCK):
                x = grams(part.column("text"))
                rows = [(np.flatnonzero(v), v) for v in x]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("lang").cast(pa.string()), pa.array([k.astype(np.int32) for k, _ in rows], pa.list_(pa.int32())), pa.array([v[k] for k, v in rows], pa.list_(pa.float32()))], names=["doc_id", "lang", "k", "v"])

    # At most 2 * most rows, and one for each language.
    rows = drawn.mapInArrow(each, "doc_id long, lang string, k array<int>, v array<float>").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    x = np.zeros((len(rows), SLOTS), np.float32)
    for i, (k, v) in enumerate(zip(rows.column("k"), rows.column("v"))):
        x[i, k.values.to_numpy()] = v.values.to_numpy()
    return fit(x, rows.column("lang").to_pylist())


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def each(batches):
        coder = shared.value
        for batch in batches:
            for part in slices(batch, rows=BLOCK):
                text = part.column("text")
                fine = has_letter(text) & text.is_valid().to_numpy(zero_copy_only=False) & bool(coder.langs)
                loss = coder.losses(grams(text))
                odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
                odds /= odds.sum(axis=1, keepdims=True)
                best = odds.argmax(axis=1)
                top = np.sort(odds, axis=1)
                close = (top[:, -1] - top[:, -2] < 0.2) if odds.shape[1] > 1 else np.zeros(len(best), bool)
                name = [coder.langs[k] if f else UND for k, f in zip(best.tolist(), fine.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(name), pa.array(np.where(fine, top[:, -1], 0.0).astype(np.float64)), pa.array(close & fine)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    found = docs.select("doc_id", "text").mapInArrow(each, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
