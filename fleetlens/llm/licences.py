"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates tags.

Texts are lower-cased (A-Z) and cut into words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. One automaton runs over the words
joined by single spaces, so marks and line ends between words do not hide a phrase; the words of the identifier tag are one
of its phrases. Where these stand as `SPDX-License-Identifier:` in the text, the expression behind them (AND, OR, WITH,
brackets; to the end of the line or the next tag) is parsed to reverse Polish and evaluated to the licences that it names,
and to whether permissive licences alone can meet it.

score: 1 for a tag that parses; else 1 - the product of 2 / (2 + w) over the distinct phrases found, w their numbers of
words (long phrases hardly occur by chance), and of 1/2 for each name in a tag that does not parse; 0 without a sign.

Defined results: null and empty texts have no words, no places, empty label strings, score 0 and a null `permissive`; a tag
whose expression does not parse counts its readable names only and is not permissive; rows that are repeated, or have a
null doc_id, are scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# The method's own phrases and labels.
PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons": "creative-commons",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "licensed under": "notice",
    "released under the": "notice",
    "permission is hereby granted free of charge": "mit-text",
    "redistribution and use in source and binary forms": "bsd-text",
}
# Names of permissive licences, as in identifier tags; a version or clause may follow after a hyphen.
PERMISSIVE = {"mit", "mit-0", "apache", "bsd", "0bsd", "isc", "cc0", "cc-by-3.0", "cc-by-4.0", "unlicense", "zlib", "bsl-1.0", "python", "psf"}
TAG, TAG_WORDS = b"spdx-license-identifier:", "spdx license identifier"
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
PLAIN = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(text: str) -> list[str] | None:
    """The expression in reverse Polish, by the shunting-yard method; None if it is not one."""
    out, waiting, operand = [], [], True  # operand: a name is due
    for token in TOKEN.findall(text):
        word = token.lower()
        if operand and token == "(":
            waiting.append("(")
        elif operand and word not in RANK and token != ")":
            out.append(word)
            operand = False
        elif not operand and word in RANK:
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand = True
        elif not operand and token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        else:
            return None
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def is_permissive(name: str) -> bool:
    """Whether a name is in PERMISSIVE, or is one of these with a version or number of clauses (apache-2.0, bsd-3-clause)."""
    return name in PERMISSIVE or re.sub(r"-[0-9][0-9.]*(-clause(-[a-z]+)?)?\+?$", "", name) in PERMISSIVE


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """The licences that an expression names (exceptions left out), and whether permissive ones alone can meet it."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token not in RANK:
            stack.append(({token}, is_permissive(token)))
            continue
        (b, fine_b), (a, fine_a) = stack.pop(), stack.pop()
        stack.append((a, fine_a) if token == "with" else (a | b, fine_a or fine_b if token == "or" else fine_a and fine_b))
    return stack[0]


def expression_at(line: str) -> str:
    """The expression that the rest of a tag's line begins with: names joined by operators, to where they no longer go on."""
    end, depth, operand = 0, 0, True
    for m in TOKEN.finditer(line):
        word = m[0].lower()
        if line[end : m.start()].strip(" \t\r"):
            break
        if operand and word == "(":
            depth += 1
        elif operand and word not in RANK and word != ")":
            operand = False
        elif not operand and word in RANK:
            operand = True
        elif not operand and word == ")" and depth:
            depth -= 1
        else:
            break
        end = m.end()
    return re.sub(r"(?i)\s+(and|or|with)\s*$", "", line[:end])


def automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for phrase in [*BASE, *PHRASES, TAG_WORDS]:
        auto.add_word(f" {phrase} ", phrase)
    auto.make_automaton()
    return auto


def tags_at(text: bytes, plain: bytes, numbers: list[int]) -> list[tuple[set[str], bool, bool]]:
    """Names, whether permissive ones meet it, and whether it parses, of each tag; numbers: of the words that tags begin with."""
    wanted, starts = set(numbers), []
    for k, m in enumerate(re.finditer(rb"[^ ]+", plain)):
        if k in wanted and text[m.start() : m.start() + len(TAG)].translate(LOWER) == TAG:
            starts.append(m.start())
    out = []
    for start, following in zip(starts, [*starts[1:], len(text)]):  # parts do not overlap, so this is linear
        start += len(TAG)
        end = text.find(b"\n", start, following)
        expression = expression_at(text[start : end if end >= 0 else following].translate(LOWER).decode("utf-8", "replace"))
        postfix = to_postfix(expression)
        out.append((*evaluate(postfix), True) if postfix else ({t for t in TOKEN.findall(expression) if t not in RANK and t not in "()"}, False, False))
    return out


def scan(text: bytes, auto) -> tuple[int, list[tuple[int, str]], list[tuple[set[str], bool, bool]]]:
    """Number of words; (first word, phrase) of every place; what each identifier tag says."""
    plain = text.translate(PLAIN)
    words = plain.split()
    line = (b" %b " % b" ".join(words)).decode("utf-8", "surrogateescape")
    places, tags = [], []
    counted, upto = 0, 0  # blanks seen so far
    for start, phrase in sorted((end - len(phrase) - 1, phrase) for end, phrase in auto.iter(line)):
        counted += line.count(" ", upto, start)
        upto = start
        if phrase == TAG_WORDS:
            tags.append(counted)
        else:
            places.append((counted, phrase))
    return len(words), places, tags_at(text, plain, tags) if tags else []


def score_of(phrases: set[str], tags: list[tuple[set[str], bool, bool]]) -> float:
    if any(parsed for _, _, parsed in tags):
        return 1.0
    doubt = 0.5 ** len(set().union(*(names for names, _, _ in tags)))
    for phrase in phrases:
        doubt *= 2 / (2 + len(phrase.split()))
    return 1 - doubt


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression_licences array<string>, permissive boolean"


def licence_scan(docs: DataFrame) -> DataFrame:
    """Words, places and labels of every text, the licences that its tags name, and whether permissive ones meet all its tags."""

    def each(batches):
        auto = automaton()
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary())):
                    n, places, tags = scan(text.as_py() or b"", auto)
                    base = [(k, p) for k, p in places if p in BASE]
                    named = set().union(*(names for names, _, _ in tags))
                    base_labels = sorted({BASE[p] for _, p in base})
                    labels = sorted({*base_labels, *(PHRASES[p] for _, p in places if p in PHRASES), *named})
                    score = score_of({p for _, p in places}, tags)
                    fine = all(f for _, f, _ in tags) if tags else None
                    first = min((k for k, _ in base), default=None), max((k for k, _ in base), default=None)
                    out.append((doc, n, len(base), *first, ",".join(base_labels), ",".join(labels), score, sorted(named), fine))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expression_licences", "permissive"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(each, SCHEMA)
