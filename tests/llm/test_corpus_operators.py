"""Each corpus operator against a brute-force version on small rows, with nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, jaccard_join, langid, licences, mixing, quality_fm, quality_rules, token_ids, toxicity, warc
from fleetlens.llm.common import Words, new_path
from fleetlens.llm.components import components

from .conftest import ODD, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
rng = random.Random(5)
VOCABULARY = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]


def prose(n, r=rng):
    return " ".join(r.choices(VOCABULARY, k=n))


def extra(df):
    """Columns whose names the operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("size", "row", "key", "n", "slot", "_text", "words")})


def test_words_agree_with_the_pattern():
    texts = [r[1] or "" for r in ODD] + [prose(50), "Ab\x0bcd\x0cE f\rg"]
    for kind, pattern in (("space", WORD), ("plain", PLAIN)):
        w = Words(pa.array(texts), kind)
        got = [w.bytes[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
        assert [lower(x) for x in got] == [x for t in texts for x in pattern.findall(lower(t) if kind == "plain" else lower(t))]
        by_word = collections.defaultdict(set)
        for x, h in zip(got, w.hash.tolist()):
            by_word[lower(x)].add(h)
        assert all(len(h) == 1 for h in by_word.values()) and len({min(h) for h in by_word.values()}) == len(by_word)


def targets(sizes):
    """Water-filling by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in capped and sizes[s]]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share | {s: 0.0 for s in names if not sizes[s]}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(frame):
    rows = [(k, prose(rng.randint(0, 40)), "en", ["a", "b", "c", "d", None, "tiny"][0 if k % 2 else min(5, k % 40)]) for k in range(300)] + ODD
    got = mixing.mix_plan(extra(frame(rows))).collect()
    assert len(got) == len(rows)
    count = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    want, source = targets(dict(sizes)), {}
    for r in rows:
        source.setdefault((r[0], count(r[1])), r[3])
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 1 for s in want)
    again = mixing.mix_plan(frame(rows, 5)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)


def test_mixed_documents_hold_what_was_taken(frame):
    rows = [(k, prose(rng.randint(1, 30)), "en", "abc"[k % 3]) for k in range(90)]
    df = frame(rows)
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(df).collect()}
    out = collections.Counter()
    mixed = mixing.mix_documents(extra(df))
    assert mixed.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    for r in mixed.collect():
        out[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert {k: v for k, v in plan.items() if v} == dict(out)


def test_mixing_empty(spark):
    assert mixing.mix_plan(spark.createDataFrame([], SCHEMA)).count() == 0 == mixing.mix_documents(spark.createDataFrame([], SCHEMA)).count()


def base_statistics(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(frame):
    loop = "the quick brown fox jumps over"
    rows = [(100 + k, prose(60), "en", "a") for k in range(40)] + [(200, " ".join(w + "***" for w in prose(50).split()), "en", "a"), (201, (loop + " ") * 9, "en", "a"), (202, prose(20) + "\nsame line\nsame line\n", "en", "a")] + ODD
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(extra(frame(rows))).collect()}
    for doc, text, *_ in rows:
        want = base_statistics(text)
        r = got[doc, want[0]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert not got[200, 50]["kept"] and not got[201, 54]["kept"] and all(r["kept"] for (doc, _), r in got.items() if doc and 100 <= doc < 140)
    assert {r["doc_id"] for r in quality_rules.keep_good(frame(rows)).collect()} == {doc for (doc, _), r in got.items() if r["kept"]}


def test_quality_rules_empty(spark):
    assert quality_rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality_rules_with_much_junk(frame):
    """A source of which two fifths are junk, and which is most of its language and of the corpus."""
    junk = lambda: " ".join(w + "*" * 2 for w in prose(40).split())
    rows = [(k, junk() if k % 5 < 2 else prose(60), "en", "hot") for k in range(300)] + [(1000 + k, prose(60), "en", "calm") for k in range(100)]
    kept = {r["doc_id"] for r in quality_rules.judge(frame(rows)).collect() if r["kept"]}
    assert kept == {k for k in range(300) if k % 5 >= 2} | set(range(1000, 1100))


def labelled(frame, spark, good, bad, column):
    rows = [(k, good() if k % 2 else bad(), "en", "a") for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2 if column == "quality" else 1 - k % 2) for k, *_ in rows], f"doc_id long, {column} int")
    return frame(rows + ODD), labels


def test_quality_classifier(frame, spark):
    docs, labels = labelled(frame, spark, lambda: prose(50), lambda: " ".join(w.upper() + "!!" for w in prose(50).split()), "quality")
    out = quality_fm.quality_scores(extra(docs), labels).collect()
    assert len(out) == 409 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] and r["doc_id"] > 10]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in out if r["doc_id"])
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.9


def test_sum_of_squares_identity():
    m = quality_fm.Machine(0.3, np.random.default_rng(1).normal(size=20), np.random.default_rng(2).normal(size=(20, 4)))
    slot, x = np.array([1, 5, 9]), np.array([0.5, 2.0, -1.0])
    pairs = sum(m.factor[slot[i]] @ m.factor[slot[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert m.margin(slot, x, np.array([3]))[0] == pytest.approx(0.3 + m.weight[slot] @ x + pairs)


def test_classifiers_without_labels(frame, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_fm.quality_scores(frame(ODD), none).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.toxicity(frame(ODD), none).collect()} == {0}
    assert quality_fm.quality_scores(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_toxicity_sees_through_disguises(frame, spark):
    bad = lambda: f"{prose(20)} {rng.choice(['stupid', 'moron', 'idiot'])} {prose(20)}"
    docs, labels = labelled(frame, spark, lambda: prose(40), bad, "toxic")
    tests = [(1000, f"{prose(15)} st0pid 1d10t {prose(9)}"), (1001, f"{prose(15)} i d i o t {prose(9)}"), (1002, f"{prose(15)} m.o.r.o.n {prose(9)}"), (1003, f"{prose(15)} stuuuupid {prose(9)}"), (1004, prose(30)), (1005, f"{prose(9)} 2024-01-05 x1 {prose(9)}!!")]
    out = {r["doc_id"]: r for r in toxicity.toxicity(extra(docs.unionByName(frame(tests))), labels).collect()}
    assert [out[k]["predicted"] for k in range(1000, 1006)] == [1, 1, 1, 1, 0, 0]
    held = [r for r in out.values() if r["held_out"] and r["doc_id"] and 10 < r["doc_id"] < 400]
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in held]) > 0.95


@pytest.mark.parametrize("text, want", [("MIT", ({"mit"}, True)), ("MIT OR GPL-3.0", ({"mit", "gpl-3.0"}, True)), ("MIT AND GPL-3.0", ({"mit", "gpl-3.0"}, False)), ("(MIT OR GPL-2.0) AND Apache-2.0 WITH LLVM-exception", ({"mit", "gpl-2.0", "apache-2.0"}, True)), ("GPL-2.0 OR MIT AND GPL-3.0", ({"gpl-2.0", "mit", "gpl-3.0"}, False))])
def test_licence_expressions(text, want):
    assert licences.evaluate(licences.to_postfix(text)) == want


def test_broken_licence_expressions():
    assert [licences.to_postfix(t) for t in ("", "MIT OR", "OR MIT", "(MIT", "MIT)", "MIT GPL")] == [None] * 6


def test_licence_scan(frame):
    rows = [(10, "x Apache  License, Version 2.0\nand the MIT-License. CC BY-NC"), (11, "// SPDX-License-Identifier: (MIT OR GPL-3.0) AND BSD-3-Clause\nint a;"), (12, "gnu general public license gnu general public license"), *ODD]
    got = {(r["doc_id"], r["n_words"]): r for r in licences.licence_scan(extra(frame(rows))).collect()}
    for doc, text, *_ in rows:
        w = PLAIN.findall(lower(text))
        places = sorted((k, label) for phrase, label in licences.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        r = got[doc, len(w)]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), *((places[0][0], places[-1][0]) if places else (None, None)))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    tagged = next(r for (doc, _), r in got.items() if doc == 11)
    assert tagged["labels"] == "bsd-3-clause,gpl-3.0,mit" and tagged["permissive"] and tagged["score"] == 1.0


def test_warc(spark):
    body = "<p>" + "x" * 200
    rows = [(3, "u", body), (1, "v\r\nbad: header", body), (2, "w", "short"), (4, None, "short"), (5, "z", None), (6, "z", ""), (7, "e", "é\r\n\r\nWARC/1.1\r\n" * 20), (8, "f", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = new_path(spark, "warc")
    warc.write_archive(pages, path)
    first = {}
    for page, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", page)
    want = {(p, len(b := (h or "").encode()), hashlib.sha256(b).hexdigest(), "revisit" if (rev := len(b) >= 100 and first[h] != p) else "response", first[h] if rev else None) for p, _, h in rows}
    assert set(map(tuple, warc.read_archive(spark, path).collect())) == want
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for *_, h in rows})
    for r in warc.rebuild_records(spark, path).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        html = (dict((p, h) for p, _, h in rows)[r["page_id"]] or "").encode()
        assert head.startswith(b"WARC/1.1\r\n") and rest == (b"" if b"revisit" in head.split(b"\r\n")[1] else html) + b"\r\n\r\n" and bytes(r["payload"]) == html


def test_warc_empty_and_damaged(spark):
    path = new_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0
    bad = new_path(spark, "warc")
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "payload_digest string, payload binary").write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_payloads(spark, bad).collect()


def test_decontamination(frame, spark):
    items = [(k, prose(25)) for k in range(8)] + [(90, None), (91, ""), (92, "too short")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    swapped = items[2][1].split()
    swapped[5], swapped[14] = "changed", "words"
    rows = [(1000, f"{prose(40)} {items[0][1]} {prose(30)}"), (1001, f"{prose(5)}. " + items[1][1].upper().replace(" ", ",  ")), (1002, f"{prose(30)} {' '.join(swapped)}"), (1003, f"{prose(9)} {' '.join(items[3][1].split()[:15])} {prose(9)}"), (1004, prose(300)), (1005, f"{prose(9)} {' '.join(items[4][1].split()[:8])} {prose(9)}"), *ODD]
    df = extra(frame(rows))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()} == {(1000, 0), (1001, 1), (1002, 2), (1003, 3)}
    kept = decontaminate.remove_contaminated(df, bench)
    assert kept.count() == len(rows) - 4 and kept.columns == df.columns
    old, decontaminate.BROADCAST_HASHES = decontaminate.BROADCAST_HASHES, 0  # all by the shuffle
    try:
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()} == {(1000, 0), (1001, 1), (1002, 2), (1003, 3)}
    finally:
        decontaminate.BROADCAST_HASHES = old
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 == decontaminate.contaminated(df.limit(0), bench).count()


def test_decontamination_of_several_passages(frame, spark):
    words = [f"w{k}" for k in range(200)]
    copied = lambda block, gap, n, tag: " ".join(w if k % (block + gap) < block else f"{tag}{k}" for k, w in enumerate(words[: n * (block + gap) - gap]))
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(1, copied(12, 5, 1, "a")), (2, copied(12, 5, 2, "b")), (3, copied(12, 5, 3, "c")), (4, copied(20, 8, 4, "d")), (5, copied(11, 9, 5, "e")), (6, prose(100))]
    out = {r["doc_id"]: (r["matched"], r["aligned"], r["first_word"]) for r in decontaminate.contaminated(frame(rows), bench).collect()}
    assert out == {1: (12, 12, 0), 2: (24, 29, 0), 3: (24, 29, 0), 4: (40, 48, 0)}


def test_widest_segment_against_all():
    r = random.Random(4)
    for _ in range(300):
        same = np.array([r.random() < 0.75 for _ in range(r.randint(0, 40))], bool)
        want = max((int(same[i:j].sum()) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 5 * same[i:j].sum() >= 4 * (j - i)), default=0)
        start, end, equal = decontaminate.widest_segment(same)
        assert equal == want == same[start:end].sum() and 5 * equal >= 4 * (end - start)


def test_variable_length_coding():
    v = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1] * 7, np.uint32)
    for n in range(len(v)):
        control, data = token_ids.encode(v[:n])
        assert len(control) == -(-n // 4) and (token_ids.decode(control, data, n) == v[:n]).all()


def test_token_ids(frame, spark):
    from tokenizers import Tokenizer

    odd_text = "don't İ ß WE'LL ''s <x> 3.14 $5 a b ﬁ K é ...!!"
    rows = [(50 - k, prose(20) + f" {k}, Wörter!") for k in range(20)] + [(99, odd_text), *ODD]
    path = new_path(spark, "ids")
    token_ids.write_ids(extra(frame(rows)), path)
    t = Tokenizer.from_file(token_ids.default_tokenizer())
    ids = [(doc, t.encode(text or "", add_special_tokens=False).ids + [1]) for doc, text, *_ in rows]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    ids.sort(key=lambda r: (r[0] is not None, r[0] or 0, crc(r[1])))
    start, want = 0, []
    for doc, x in ids:
        want.append((doc, start, len(x), crc(x), x))
        start += len(x)
    got = [tuple(r) for r in token_ids.read_ids(spark, path).orderBy("start").collect()]
    assert got == want


def test_token_ids_empty(spark):
    path = new_path(spark, "ids")
    token_ids.write_ids(spark.createDataFrame([], SCHEMA), path)
    assert token_ids.read_ids(spark, path).count() == 0


def brute_components(rows):
    sets, parent = [], list(range(len(rows)))
    for _, text, *_ in rows:
        w = WORD.findall(lower(text))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 3 else zip(w, w[1:], w[2:])))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            same = rows[i][0] == rows[j][0]
            if None not in (rows[i][0], rows[j][0]) and (same or sets[i] and 100 * n >= 90 * len(sets[i] | sets[j])):
                parent[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted((r[0] is None, r[0] or 0, len(s), least.get(find(k)) if r[0] is not None else None) for k, (r, s) in enumerate(zip(rows, sets)))


def test_jaccard_join(frame):
    r = random.Random(11)
    rows, doc = list(ODD), 100
    for _ in range(25):  # small sets, where subsets are enumerated, and large ones, with chains of changes
        words = prose(r.choice([8, 11, 12, 14, 18, 22, 25, 40, 80, 300]), r).split()
        for _ in range(r.randint(1, 6)):
            rows.append((doc, " ".join(words)))
            doc += 1
            words = list(words)
            for _ in range(r.choice([0, 1, 1, 2])):
                k = r.choice([0, len(words) - 1, r.randrange(len(words))])
                words[k : k + 1] = r.choice([[], ["new" + str(r.randrange(99))], [words[k], "more"]])
                words = words or ["left"]
    out = jaccard_join.jaccard_components(extra(frame(rows))).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["n_shingles"], x["component_id"]) for x in out) == brute_components(rows)
    kept = jaccard_join.keep_one(frame(rows))
    assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == sorted({x["component_id"] for x in out if x["component_id"] is not None})


def test_jaccard_join_on_five_words(frame):
    r = random.Random(12)
    rows, doc = list(ODD), 100
    for _ in range(25):
        words = prose(r.choice([2, 3, 4, 5, 6, 9, 14, 18, 22, 25, 40, 80, 300]), r).split()
        for _ in range(r.randint(2, 6)):
            rows.append((doc, " ".join(words)))
            doc += 1
            words = list(words)
            for _ in range(r.choice([0, 1, 1, 2])):
                k = r.choice([0, len(words) - 1, r.randrange(len(words))])
                words[k : k + 1] = r.choice([[], ["new" + str(r.randrange(99))], [words[k], "more"]])
                words = words or ["left"]
    sets = [frozenset([tuple(w)] if 0 < len(w := WORD.findall(lower(x[1]))) < 5 else zip(*(w[j:] for j in range(5)))) for x in rows]
    part = {x[0]: x[0] for x in rows if x[0] is not None}
    links = [(x[0], y[0]) for x, s in zip(rows, sets) for y, t in zip(rows, sets) if None not in (x[0], y[0]) and s and 100 * len(s & t) >= 80 * len(s | t)]
    while any(part[a] != part[b] for a, b in links):
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    out = jaccard_join.jaccard_components(extra(frame(rows)), 5, 80).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(map(key, out)) == sorted(key((x[0], len(s), part.get(x[0]))) for x, s in zip(rows, sets))


def test_subset_sizes_meet_every_threshold():
    for a in range(1, 25):
        for b in range(a, 25):
            o = jaccard_join.least_overlap(a, b)
            if 10 * a >= 9 * b and o <= a:
                assert o in jaccard_join.subset_sizes(a, 24) and o in jaccard_join.subset_sizes(b, 24)
                assert 100 * o >= 90 * (a + b - o) and 100 * (o - 1) < 90 * (a + b - o + 1)


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    r = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60) if k % 7] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(500, k) for k in range(501, 600)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}


def test_language_id(frame):
    words = {"xx": ["ka", "lor", "mip", "tes"], "yy": ["wo", "gün", "hep", "rud"], "zz": ["éa", "qui", "sol", "jeu"]}
    text = lambda k: " ".join("".join(rng.choices(words[k], k=3)) for _ in range(30))
    rows = [(k, text(lang := "xyz"[k % 3] * 2), lang, "a") for k in range(100, 400)] + [(8, None, "xx", "a"), (9, "", "xx", "a"), (10, "12 34 !!", "xx", "a"), (11, text("yy"), None, "a")]
    out = {r["doc_id"]: r for r in langid.languages(extra(frame(rows))).collect()}
    assert all(out[d]["lang_pred"] == "und" and out[d]["score"] == 0 for d in (8, 9, 10)) and out[11]["lang_pred"] == "yy"
    assert np.mean([out[r[0]]["lang_pred"] == r[2] for r in rows[:300] if out[r[0]]["held_out"]]) > 0.95


def test_language_id_without_languages(frame, spark):
    assert {r["lang_pred"] for r in langid.languages(frame([(1, "abc", None, "a")])).collect()} == {"und"}
    assert langid.languages(spark.createDataFrame([], SCHEMA)).count() == 0
