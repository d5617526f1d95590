"""Edges of the corpus operators: names that clash, rows without an id or with a shared one, hot groups, disguises, short items, header injection."""

import collections
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.folders import new_path, scratch, write_shared
from fleetlens.llm import common, decontaminate, jaccard_join, langid, licences, mixing, quality_fm, quality_rules, toxicity, warc
from fleetlens.llm.common import Words, join_groups

from .conftest import ODD, SCHEMA

rng = random.Random(8)
VOCABULARY = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHING = ("_text", "_id", "_src", "_l", "_s", "_size", "_row", "_first", "_taken", "_lang", "_source", "src", "size", "unit", "row", "first", "text_hash", "file_name", "row_index", "part", "epochs", "n_words", "kept", "rid", "th", "rh", "t1", "t2", "words", "key", "n_rows", "bucket", "dotted.name")


def prose(n):
    return " ".join(rng.choices(VOCABULARY, k=n))


def clashing(df):
    """A column of each name that an operator might use inside, with a value of its own in each row."""
    return df.withColumns({c: F.concat_ws("-", F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})


def intact(df):
    return all(r[c] == "-".join([c, *([str(r["doc_id"])] if r["doc_id"] is not None else [])]) for r in df.collect() for c in CLASHING)


def test_passing_columns_keep_their_values(frame, spark):
    docs = clashing(frame([(k, prose(30), "en", "ab"[k % 2]) for k in range(40)] + ODD))
    bench = spark.createDataFrame([(1, prose(20))], "item_id long, text string")
    for out in (mixing.mix_documents(docs), quality_rules.keep_good(docs), jaccard_join.keep_one(docs), decontaminate.remove_contaminated(docs, bench)):
        assert out.columns == docs.columns and out.count() and intact(out)


def test_join_with_more_groups_than_are_sent(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id", "cast(if(id < 400, 0, id % 50) as int) as k")
    groups = write_shared(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("total")).filter("k <> 7"), "groups")
    want = {h: sorted(map(tuple, join_groups(rows, groups, ["k"], h).collect()), key=lambda r: r[:1]) for h in ("inner", "left")}
    monkeypatch.setattr(common, "BROADCAST_GROUPS", 3)
    for how in want:
        assert sorted(map(tuple, join_groups(rows, groups, ["k"], how).collect()), key=lambda r: r[:1]) == want[how]


def test_scratch_removes_what_was_made_inside(spark):
    outer = write_shared(spark.range(3), "outer")
    with scratch(spark):
        inner = write_shared(spark.range(5), "inner").inputFiles()
        assert spark.read.parquet(*inner).count() == 5
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(*inner).count()
    assert outer.count() == 3


def test_mixing_rows_of_a_hot_source_stay_in_buckets(frame, spark, monkeypatch):
    """With no size that Spark would broadcast by itself, budgets still go to the rows, not rows to budgets."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = mixing.sized(frame([(k, prose(k % 7), "en", "hot" if k % 3 else "cold") for k in range(300)]), 17)
        out = mixing.cut(sizes, write_shared(mixing.budgets(sizes), "budgets"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(src" in plan
        for line in plan.split("\n"):  # by source alone: bucket sums only
            if re.search(r"hashpartitioning\(src#\d+, \d+\)", line):
                assert "in_bucket" in plan[plan.index(line) :].split("\n")[1]
        assert out.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mixing_of_repeated_rows_and_null_sources(frame):
    rows = [(1, "a b c d e", "en", "a")] * 7 + [(2, "x y", "en", ""), (2, "x y", "en", None), (None, "p q r", "en", "a"), (None, "p q r", "en", "a")]
    plan, mixed = mixing.mix_plan(frame(rows)), mixing.mix_documents(frame(rows)).collect()
    words = collections.Counter()
    for r in mixed:
        words[r["doc_id"], r["source"]] += len(r["text"].split())
    taken = collections.Counter()
    for r in plan.collect():
        taken[r["doc_id"]] += r["taken"]
    assert len(plan.collect()) == len(rows) and collections.Counter({k: sum(n for (d, _), n in words.items() if d == k) for k in (1, 2, None)}) == +taken
    assert words[2, ""] + words[2, None] == taken[2] and words[2, None] > 0 and all(r["taken"] <= 3 * r["size"] for r in plan.collect())


def test_quality_of_null_and_empty_languages(frame):
    """Stars are common in documents of a null language and rare in those of an empty one: each is judged by its own."""
    starred = lambda n: " ".join(w + "*" * (k < n) for k, w in enumerate(prose(40).split()))
    rows = [(k, starred(rng.randint(8, 20)), None, "a") for k in range(120)] + [(200 + k, starred(0), "", "a") for k in range(120)] + [(400, starred(14), None, "a"), (401, starred(14), "", "a")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(frame(rows), min_rows=50).collect()}
    assert got[400] and not got[401] and all(got[200 + k] for k in range(120))
    kept = {r["doc_id"] for r in quality_rules.verdicts(frame(rows), F.struct("doc_id"), min_rows=50).filter("kept").select("row.*").collect()}
    assert kept == {d for d, k in got.items() if k}


def plain_fence(values, sizes):
    """The fence of a ratio in plain Python, from exact quantiles."""
    v = [np.quantile(values, p, method="inverted_cdf") for p in quality_rules.PLACES]
    noise = quality_rules.NOISE / max(np.quantile(sizes, 0.5, method="inverted_cdf"), 1)
    tail = 2 * v[98] - v[0]
    middle = next(((v[i] + v[i + 1]) / 2 for i in range(99) if v[i + 1] - v[i] > 2 * (v[i] - v[0]) + noise), tail)
    return max(middle, v[0] + noise)


def plain_kept(rows):
    """doc_id to kept, where all rows are one group."""
    good = [r for r in rows if not r["base_failed"]]
    fences = {c: plain_fence([r[c] for r in good], [r[size] for r in good]) for c, size in quality_rules.RATIOS.items()}
    return {r["doc_id"]: not r["base_failed"] and all(r[c] <= fences[c] for c in fences) for r in rows}


@pytest.mark.parametrize("kind", ["smooth", "two populations", "tidy", "long words", "lines"])
def test_quality_fences_against_exact_quantiles(frame, kind):
    """All four ratios of every row; sketches of so few rows are exact."""
    r = random.Random(kind)

    def text(k):
        words = ["".join(r.choices("abcdefghij", k=r.randint(3, 7))) for _ in range(60)]
        if kind == "smooth":
            return " ".join(w + "*" * (r.random() < 0.02 * (k % 9)) for w in words)
        if kind == "two populations":
            return " ".join(w + "***" * (k % 4 == 0) for w in words)
        if kind == "long words":
            return " ".join(w * (3 if k % 10 == 0 else 1) for w in words)
        if kind == "lines":
            return "\n".join(" ".join(words[i : i + 6]) for i in range(0, 60, 6)) + "\nagain" * (k % 12)
        return " ".join(words + words[: 5 if k == 3 else 0] + ["#"] * (k == 5))

    judged = quality_rules.judge(frame([(k, text(k), "en", "a") for k in range(150)]), min_rows=50).collect()
    assert {x["doc_id"]: x["kept"] for x in judged} == plain_kept(judged) and {x["level"] for x in judged if not x["base_failed"]} == {"own"}
    dropped = {x["doc_id"] for x in judged if not x["kept"]}
    assert kind != "two populations" or dropped == set(range(0, 150, 4))
    assert kind != "tidy" or not dropped


def test_sources_with_another_normal_are_judged_apart(frame):
    """Marks are normal in one source and junk in another, of one language; no constant decides."""
    marked = lambda n: " ".join(w + "*" * (k % 60 < n) for k, w in enumerate(prose(60).split()))
    rows = [(k, marked(rng.randint(10, 25)), "en", "marked") for k in range(100)] + [(200 + k, marked(0), "en", "tidy") for k in range(100)]
    rows += [(400, marked(18), "en", "marked"), (401, marked(18), "en", "tidy"), (402, " ".join(w + "****" for w in prose(60).split()), "en", "marked")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(frame(rows), min_rows=50).collect()}
    assert got[400] and not got[401] and not got[402] and all(got[200 + k] for k in range(100)) and sum(got[k] for k in range(100)) == 100


def test_labels_that_contradict(frame, spark):
    """Of several labels of one id the largest counts, in both classifiers."""
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    got = {(r["doc_id"], r["y"]) for r in quality_fm.sample_labelled(frame([(1, "a"), (2, "b"), (None, "c")]), labels, "quality", {1: 9, 0: 9}).collect()}
    assert got == {(1, 1), (2, 0)}


def brute_places(text):
    w = PLAIN.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    phrases = {**licences.BASE, **licences.PHRASES}
    return {phrases[p] for p in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}


def test_licence_labels_of_the_method(frame):
    phrases = [*licences.BASE, *licences.PHRASES]
    rows = [(k, f"{prose(5)}{rng.choice(['. ', chr(10), ' '])}{rng.choice(phrases).replace(' ', rng.choice([' ', '-', ', ']))} {prose(3)} {rng.choice(phrases).title()}", "en", "a") for k in range(80)]
    for r in licences.licence_scan(frame(rows)).collect():
        want = brute_places(rows[r["doc_id"]][1])
        assert r["labels"] == ",".join(sorted(want)) and r["permissive"] is None and r["expression_licences"] == [] and 0 < r["score"] < 1


@pytest.mark.parametrize("tag, names, fine", [("MIT", ["mit"], True), ("mitre-corp", ["mitre-corp"], False), ("Apache-2.0 OR GPL-2.0-only", ["apache-2.0", "gpl-2.0-only"], True), ("BSD-3-Clause AND GPL-3.0", ["bsd-3-clause", "gpl-3.0"], False), ("(MIT", ["mit"], False), ("MIT */ int x;", ["mit"], True)])
def test_licence_tags(tag, names, fine):
    n, places, tags = licences.scan(f"// SPDX-License-Identifier: {tag}\nrest".encode(), licences.automaton())
    assert [(sorted(t[0]), t[1]) for t in tags] == [(names, fine)]


def test_licence_tags_in_one_long_line_take_linear_time():
    auto, took = licences.automaton(), []
    for n in (4000, 16000):
        began = time.process_time()
        assert len(licences.scan(b"spdx-license-identifier: MIT OR X; " * n, auto)[2]) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


@pytest.fixture(scope="module")
def decoder():
    text = " ".join(rng.choices(["the", "idiot", "moron", "stupid", "loser", "you", "are", "and", "well", "known", "of", "on", "in", "is", "it", "people", "letter", "coffee"], k=4000)).encode()
    c = toxicity._CLASS[np.frombuffer(text, np.uint8)]
    counts = np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3).reshape(28, 28, 28)
    return toxicity.Decoder(toxicity.costs(counts))


def all_hashes(text, decoder):
    return set(toxicity.text_features(pa.array([text]), decoder)[1].tolist())


@pytest.mark.parametrize("form, word", [
    ("mo-ron", "moron"), ("id-i-ot", "idiot"), ("st*upid", "stupid"), ("iiddiioott", "idiot"), ("10$3r", "loser"), ("idio+", "idiot"), ("idi\u00f6t", "idiot"), ("ST\u00dcPID", "stupid"), ("st" + "u" * 45 + "pid", "stupid"),
    ("\uff49\uff44\uff49\uff4f\uff54", "idiot"), ("m.o.r.o.n", "moron"), ("1d10t", "idiot"), ("stuupid", "stupid"), ("i d i o t", "idiot"), ("x " + "y o u " * 30 + "m o r o n", "moron"), ("st.up.id" + "-people" * 40, "stupid"), ("l\n0\ns\ne\nr", "loser"),
])
def test_disguises_are_restored(form, word, decoder):
    want = all_hashes(word, decoder)
    assert want - {0} <= all_hashes(f"some {form} here", decoder)


def brute_decode(token, decoder):
    """The cheapest of all readings."""
    best = (np.inf, "")
    for way in itertools.product(*toxicity.readings(token)):
        total, a, b = 0.0, 0, 0
        for letter, extra in way:
            total += extra
            if letter and not (letter == " " and not b):
                c = ord(letter) - 96 if letter != " " else 0
                total += decoder.cost[a][b][c]
                a, b = b, c
        best = min(best, (total + (decoder.cost[a][b][0] if b else 0.0), "".join(x for x, _ in way)))
    return best[1]


def test_viterbi_against_all_readings(decoder):
    r = random.Random(6)
    for _ in range(60):
        token = "".join(r.choice("i1d0t$a-.|e3ss") for _ in range(r.randint(1, 8)))
        assert decoder.decode(token).split() == brute_decode(token, decoder).split()


def test_plain_and_numeric_tokens_are_no_disguises():
    w = Words(pa.array(["coffee 2024-01-05 x1 12,345 word. (see) \u00e9t\u00e9 end### a b"]), "space")
    assert [w.bytes[a:b].tobytes().decode() for _, a, b, _ in zip(*toxicity.disguised(w))] == ["(see"]


def test_long_spaced_run_in_bounded_memory(decoder):
    text = " ".join(random.Random(1).choices("abcdefgh", k=60_000))
    assert len(all_hashes(text, decoder)) > 60_000


def test_warc_urls_cannot_add_headers(spark):
    ends = ["\r\n", "\n", "\r", "\u0085", "\u2028", "\u2029", "\x0b", "\x0c"]
    bad = [f"u{e}WARC-Refers-To: <urn:page:77>{e}WARC-Payload-Digest: sha256:{'0' * 64}{e}WARC-Type: revisit{e}X-Payload-Length: 5{e}" for e in ends]
    rows = [(k, url, "body %d" % k) for k, url in enumerate(bad)] + [(50, "u", "long " * 400_000), (50, "u", "long " * 400_000), (51, "v", "long " * 400_000), (None, "w", "long " * 400_000), (None, "w", "z" * 150)]
    path = new_path(spark, "warc")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted(((r["page_id"] is None, r["page_id"] or 0), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, path).collect())
    assert got[: len(bad)] == [((False, k), 6, "response", None) for k in range(len(bad))]
    assert got[len(bad) : -1] == [((False, 50), 2_000_000, "response", None)] * 2 + [((False, 51), 2_000_000, "revisit", 50), ((True, 0), 150, "response", None)]
    assert got[-1] == ((True, 0), 2_000_000, "revisit", 50)
    heads = [bytes(r["record"]).partition(b"\r\n\r\n")[0] for r in warc.rebuild_records(spark, path).collect()]
    assert len(heads) == len(rows) and all(re.search(rb"\r\nWARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", h) for h in heads)


def brute_contaminated(docs, items):
    """Every item at every offset of every text, by the two limits."""
    out = set()
    for doc, text in docs:
        d = PLAIN.findall((text or "").lower())
        for item, t in items:
            b = PLAIN.findall((t or "").lower())
            least = min(12, int(np.ceil(0.9 * len(b)))) if b else np.inf
            for shift in range(-len(b) + 1, len(d)):
                same = np.array([d[k + shift] == b[k] for k in range(len(b)) if 0 <= k + shift < len(d)], bool)
                if same.sum() >= least and decontaminate.widest_segment(same)[2] >= least:
                    out.add((doc, item))
    return out


def test_decontamination_against_all_offsets(frame, spark):
    r = random.Random(9)
    items = [(k, prose(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 12, 20, 30]))) for k in range(22)]
    rows = []
    for k in range(60):
        words = items[r.randrange(22)][1].split()
        if len(words) >= 12:
            for j in r.sample(range(len(words)), len(words) // 10):
                words[j] = "other"
        cut = r.choice([len(words), len(words), max(1, len(words) - 3)])
        rows.append((k, f"{' '.join(r.choices(['x%d' % j for j in range(90)], k=20))} {' '.join(words[:cut])} tail{k}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contaminated(rows, items)
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(frame(rows), bench).collect()}
    assert got == want and {len(dict(items)[i].split()) for _, i in got} >= {1, 3, 6, 7, 20}
    kept = {x["doc_id"] for x in decontaminate.remove_contaminated(frame(rows), bench).collect()}
    long = {d for d, i in want if len(dict(items)[i].split()) >= 3}
    assert long.isdisjoint(kept) and set(range(60)) - {d for d, _ in want} <= kept


def test_decontamination_by_rows(frame, spark):
    item = prose(25)
    rows = [(None, f"{prose(9)} {item}"), (None, prose(40)), (7, f"{prose(9)} {item}"), (7, prose(41)), (8, item), (8, item)]
    out = decontaminate.remove_contaminated(frame(rows), spark.createDataFrame([(1, item), (None, item)], "item_id long, text string"))
    assert sorted((r["doc_id"] or 0, len(r["text"].split())) for r in out.collect()) == [(0, 40), (7, 41)]


def test_one_of_each_group_by_rows(frame):
    a, b = prose(60), prose(60)
    near = " ".join(a.split()[:-1] + ["changed"])
    rows = [(1, a), (1, b), (2, near), (3, b), (None, b), (None, prose(50)), (4, prose(50)), (4, prose(50)), (5, None), (5, ""), (6, a), (6, a)]
    out = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"] or "") for r in jaccard_join.keep_one(frame(rows), 5, 80).collect())
    assert [d for d, _ in out] == [(False, 1), (False, 1), (False, 4), (False, 4), (False, 5), (False, 5), (True, 0)]
    assert {t for d, t in out if d == (False, 1)} == {a, b}
    again = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"] or "") for r in jaccard_join.keep_one(frame(rows, 5), 5, 80).collect())
    assert again == out


def test_codewords_stay_apart():
    for n in (2, 4, 8, 30, 60, 200):
        code = langid.codebook(n)
        apart = (code.shape[1] - (code @ code.T)[~np.eye(n, dtype=bool)].max()) / 2
        assert apart >= 5, (n, apart)


def test_language_id_edges(frame):
    words = {"xx": ["ka", "lor", "mip", "tes"], "yy": ["wo", "g\u00fcn", "hep", "rud"]}
    text = lambda k: " ".join("".join(rng.choices(words[k], k=3)) for _ in range(30))
    rows = [(k, text(lang := "xy"[k % 2] * 2), lang, "a") for k in range(100, 300)]
    stray = [(1000 + k, prose(3), f"stray {k}", "a") for k in range(30)]
    twice = (999, text("xx"), "xx", "a")
    long = (998, text("yy") + " " + " ".join(text("yy") for _ in range(4000)), "yy", "a")
    short = [(2000 + k, "ka", "xx", "a") for k in range(600)]
    out = collections.defaultdict(list)
    for r in langid.languages(frame(rows + stray + [twice, twice, long] + short + ODD)).collect():
        out[r["doc_id"]].append(r)
    assert out[998][0]["lang_pred"] == "yy" and len(out[999]) == 2 and out[999][0] == out[999][1] and out[999][0]["lang_pred"] == "xx"
    assert {len(out[d]) for d in (1, 2, 3)} == {1} and all(out[d][0]["lang_pred"] == "und" and not out[d][0]["ambiguous"] for d in (1, 2, 3))
    assert langid.train(frame(rows + stray), least_texts=2).langs == ["xx", "yy"]
    assert len(langid.train(frame(rows + stray)).langs) > 20  # one text of each is learned


def test_losses_are_those_of_the_definition():
    """Against the sum over bits, weighted, of log(1 + exp(-margin * code))."""
    rng_ = np.random.default_rng(3)
    code = langid.codebook(5)
    coder = langid.Coder(list("abcde"), code, rng_.normal(size=(7, code.shape[1])), rng_.normal(size=code.shape[1]), rng_.random(code.shape[1]))
    x = rng_.normal(size=(9, 7))
    margin = x @ coder.weight + coder.bias
    want = [[sum(t * np.log1p(np.exp(-m * c)) for t, m, c in zip(coder.trust, row, word)) for word in code] for row in margin]
    assert np.allclose(coder.losses(x), want)


def test_codewords_grow_with_the_languages():
    code = langid.codebook(3000)
    assert len({tuple(c) for c in code.tolist()}) == 3000 and code.shape[1] == langid.code_bits(3000)


def test_samples_are_bounded_by_rows(frame, spark):
    """Thousands of copies of one row count once, in all three classifiers; ids with many texts do not stretch a sample."""
    rows = [(7, prose(5), "xx", "a")] * 3000 + [(8, f"{prose(4)} {k}", "yy", "a") for k in range(500)] + [(9, prose(6), "yy", "a")]
    labels = spark.createDataFrame([(k, 1) for k in (7, 8, 9)], "doc_id long, quality int")
    docs = frame(rows)
    drawn = quality_fm.sample_labelled(docs, labels, "quality", {1: 20, 0: 20})
    assert drawn.count() == 20 and drawn.select("doc_id", "text").distinct().count() == 20


def test_ambiguous_text_is_flagged():
    x = np.eye(langid.SLOTS, dtype=np.float32)[[1] * 20 + [2] * 20]
    coder = langid.fit(x, ["aa"] * 20 + ["bb"] * 20)
    loss = coder.losses(np.stack([x[0], x[-1], (x[0] + x[-1]) / 2]))
    assert loss[0, 0] < loss[0, 1] and loss[1, 1] < loss[1, 0] and abs(loss[2, 0] - loss[2, 1]) < 0.3 * abs(loss[0, 0] - loss[0, 1])


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (quality_rules.keep_good(none), licences.licence_scan(none), toxicity.toxicity(none, labels), jaccard_join.keep_one(none), mixing.mix_documents(none), decontaminate.remove_contaminated(none, spark.createDataFrame([], "item_id long, text string"))):
        assert out.count() == 0
