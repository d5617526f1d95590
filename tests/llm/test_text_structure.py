"""Main text, spelling variants and periodic runs against brute force, with nulls, empty and long rows, ties, repeats, clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import main_text, periodic_runs, spelling

from .conftest import ODD

PAGES = "page_id long, url string, html string"


def extra(df):
    return df.withColumns({c: F.lit(1) for c in ("size", "row", "key", "n", "word", "id", "part", "start", "h", "cut")})


# --- main text


def cut_cost(costs, edges, x):
    return sum((c if not k else 0) if c > 0 else (-c if k else 0) for c, k in zip(costs, x)) + sum(w for a, b, w in edges if x[a] != x[b])


def test_least_cut_is_the_smallest_of_the_cheapest_labellings():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 9)
        costs = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 4)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        every = list(itertools.product((0, 1), repeat=n))
        best = min(cut_cost(costs, edges, x) for x in every)
        want = min((x for x in every if cut_cost(costs, edges, x) == best), key=sum)
        assert tuple(map(int, main_text.least_cut(costs, edges))) == want


def test_a_long_chain_of_undecided_blocks():
    n = 20000
    costs = [(-1) ** (k // 7) * 300 for k in range(n)]
    edges = [(k, k + 1, 800) for k in range(n - 1)]
    got = main_text.least_cut(costs, edges)
    best = {0: 0, 1: 0}  # cost by the label of the last block
    for k, c in enumerate(costs):
        own = {0: max(c, 0), 1: max(-c, 0)}
        best = {x: own[x] + min(best[y] + (800 if k and x != y else 0) for y in (0, 1)) for x in (0, 1)}
    assert cut_cost(costs, edges, got) == min(best.values())


WRITTEN = {
    "soup": (
        '<div class="header"><h2>Site</h2></div><div class="menu"><a href=/a>A</a> <a href=/b>B</a></div><div id="content"><h1>Title</h1><div class="byline">By Jo Doe</div><p>The first paragraph has many words, and goes on.'
        '<div class="ad">Buy this fine product today.</div><p>Second&nbsp;one &amp; &lt;more&gt;.<ul><li>point one<li>point two</ul></div><div id="comments"><article class="comment"><p>I think that this is a great article, thank you.</p></article></div>'
        '<div class="cookie-notice"><p>We use cookies to make your visit here better.</p></div><div id="footer">Copyright 2020</div>',
        "Title\n\nBy Jo Doe\n\nThe first paragraph has many words, and goes on.\n\nSecond one & <more>.\n\npoint one\n\npoint two",
    ),
    "no hints": (
        "<div><a href=1>Home</a> | <a href=2>News</a></div><div><p>Plain text is long enough to be content. It has sentences.</p><p>More of it follows here, as one would think.</p></div><div>Imprint 2024</div>",
        "Plain text is long enough to be content. It has sentences.\n\nMore of it follows here, as one would think.",
    ),
    "forms": ("<main><h1>T</h1><p>Short.</p><aside><p>Aside text that is long and ends as a sentence.</p></aside><form><label>Name</label><input><button>Send</button></form></main>", "T\n\nShort."),
    "article parts": (
        '<header><p>Site of some note.</p></header><article class="post has-comments"><header><h1>Title</h1><p class="meta">Posted on May 3</p></header><p>Body <b>bold<i>er</b> text.<br>Next</i> line</p><footer>Tags: a, b</footer></article>',
        "Title\n\nPosted on May 3\n\nBody bolder text. Next line",
    ),
    "raw": ("<title>No</title><article><p>a &amp;amp; b</p><script>if (a<b) { '<p>x</p>' }</script><style>p{}</style><!-- <p>gone</p> --><p>1 < 2 and so it ends.</p></article><script>never closed", "a &amp; b\n\n1 < 2 and so it ends."),
    "hidden": ('<article><p>Seen text of an article.</p><div style="display: none"><p>Unseen text of an article.</p></div><p hidden>Unseen too.</p></article>', "Seen text of an article."),
    "blank": (" <p> </p>\n", ""),
}


@pytest.mark.parametrize("name", WRITTEN)
def test_written_pages(name):
    html, want = WRITTEN[name]
    assert main_text.extract(html)[0] == want


def test_main_text_of_odd_tables(spark):
    long_page = "<article>" + "<p>A sentence of the text.</p>" * 20000 + "</article><footer>x</footer>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<article><p>One two.</p></article>"), (3, "w", "<article><p>One two.</p></article>"), (3, "w", "<article><p>One two.</p></article>"), (4, "x", long_page)]
    got = main_text.main_text(extra(spark.createDataFrame(rows, PAGES))).collect()
    texts = collections.Counter((r.page_id, r.url, r.text if len(r.text) < 99 else "long", r.n_chars) for r in got)
    long_text = 20000 * len("A sentence of the text.") + 2 * 19999
    assert texts == {(1, "u", "", 0): 1, (2, None, "", 0): 1, (None, "v", "One two.", 8): 1, (3, "w", "One two.", 8): 2, (4, "x", "long", long_text): 1}
    assert main_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("html", ['<a "' * 50000, "<div>" * 50000, '<a b="' * 50000, "<a b='>" * 50000, "<!-- " * 50000, "<li>" * 50000, "&lt" * 50000, "</p>" * 50000])
def test_broken_pages_take_linear_time(html):
    assert main_text.extract(html)[1] <= 1


# --- spelling variants


def variants(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {w: best for w in words if near[w] and words[best := min(near[w], key=lambda v: (-words[v], v))] >= 2 * words[w]}
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return out


def test_spelling_variants_equal_brute_force(spark, frame, monkeypatch):
    rng = random.Random(8)
    stems = ["".join(rng.choices("abé", k=rng.randint(5, 9))) for _ in range(30)] + ["aaaaa", "aaaaaa", "aaaaaaa", "caaaaa", "prefix", "prefixe", "prefixes", "Ÿzzzzz", "×÷×÷×"]
    rows = [*ODD_ROWS, (7, "lmnop " * 3 + "lmnopq " * 7 + "lmnopqr " * 20)]
    for doc in range(60):
        words = []
        for _ in range(60):
            w = list(rng.choice(stems))
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "b", "x", "Ab"])
            words.append("".join(w))
        rows.append((rng.choice([doc, doc, None]), rng.choice([" ", ", ", "_9"]).join(words)))
    got = [tuple(r) for r in spelling.spelling_variants(extra(frame(rows, 5))).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = variants(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)


ODD_ROWS = [(r[0], r[1]) for r in ODD]


def test_nodes_are_numbered_alike_in_all_parts(spark):
    """Prefixes that go over the borders of many parts have one number each; numbers grow with the words."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(400)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for backwards in (False, True):
        rows = spelling.numbered(df.repartition(3), backwards).collect()
        node_of, prefix_of = {}, {}
        for r in rows:
            key = r.word[::-1] if backwards else r.word
            for k, node in enumerate(r.nodes):
                assert node_of.setdefault(key[:k], node) == node and prefix_of.setdefault(node, key[:k]) == key[:k]
        last = [r.nodes[-1] for r in sorted(rows, key=lambda r: r.word[::-1] if backwards else r.word)]
        assert last == sorted(last) and len(rows) == len(words)


def test_spelling_variants_of_empty_and_long(spark, frame):
    assert spelling.spelling_variants(frame([], 1)).count() == 0
    assert spelling.spelling_variants(frame([(1, "rare words only here")])).count() == 0
    word = "ab" * 5000
    rows = [(1, f"{word} {word} {word}"), (2, f"{word}c {word}c {word}c {word}c {word}c {word}c")]
    got = spelling.spelling_variants(frame(rows)).collect()
    assert {tuple(r) for r in got} == variants(rows) and len(got) == 2


# --- periodic runs


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s = words[i : j + q]
            if len(s) >= max(24, 3 * q) and not any(s[d:] == s[: len(s) - d] for d in range(1, q)):
                out.append((i, len(s), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {k for a, size, q in found for k in range(a + q, a + size)}
    best = None
    for a, size, q in found:
        if best is None or size * best[2] > best[1] * q:
            best = (a, size, q)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *figures, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_periodic_runs_equal_brute_force(spark, frame):
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in ODD if r[1] is None or len(r[1]) < 1000]
    rows += [(101, " ".join(fibonacci(400))), (102, " ".join("ab"[bin(i).count("1") % 2] for i in range(400))), (103, "x " * 24), (104, "x " * 23), (105, "a b c d e f g h " * 3), (106, "a b c d e f g h " * 2 + "a b c d e f g")]
    for doc in range(250):
        n, k = rng.randint(0, 350), rng.choice([1, 2, 3, 60])
        words = [str(rng.randrange(k)) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 30 else 0):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            for i in range(a + p, min(n, a + int(p * rng.uniform(2.5, 6)))):
                words[i] = words[i - p]
        rows.append((rng.choice([doc, doc, doc, None]), rng.choice([" ", "\n", " \t"]).join(words)))
    rows += rows[-3:]
    got = [tuple(r) for r in periodic_runs.periodic_runs(extra(frame(rows, 4))).collect()]
    assert collections.Counter(got) == collections.Counter(brute_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 60 and any(r[1] > 0 and r[4] > periodic_runs.SHORT for r in got)


def test_long_periods_and_long_texts(frame):
    rng = random.Random(6)
    block = [str(rng.randrange(10**6)) for _ in range(20000)]
    words = block[:5] + block * 3 + block[:777] + ["end"]
    rows = [(3, " ".join(words)), (5, "a b " * 60000)]
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period) for r in periodic_runs.periodic_runs(frame(rows)).collect()}
    assert got == {3: (1, 5, 60777, 20000), 5: (1, 0, 120000, 2)}


def test_periodic_runs_of_an_empty_table(frame):
    assert periodic_runs.periodic_runs(frame([], 1)).count() == 0
