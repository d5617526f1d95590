"""HTML extraction by minimum-cut labelling: which text blocks of a page are its article.

A page is read once into text blocks, each with what its containers, classes, links and wording say of it. A linear classifier
turns that into a cost of calling the block boilerplate (if it speaks for content) or content (if against): the capacity of
its edge to the source or the sink. Neighbouring blocks, and blocks of one container, are joined by smoothness edges, which
cost their capacity where the two ends get different labels. The cheapest labelling is a minimum cut. Blocks whose own cost
outweighs all their edges are settled first, which is exact; what is left goes to maximum flow (level graphs, blocking flows).
Of equal cuts the one with least content is taken.

Text is what a browser shows of it: comments, declarations, scripts, styles, titles and other raw elements are never text,
character references are decoded once, white space (of str.split) inside a block is one space, `<br>` is white space. Blocks
are cut at block-level tags; missing and stray end tags are tolerated (a block-level start ends an open paragraph, an end tag
closes what it holds). All steps are linear in the page but the flow, which runs on undecided blocks only.

Every page is worked on by itself: nothing is shuffled or broadcast. Defined results: null, empty, and text-free pages have
an empty text of 0 code points; a page without markup is one block, judged as any; repeated rows and shared or null ids are
rows of their own; an empty table gives no rows; columns besides page_id, url and html are ignored; nothing is cut short.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# Names of HTML elements. Block-level ones end a text block; raw ones hold no markup, and no text of the page.
BLOCK = set("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
#: A start tag of the first kind ends an open element of the second, up to an element of the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that a paragraph does not hold, so that they end it, are all block-level ones but these.
IN_PARAGRAPH = {"button", "canvas", "noscript", "option", "select", "svg", "template"}
#: Elements that are no part of an article, and those that are one.
OUTSIDE = set("nav footer aside form menu dialog button select option fieldset legend noscript template svg canvas head".split())
INSIDE = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
# Words of class names and ids.
JUNK = set(
    "nav navbar navigation menu sidebar aside footer ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices notification alert comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar copyright disclaimer masthead teaser skip search outbrain taboola trending hidden print".split()
)
GOOD = set("article content post entry story main body text prose blog".split())
#: A class name with one of these speaks of what the element has, not of what it is.
HAS = {"has", "with", "no", "without", "is"}

#: The classifier: what a block's signs are worth (above 0: content). The first that holds of each group counts.
BIAS = -0.4
WEIGHT = {"outside": -12.0, "header": -8.0, "inside": 5.0, "good": 3.0, "links": -5.0, "paragraph": 1.2, "heading": 0.6, "item": -0.6, "words": 0.1, "sentence": 1.0, "stub": -1.2}
MOST_FOR_WORDS = 2.5
#: Smoothness: capacity between neighbouring blocks of one container, of different ones, and between the next two of one container.
NEAR, FAR, SIBLING = 0.8, 0.25, 0.5
#: Capacities are whole numbers of this part of 1.
UNIT = 1000

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>"']*)""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BARE_HIDDEN = re.compile(r"""\shidden(?=[\s/=]|$)|\saria-hidden\s*=\s*["']?true""", re.I)
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


class Container:
    """An open element: its place on the stack says what holds of all blocks in it."""

    __slots__ = ("name", "number", "outside", "inside", "good", "header", "paragraph", "heading", "item", "link_before")

    def __init__(self, name: str, number: int, parent: Container | None, attributes: str):
        self.name, self.number = name, number
        for sign in ("outside", "inside", "good", "header"):
            setattr(self, sign, getattr(parent, sign) if parent else False)
        self.paragraph = name in {"p", "pre", "blockquote"}
        self.heading = name in {"h1", "h2", "h3", "h4", "h5", "h6"}
        self.item = name in {"li", "td", "th", "dt", "dd", "figcaption", "caption"}
        self.link_before = False
        if name in INSIDE:
            self.inside = True
        if name in OUTSIDE:
            self.outside = True
        if name == "header" and not (self.inside or self.good):
            self.header = True
        if attributes and name not in {"html", "body"}:
            self.read(attributes)

    def read(self, attributes: str) -> None:
        if BARE_HIDDEN.search(attributes):
            self.outside = True
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                self.outside |= value.strip().lower() in ROLES
                self.inside |= value.strip().lower() in {"main", "article"}
            elif key == "style":
                self.outside |= bool(HIDDEN.search(value))
            elif key in {"class", "id"}:
                for word in value.split():
                    parts = {p.lower() for p in PART.findall(word)}
                    if parts & HAS and len(parts) > 1:
                        continue
                    if parts & JUNK and (self.name not in INSIDE or len(parts) == 1):
                        self.outside = True
                    elif "header" in parts and not (self.inside or self.good or parts & GOOD):
                        self.header = True
                    elif parts & GOOD:
                        self.good = True


class Page:
    """The text blocks of a page: text, container, and score of the classifier."""

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.holders: list[int] = []
        self.scores: list[float] = []
        self.stack = [Container("", 0, None, "")]
        self.open: dict[str, int] = {}
        self.made = 0
        self.link = False
        self.pieces: list[tuple[str, bool]] = []
        self.parse(html)
        self.flush()

    def flush(self) -> None:
        if not self.pieces:
            return
        text = " ".join("".join(p for p, _ in self.pieces).split())
        if text:
            linked = sum(len("".join(p.split())) for p, link in self.pieces if link)
            self.texts.append(text)
            self.holders.append(self.stack[-1].number)
            self.scores.append(score(text, linked / max(1, len(text.replace(" ", ""))), self.stack[-1]))
        self.pieces = []

    def start(self, name: str, attributes: str) -> None:
        if name == "a":
            self.link = "href" in attributes.lower()
        elif name == "br":
            self.pieces.append((" ", False))
        elif name in BLOCK:
            self.flush()
            if name in VOID:
                return
            if self.open.get("p") and name not in IN_PARAGRAPH:
                self.close("p")
            if name in IMPLIED:
                ended, bounds = IMPLIED[name]
                for k in range(len(self.stack) - 1, max(0, len(self.stack) - 9), -1):  # as deep as such elements nest
                    if self.stack[k].name in bounds:
                        break
                    if self.stack[k].name in ended:
                        self.cut(k)
                        break
            self.made += 1
            holder = Container(name, self.made, self.stack[-1], attributes)
            holder.link_before = self.link
            self.stack.append(holder)
            self.open[name] = self.open.get(name, 0) + 1

    def cut(self, k: int) -> None:
        """Close the k-th open element and all inside."""
        self.flush()
        while len(self.stack) > k:
            gone = self.stack.pop()
            self.open[gone.name] -= 1
            self.link = gone.link_before

    def close(self, name: str) -> None:
        if name == "a":
            self.link = False
        elif name in BLOCK:
            self.flush()
            if self.open.get(name):
                k = len(self.stack) - 1
                while self.stack[k].name != name:
                    k -= 1
                self.cut(k)

    def parse(self, html: str) -> None:
        at, size = 0, len(html)
        last = {quote: html.rfind(quote) for quote in "\"'"}
        while at < size:
            to = html.find("<", at)
            to = size if to < 0 else to
            if to > at:
                piece = html[at:to]
                self.pieces.append((unescape(piece) if "&" in piece else piece, self.link))
            if to == size:
                return
            m = TAG.match(html, to)
            if not m:
                if html.startswith("<!--", to):
                    end = html.find("-->", to + 4)
                    at = size if end < 0 else end + 3
                elif html[to + 1 : to + 2] in {"!", "?", "/"}:
                    end = html.find(">", to)
                    at = size if end < 0 else end + 1
                else:  # a sign, not a tag
                    self.pieces.append(("<", self.link))
                    at = to + 1
                continue
            end = self.tag_end(html, m.end(), last)
            name, attributes = m[2].lower(), html[m.end() : end]
            at = end + 1
            if m[1]:
                self.close(name)
            else:
                self.start(name, attributes)
                if name in RAW:
                    closing = ENDS[name].search(html, at)
                    at = size if not closing else closing.start()

    @staticmethod
    def tag_end(html: str, at: int, last: dict[str, int]) -> int:
        """Where the tag's `>` is; quoted values may hold others. A quote that is never closed is a sign like others."""
        while True:
            end = html.find(">", at)
            if end < 0:
                return len(html)
            quotes = [(k, q) for q in "\"'" if 0 <= (k := html.find(q, at, end)) and html[max(at, k - 9) : k].rstrip()[-1:] == "="]
            if not quotes:
                return end
            k, q = min(quotes)
            if last[q] == k:
                at = k + 1
            else:
                at = html.find(q, k + 1) + 1


def score(text: str, linked: float, holder: Container) -> float:
    """The classifier: above 0 for content. linked: the share of the block's characters in links."""
    n_words = text.count(" ") + 1
    sentence = bool(SENTENCE.search(text))
    out = BIAS
    out += WEIGHT["outside"] if holder.outside else WEIGHT["header"] if holder.header else WEIGHT["inside"] if holder.inside else WEIGHT["good"] if holder.good else 0
    out += WEIGHT["paragraph"] if holder.paragraph else WEIGHT["heading"] if holder.heading else WEIGHT["item"] if holder.item else 0
    out += WEIGHT["links"] * linked + min(MOST_FOR_WORDS, WEIGHT["words"] * n_words)
    return out + (WEIGHT["sentence"] if sentence else WEIGHT["stub"] if n_words < 6 and not holder.heading else 0)


def edges_of(holders: list[int]) -> list[tuple[int, int, int]]:
    """Smoothness edges (block, later block, capacity): neighbours on the page, and the next two of one container."""
    out = [(i, i + 1, round(UNIT * (NEAR if holders[i] == holders[i + 1] else FAR))) for i in range(len(holders) - 1)]
    last: dict[int, int] = {}
    for i, h in enumerate(holders):
        if h in last and last[h] < i - 1:
            out.append((last[h], i, round(UNIT * SIBLING)))
        last[h] = i
    return out


def least_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it is on the source's side of the minimum cut with the fewest nodes there.

    costs: capacity from the source (above 0) or to the sink (below); edges are undirected.
    """
    costs, n = list(costs), len(costs)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    around = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if side[v] is not None or not (costs[v] > around[v] or -costs[v] >= around[v]):
            continue
        side[v] = costs[v] > around[v]
        for u, c in near[v].items():
            if side[u] is None:
                costs[u] += c if side[v] else -c
                around[u] -= c
                todo.append(u)
    left = [v for v in range(n) if side[v] is None]
    if left:
        number = {v: k for k, v in enumerate(left)}
        kept = [(number[a], number[b], c) for a in left for b, c in near[a].items() if a < b and side[b] is None]
        for v, yes in zip(left, reachable([costs[v] for v in left], kept)):
            side[v] = yes
    return [bool(x) for x in side]


def reachable(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The nodes that a source reaches when the flow is greatest (level graphs and blocking flows)."""
    n = len(costs)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def add(a: int, b: int, forth: int, back: int) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forth)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for v, c in enumerate(costs):
        add(source, v, c, 0) if c > 0 else add(v, sink, -c, 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in heads[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                most = min(room[e] for e in path)
                for e in path:
                    room[e] -= most
                    room[e ^ 1] += most
                k = next(k for k, e in enumerate(path) if not room[e])
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[v] < len(heads[v]):
                e = heads[v][turn[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            if turn[v] < len(heads[v]):
                path.append(heads[v][turn[v]])
                v = to[path[-1]]
            elif v == source:
                break
            else:
                v = to[path.pop() ^ 1]
                turn[v] += 1


def extract(html: str) -> tuple[str, int, int]:
    """The main text of a page, its number of blocks, and how many of them the text has."""
    page = Page(html)
    keep = least_cut([round(UNIT * s) for s in page.scores], edges_of(page.holders))
    kept = [t for t, k in zip(page.texts, keep) if k]
    return "\n\n".join(kept), len(page.texts), len(kept)


SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page's article; n_blocks and n_kept: text blocks of the page and of the article."""

    def each(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                rows = [extract(html or "") for html in part.column("html").to_pylist()]
                texts = [r[0] for r in rows]
                figures = [pa.array([f(r) for r in rows], pa.int64()) for f in (lambda r: len(r[0]), lambda r: r[1], lambda r: r[2])]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), *figures], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return pages.selectExpr("CAST(page_id AS long) AS page_id", "CAST(url AS string) AS url", "html").mapInArrow(each, SCHEMA)
