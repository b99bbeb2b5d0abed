"""Main text of web pages by a tree-structured graphical model over the DOM.

Nodes are the block elements of a page and, as leaves, the runs of text between their
boundaries. Each has a label, content or not. The model has a weight for each piece of evidence at a
node (its tag, the words of its class, id, role and itemprop, how much text it holds and how
much of it in links, how a leaf ends) and a potential for the labels of parent and child.
Sum-product messages go from the leaves up and from the root down, which yields every node's
exact marginal; leaves of a marginal of one half or more are the text. Pages of a batch are one
forest, and all nodes of a depth pass their messages at once.

Weights maximise the likelihood of labelled pages, whose gradient are the same marginals: the
layouts of labelled_layouts in several fillings, and at most DECLARED_PAGES pages of the table
itself (those of least hash, of up to DECLARED_CHARS characters) that say what their main text is, by one
<article> or <main> in which nothing has a name. The fit is of that fixed size; extraction reads every page whole.

Scripts, styles, comments, the head, form controls and what a browser does not show are never text.
A <br> is white space. Null or empty html gives an empty text, repeated rows give rows each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .labelled_layouts import LAYOUTS

# Elements by what HTML says of them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript svg math iframe object applet canvas audio video map title select textarea button datalist option optgroup noframes".split())
IN_HEAD = frozenset("base basefont bgsound link meta title script style template noscript noframes".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
NAMED_BY = ("class", "id", "role", "itemprop")
PROSE = frozenset(["", *"html head title p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd script style".split()])
OUTSIDE = frozenset("nav aside footer form".split())

#: Pages of the table that take part in the fit, at most, and the longest of them.
DECLARED_PAGES, DECLARED_CHARS = 30, 50_000
#: Steps of the fit and the weight of its penalty on squares.
STEPS, PENALTY = 400, 0.02
#: Log-odds taken as certain.
SURE = 60.0
#: Shortest known name that a longer, unknown one is read as.
STEM = 5
#: Characters of pages whose trees are one forest.
FOREST_CHARS = 2_000_000

_PART = re.compile(r"[A-Za-z][a-z]*|[^\W\d_]+")
_SENTENCE_END = tuple(".!?:;…。！？\"”»)")


class Page(HTMLParser):
    """The tree of a page. Per node: parent, tag ('' for a leaf), its names, words, words in links, text, label, hidden."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.names, self.words, self.linked, self.texts, self.label, self.hidden = [-1], ["html"], [()], [0], [0], [None], [0], [False]
        self.open, self.opened, self.depth, self.leaf, self.in_link = [0], Counter(), [0], -1, False
        self.feed(html)
        self.close()
        self.bare = PROSE.issuperset(self.tag)  # a page of text alone
        for i in range(len(self.tag) - 1, 0, -1):
            if not self.tag[i]:
                self.texts[i] = " ".join("".join(self.texts[i]).split())
            if not self.hidden[i]:
                self.words[self.parent[i]] += self.words[i]
                self.linked[self.parent[i]] += self.linked[i]

    def _add(self, tag: str, names: tuple, label: int | None = None) -> int:
        p = self.open[-1]
        self.parent.append(p)
        self.tag.append(tag)
        self.names.append(names)
        self.words.append(0)
        self.linked.append(0)
        self.texts.append(None)
        self.label.append(self.label[p] if label is None else label)
        self.hidden.append(self.hidden[p] or tag in HIDDEN or tag == "head")
        self.depth.append(self.depth[p] + 1)
        return len(self.tag) - 1

    def _pop(self, depth: int) -> None:
        self.opened.subtract(self.tag[i] for i in self.open[depth:])
        del self.open[depth:]
        self.leaf = -1

    def _nearest(self, tags: set | frozenset, within: set | frozenset = frozenset()) -> int:
        for depth in range(len(self.open) - 1, 0, -1) if any(self.opened[t] for t in tags) else ():
            if self.tag[self.open[depth]] in tags:
                return depth
            if self.tag[self.open[depth]] in within:
                break
        return 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.tag[self.open[-1]] == "head" and tag not in IN_HEAD:
            self._pop(-1)
        if tag in INLINE:
            if tag == "a":
                self.in_link = any(k == "href" for k, _ in attrs)
            return
        if tag == "br":
            self.handle_data(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.leaf = -1
            return
        if tag in ("html", "body"):
            self.leaf = -1
            return
        if tag in ENDS_P and (depth := self._nearest({"p"}, {"td", "th", "button", "table"})):
            self._pop(depth)
        if tag in CLOSES and (depth := self._nearest(CLOSES[tag], HOLDS[tag])):
            first = depth
            while first and self.tag[self.open[first]] in CLOSES[tag]:
                depth, first = first, first - 1
            self._pop(depth)
        own = dict(attrs)
        names = tuple({w.lower() for k in NAMED_BY for w in _PART.findall(own.get(k) or "")})
        mark = own.get("data-main")
        self.open.append(self._add(tag, names, int(mark) if mark in ("0", "1") else None))
        self.opened[tag] += 1
        if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in (own.get("style") or "").replace(" ", "").lower():
            self.hidden[-1] = True
        self.leaf = -1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "canvas", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in INLINE or tag in ("html", "body"):
            return
        if depth := self._nearest({tag}):
            self._pop(depth)

    def handle_data(self, data: str) -> None:
        n = len(data.split())
        if self.leaf < 0:
            if not n:
                return
            if self.tag[self.open[-1]] == "head":
                self._pop(-1)
            self.leaf = self._add("", ())
            self.texts[self.leaf] = []
        self.texts[self.leaf].append(data)
        self.words[self.leaf] += n
        if self.in_link:
            self.linked[self.leaf] += n

    def evidence(self, i: int) -> list[tuple[str, str]]:
        """What is seen at a node."""
        n = self.words[i]
        bare = [("page", "bare")] if self.bare else []
        size, share = min(n.bit_length(), 8), 0 if not self.linked[i] else 1 + min(2, 3 * self.linked[i] // max(n, 1))
        if self.tag[i]:
            return [*bare, ("words below", str(size)), ("links below", str(share)), ("tag", self.tag[i]), *(("name", w) for w in self.names[i])]
        return [*bare, ("words", str(size)), ("links", str(share)), ("ends", str(self.texts[i].endswith(_SENTENCE_END)))]


def declared(page: Page) -> list[int] | None:
    """Labels by the one <article> or <main> of a page, or None if there is none, or more, or if names stand inside."""
    for kind in ("article", "main"):
        if page.tag.count(kind) == 1:
            label = [0]
            for i in range(1, len(page.tag)):
                label.append(int(page.tag[i] == kind or label[page.parent[i]]))
                if label[i] and (page.tag[i] in OUTSIDE or page.names[i]):
                    return None
            return label
    return None


#: Fillings of a layout: words of prose as they stand, all short, all long; and the same with paragraphs for headings.
FILLINGS = ((None, False), (4, False), (40, False), (None, True), (4, True), (40, True))


def filled(layout: str, prose: int | None = None, plain: bool = False) -> str:
    """A layout with its words: prose has a comma and a full stop, links have one or two words each.

    prose: words of each piece; plain: headings become paragraphs.
    """
    layout = re.sub(r"<(/?)h\d", r"<\1p", layout) if plain else layout

    def words(m: re.Match) -> str:
        n = int(m[1])
        if m[2]:
            return "".join(f"<li><a href='#'>{'word ' * (1 + i % 2)}</a></li>" for i in range(n * 2 // 3 or 1))
        n = prose or n
        return "word, " + "word " * (n - 2) + "word." if n > 8 else " ".join(["word"] * n) + ("." if n % 2 else "")

    return re.sub(r"\{(\d+)(:a)?\}", words, layout)


class Forest:
    """The nodes of pages one after another; pieces of evidence as flat (row, weight number) pairs."""

    def __init__(self, pages: list[Page], number: dict[tuple[str, str], int], grow: bool = False):
        self.begin = np.cumsum([0] + [len(p.tag) for p in pages])
        rows: list[int] = []
        feats: list[int] = []
        for start, page in zip(self.begin.tolist(), pages, strict=False):
            for i in range(1, len(page.tag)):
                for e in page.evidence(i):
                    f = number.setdefault(e, len(number)) if grow else _known(e, number)
                    if f is not None:
                        rows.append(start + i)
                        feats.append(f)
        self.rows, self.feats = np.array(rows, np.int64), np.array(feats, np.int64)
        join = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.array(getattr(p, name), kind) for p in pages)])
        self.hidden = join("hidden", bool)
        self.leaf = np.array([not t for p in pages for t in p.tag], np.int64)
        self.parent = join("parent", np.int64) + np.repeat(self.begin[:-1], np.diff(self.begin))
        depth = join("depth", np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:]
        self.roots = self.begin[:-1]


def _known(e: tuple[str, str], number: dict[tuple[str, str], int]) -> int | None:
    """Number of a piece of evidence; for a name that is not known, of the longest known one it begins with."""
    if e in number or e[0] != "name":
        return number.get(e)
    for n in range(len(e[1]) - 1, STEM - 1, -1):
        if ("name", e[1][:n]) in number:
            return number["name", e[1][:n]]
    return None


def _soft(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def marginals(forest: Forest, weight: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds of every node, of its part of the tree alone, of its parent without it): messages up, then down.

    edge[leaf, label of the parent]: what a node's log-odds gain.
    """
    n = len(forest.parent)
    total = np.bincount(forest.rows, weights=weight[forest.feats], minlength=n)[:n]
    up, above, belief = np.zeros(n), np.zeros(n), np.full(n, -SURE)
    total[forest.roots] = -SURE
    zero, one = edge[forest.leaf, 0], edge[forest.leaf, 1]
    for i in reversed(forest.levels):
        total[i] = np.where(forest.hidden[i], -SURE, np.clip(total[i], -SURE, SURE))
        up[i] = _soft(total[i] + one[i]) - _soft(total[i] + zero[i])
        np.add.at(total, forest.parent[i], up[i])
    total[forest.roots] = -SURE
    for i in forest.levels:
        above[i] = np.clip(belief[forest.parent[i]] - up[i], -SURE, SURE)
        belief[i] = np.where(forest.hidden[i], -SURE, total[i] + np.logaddexp(above[i] + one[i], zero[i]) - _soft(above[i]))
    return belief, total, above


def fit(pages: list[Page], labels: list[list[int]]) -> tuple[dict[tuple[str, str], int], np.ndarray, np.ndarray]:
    """(numbers of evidence, weights, edges) of the largest penalised likelihood of labelled pages."""
    number: dict[tuple[str, str], int] = {}
    forest = Forest(pages, number, grow=True)
    y = np.concatenate([np.array(x, float) for x in labels])
    seen = ~forest.hidden
    seen[forest.roots] = False
    flat = np.zeros(len(number) + 4)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    node = np.flatnonzero(seen)
    kind, upper = forest.leaf[node], y[forest.parent[node]]
    for step in range(1, STEPS + 1):
        weight, edge = flat[:-4], flat[-4:].reshape(2, 2)
        belief, total, above = marginals(forest, weight, edge)
        missed = np.where(seen, y - 1 / (1 + np.exp(-np.clip(belief, -SURE, SURE))), 0)
        slope = np.zeros_like(flat)
        slope[:-4] = np.bincount(forest.feats, weights=missed[forest.rows], minlength=len(number))
        s, a = total[node], above[node]
        both, alone = a + s + edge[kind, 1], s + edge[kind, 0]
        z = np.logaddexp(np.logaddexp(0, a), np.logaddexp(alone, both))
        for leaf in (0, 1):
            own = kind == leaf
            slope[len(number) + 2 * leaf] = ((1 - upper) * y[node] - np.exp(alone - z))[own].sum()
            slope[len(number) + 2 * leaf + 1] = (upper * y[node] - np.exp(both - z))[own].sum()
        slope -= PENALTY * flat
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        flat = flat + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return number, flat[:-4], flat[-4:].reshape(2, 2)


def trained(pages: DataFrame) -> tuple[dict[tuple[str, str], int], np.ndarray, np.ndarray]:
    """The model of labelled layouts and of some pages that declare their main text; pages: a column html."""
    some = pages.where(F.char_length("html") <= DECLARED_CHARS).where(F.lower("html").rlike("<(article|main)[\\s>]")).select("html")
    own = [Page(r["html"]) for r in some.orderBy(F.xxhash64("html"), "html").limit(DECLARED_PAGES).collect()]
    known = [(p, label) for p in own if (label := declared(p))]
    known += [(p, p.label) for layout in LAYOUTS for filling in FILLINGS for p in (Page(filled(layout, *filling)),)]
    return fit([p for p, _ in known], [label for _, label in known])


def texts_of(htmls: list[str | None], model: tuple) -> Iterator[str]:
    """Main texts of pages, some MB of them at a time."""
    number, weight, edge = model
    at = 0
    while at < len(htmls):
        pages, chars = [], 0
        while at < len(htmls) and chars < FOREST_CHARS:
            pages.append(Page(htmls[at] or ""))
            chars += len(htmls[at] or "")
            at += 1
        forest = Forest(pages, number)
        odds = marginals(forest, weight, edge)[0].tolist()
        for begin, page in zip(forest.begin.tolist(), pages, strict=False):
            yield "\n".join(page.texts[i] for i in range(1, len(page.tag)) if not page.tag[i] and not page.hidden[i] and odds[begin + i] >= 0)


def main_text(pages: DataFrame, model: tuple | None = None) -> DataFrame:
    """pages with columns text and n_chars (code points) instead of html; model: as trained() gives it, trained if None."""
    model = model or trained(pages)
    keep = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(texts_of(batch.column(batch.num_columns - 1).to_pylist(), model))
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    return pages.select(*keep, "html").mapInArrow(tidy(extract), schema)
