"""Source divergence, spelling variants and main text of pages against brute force and hand pages."""

import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import html_text, source_divergence, spelling_variants

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string"


# --- source divergence -------------------------------------------------------------------


def plain_audit(rows):
    """The whole result by nested loops over plain integers."""
    rows = [(t or "", lang or "", s or "") for _, t, lang, s, *_ in rows]
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    out = []
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        docs = Counter(w for t, _, _ in own for w in set(terms(t)))
        kept = sorted(w for w, n in docs.items() if n >= 3)
        count = {s: Counter(w for t, _, x in own if x == s for w in terms(t)) for s in {r[2] for r in own}}
        count_all = Counter(w for t, _, _ in own for w in terms(t))

        def share(c, w, kept=kept):
            return 1 + 10**9 * (c[w] + 1) // (sum(c[k] for k in kept) + len(kept))

        for s in count:
            gap = lambda p, q: (p - q) ** 2 // q
            pairs = [(o, sum(gap(share(count[s], w), share(count[o], w)) for w in kept)) for o in count if o != s]
            used = [(w, gap(share(count[s], w), share(count_all, w))) for w in kept if count[s][w] and share(count[s], w) > share(count_all, w)]
            for part, found in (("pair", pairs), ("term", used)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found) if part == "pair" or i < 200]
    return sorted(out)


def audited(spark, rows, schema=DOCS):
    r = source_divergence.audit(spark.createDataFrame(rows, schema))
    return sorted(tuple(x) for x in r.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("shard,block", [(300_000, 1_024), (7, 2)])
def test_divergence_is_exact(spark, monkeypatch, shard, block):
    monkeypatch.setattr(source_divergence, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(source_divergence, "ROW_BLOCK", block)
    rng = np.random.default_rng(5)
    words = [*(f"w{c}" for c in "abcdefghijklmnop"), "ÉTÉ", "été", "日本", "Zeta", "zeta"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40)).tolist()), ["en", "fr", None][i % 3], [None, "s1", "s2", "s3", "hot", "hot", "hot"][int(rng.integers(7))]) for i in range(120)]
    rows += [(500, None, "en", "only null"), (501, "", "xx", "a"), (502, "one two", "xx", "b"), (503, "Long " * 3000, "en", "s1"), (504, "Long", "en", "s1"), (504, "Long", "en", "s1")]
    assert audited(spark, rows) == plain_audit(rows)


def test_divergence_of_nothing_and_clashing_columns(spark):
    assert audited(spark, []) == []
    rows = [(i, "a b", "en", s, 1, "x") for i in range(3) for s in "pq"]
    assert audited(spark, rows, DOCS + ", n long, term string") == plain_audit(rows)


def test_shares_beyond_63_bits():
    n = np.array([10**12, 0, 10**12])
    assert source_divergence.shares(n, 2 * 10**12 + 3).tolist() == [1 + 10**9 * (int(c) + 1) // (2 * 10**12 + 3) for c in n]


# --- spelling variants -------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, near = {}, {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def varied(spark, rows, schema="doc_id long, text string"):
    docs = spark.createDataFrame(rows, schema)
    return sorted((tuple(r) for r in spelling_variants.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=5, max_size=9), max_size=60))
def test_near_pairs_are_all_pairs_one_edit_apart(words):
    data = sorted(w.encode("latin-1") for w in words)
    q, t = spelling_variants.near_pairs(data, np.zeros(len(data), np.int64))
    assert sorted(zip(q.tolist(), t.tolist(), strict=True)) == [(i, j) for i, a in enumerate(data) for j, b in enumerate(data) if one_edit(a, b)]


def test_rows_of_the_matrix_in_pieces(monkeypatch):
    monkeypatch.setattr(spelling_variants, "ROWS_AT_ONCE", 50)
    data = sorted({bytes(x) for x in np.random.default_rng(3).integers(97, 100, (300, 6)).astype(np.uint8)})
    q, t = spelling_variants.near_pairs(data, np.zeros(len(data), np.int64))
    assert sorted(zip(q.tolist(), t.tolist(), strict=True)) == [(i, j) for i, a in enumerate(data) for j, b in enumerate(data) if one_edit(a, b)]


@pytest.mark.parametrize("most", [20_000, 4])
def test_variants_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr(spelling_variants, "near_words", lambda v, f=spelling_variants.near_words: f(v, most))
    rng = np.random.default_rng(8)
    stems = ["colour", "color", "centre", "center", "aaaaaa", "aaaaaaa", "prefixprefixed", "élèves"]
    rows = []
    for i in range(400):
        ws = []
        for _ in range(rng.integers(1, 12)):
            w = stems[int(rng.integers(len(stems)))]
            k, c = int(rng.integers(len(w))), "abeéX"[int(rng.integers(5))]
            ws.append([w, w, w.title(), w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]][int(rng.integers(6))])
        rows.append((i, ["; ", "1", " ж"][i % 3].join(ws)))
    rows += [(None, "colour colour"), (7, None), (8, ""), (9, "x" * 3000 + " " + "colour " * 500), (9, "colour"), (9, "colour")]
    assert varied(spark, rows) == plain_variants(rows)


def test_variants_of_nothing_and_clashing_columns(spark):
    assert varied(spark, []) == []
    rows = [("d", "abcde abcde abcde abcdf abcdf abcdf abcdf abcdf abcdf", 1, "y")]
    assert varied(spark, rows, "doc_id string, text string, n long, word string") == plain_variants(rows)


def test_words_over_many_slices(monkeypatch):
    from tallyforge.llm import term_counts

    monkeypatch.setattr(term_counts, "SLICE_BYTES", 7)
    table = term_counts.letters_table(0x80)
    text = ("one twotwo threethreethree four " * 9).encode()
    assert [w for part in term_counts.word_lists(text, table) for w in part] == text.split()


# --- main text of pages ------------------------------------------------------------------

PROSE = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore."
P = f"<p>{PROSE}</p>"
#: Development pages, each with the blocks of its main text: not fitted, but layouts and evidence were chosen with them in view.
PAGES = [
    (f'<head><title>x</title></head><header class="global-header"><a href="/">Site</a><nav class="primary-nav"><a href="/a">Home</a> <a href="/b">News</a></nav></header><div class="cookie-consent">We use cookies to improve your visit, and more.<button>OK</button></div><main><article><h1>The Title</h1><p class="lead">{PROSE}</p>{P}<p>Short.</p><div class="ad-slot"><p>Buy our new phone now.</p></div>{P}</article><section class="comments-area"><h2>3 comments</h2><ol class="comment-list"><li class="comment">{P}</li><li><p>I agree.</p></li></ol></section></main><aside class="sidebar"><h3>Popular</h3><ul><li><a href=x>One two three</a></li></ul></aside><footer><p>Copyright 2020 Site. All rights reserved.</p></footer>', ["The Title", PROSE, PROSE, "Short.", PROSE]),
    (f'<div id="top"><ul id="menu"><li><a href=1>A</a><li><a href=2>B</a></ul></div><div id="page"><div id="left-sidebar"><p>About this site: we write about things, and more.</p></div><div id="article-body"><h1>Heading here</h1>{P * 3}<ul><li>First point of the list.</li><li>Second point of it.</li></ul>{P}</div><div id="comments"><div class="comment-body">{P}</div><form class="comment-form"><label>Name</label><textarea>x</textarea></form></div></div><div id="footer">Imprint and contact of the site</div>', ["Heading here", PROSE, PROSE, PROSE, "First point of the list.", "Second point of it.", PROSE]),
    (f'<div class="site-notice">{P}</div><nav><a href=1>One</a></nav><article><h1>T</h1>{P}<script>var a="<p>no</p>";</script><style>p{{}}</style><!-- <p>no</p> --><p>A &lt;b&gt; &amp; &#65;&nbsp;c<br>d</p></article><form><p>Get our weekly newsletter in your inbox.</p><input></form><footer>f</footer>', ["T", PROSE, "A <b> & A c d"]),
    (f'<table width=100%><tr><td colspan=2><a href=1>Home</a> | <a href=2>About</a></td></tr><tr><td><a href=3>Link one</a><br><a href=4>Link two</a></td><td><h2>Old page</h2>{P}{P}</td></tr><tr><td colspan=2>Last changed 1999</td></tr></table>', ["Old page", PROSE, PROSE]),
    (f'<header><h1><a href="/">My Blog</a></h1><p>A blog about things</p></header><div class="post"><h2>Post title</h2>{P}{P}</div><div class="sidebar widget-area"><div class="widget"><h3>Archive</h3>{P}</div></div><footer>{P}</footer>', ["Post title", PROSE, PROSE]),
    (f'<nav>{P}</nav><article><h1>Alpha</h1>{P}<aside>{P}</aside>{P}<section class="comments"><p>Nice article, thanks!</p>{P}</section></article><footer>{P * 3}</footer>', ["Alpha", PROSE, PROSE]),
    (f'<header class="page-header">{P}</header><main><h1>Beta</h1>{P}<p>One.</p></main><div class="comments">{P * 4}</div><div class="promo">{P}</div>', ["Beta", PROSE, "One."]),
    (f"{P}{P}", [PROSE, PROSE]),
]


@pytest.fixture(scope="module")
def model(spark):
    return html_text.trained(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_development_pages(model):
    for (_, want), got in zip(PAGES, html_text.texts_of([html for html, _ in PAGES], model), strict=True):
        assert got.split("\n") == want


def test_pages_of_the_table(spark, model):
    """Every page declares its article, most took no part in the fit."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages, model).collect()}
    for r in pages.collect():
        own = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(re.sub("<[^>]+>", " ", b).split()) for b in re.split("</?(?:h1|p)>", own))
        assert got[r["page_id"]] == "\n".join(" ".join(unescape(b).split()) for b in blocks if b)


def brute_marginals(page, number, weight, edge):
    """Marginals by summing over all labellings."""
    n = len(page.tag)
    total, ones = 0.0, np.zeros(n)
    for code in range(2 ** (n - 1)):
        y = [0, *((code >> i) & 1 for i in range(n - 1))]
        score = 0.0
        for i in range(1, n):
            if y[i]:
                score += edge[int(not page.tag[i]), y[page.parent[i]]] + sum(weight[f] for e in page.evidence(i) if (f := html_text._known(e, number)) is not None)
        total += np.exp(score)
        ones += np.exp(score) * np.array(y)
    return ones / total


def test_marginals_are_those_of_all_labellings(model):
    number, weight, edge = model
    for html in ("<div class=content><p>One two three.</p><p>x</p></div><nav><a href=1>y</a></nav>", "<main><h1>a</h1><div>b<p>c</p></div></main>d", "text"):
        page = html_text.Page(html)
        odds = html_text.marginals(html_text.Forest([html_text.Page("<p>other"), page], number), weight, edge)[0][-len(page.tag) :]
        assert 1 / (1 + np.exp(-odds[1:])) == pytest.approx(brute_marginals(page, number, weight, edge)[1:], abs=1e-6)


def test_odd_pages(spark, model):
    rows = [(1, "u", None, 5), (2, None, "", 5), (2, None, "", 5), (3, "u", "<div>" * 5000 + "x" + "<p>y" * 3000, 5), (4, "u", "<p>a<!-- never closed <p>b", 5), (None, "u", "&am < <b>&#x110000;", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = html_text.main_text(pages, model).collect()
    assert [r["page_id"] for r in got] == [1, 2, 2, 3, 4, None]
    assert [r["text"] for r in got][:3] == ["", "", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.main_text(pages.limit(0)).collect() == []
