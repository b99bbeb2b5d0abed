"""The training-data operators against brute force on small rows, and their defined edge cases."""

import collections
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import charlm, common, decontaminate, jaccard_join, license_scan, packing, perplexity, quality_rules, suffix_dedup, token_counts, toxicity, url_filter
from tallyforge.llm import queries
from tallyforge.llm.graph import connected_components

DATA = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, uid string, wh int"


def make(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = [" ".join(r.choices(words, k=r.randint(60, 200))) for _ in range(30)]
    out += [out[0], out[0], " ".join(out[1].split()[:-2] + ["edit", "here"])]
    passage = " ".join(r.choices(words, k=70))
    out += [" ".join(r.choices(words, k=40)) + " " + passage + " " + " ".join(r.choices(words, k=30)) for _ in range(6)]
    out += [None, "", "  \n ", "one two", "one two", "the same " * 80, " ".join(r.choices(words, k=20000))]
    return out


def test_near_duplicates_match_brute_force(spark, texts):
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(make(spark, texts)).collect()}
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links, root = collections.Counter(), list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            ra, rb = sorted((root[a], root[b]))
            root = [ra if x == rb else x for x in root]
    assert {i: (got[i].n_links, got[i].class_id) for i in got} == {i: (links[i], root[i]) for i in range(len(texts))}


def test_links_that_no_bucket_holds(spark):
    # Pairs of 4 and 5 shingles of which 4 are shared; in two of them no sampled token of any run is shared.
    rows = [" ".join(f"w{i}.{x}" for x in range(n)) for i in (1, 7048, 35456) for n in (8, 9)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(make(spark, rows)).collect()}
    assert got == {i: (i - i % 2, 1) for i in range(6)}


def test_chains_of_links_are_one_class(spark):
    words = [f"c{i}" for i in range(600)]
    rows = [" ".join(words[10 * i : 10 * i + 104]) for i in range(40)]  # only neighbours are linked
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(make(spark, rows)).collect()}
    assert got == {i: (0, 1 if i in (0, 39) else 2) for i in range(40)}


@pytest.mark.parametrize("block", [1024, 8])
def test_links_do_not_hang_on_recall(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    r = random.Random(3)
    common, rows = [f"c{i}" for i in range(300)], []
    for i in range(100):
        base = common[: r.randint(0, 60)] + [f"b{i}.{x}" for x in range(r.randint(20, 200))]
        n = len(base) - 4
        rows += [" ".join(base), " ".join(base + [f"e{i}.{x}" for x in range(n // 4)]), " ".join(base[n // 5 :])]
    rows += [" ".join([*common[:200], *[f"u{i}.{x}" for x in range(25)]]) for i in range(30)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    links = collections.Counter(x for a, b in itertools.combinations(range(len(rows)), 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) for x in (a, b))
    got = {x.doc_id: x.n_links for x in jaccard_join.near_duplicates(make(spark, rows), recall=0.1, small=4).collect()}
    assert got == {i: links[i] for i in range(len(rows))}


def test_sizes_at_the_threshold_of_any_similarity(spark):
    base = [f"s{i}" for i in range(104)]  # 0.55 * 100 is above 55 in floats
    got = jaccard_join.near_duplicates(make(spark, [" ".join(base), " ".join(base[:59])]), similarity=0.55).collect()
    assert [r.n_links for r in got] == [1, 1]


def test_huge_words_are_hashed_whole(spark):
    n = common.SLICE_BYTES
    a = "a" * 2 * n
    words = [a, a[:-1] + "b", a[:n] + "b" + a[n + 1 :], "b" + a[1:], a + "a", a]
    data = np.frombuffer(("x " + " ".join(words)).encode(), np.uint8)
    starts = 2 + np.cumsum([0, *[len(w) + 1 for w in words[:-1]]])
    h = common.hash_words(data, starts, starts + [len(w) for w in words])
    assert len(set(h.tolist())) == 5 and h[0] == h[5]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(make(spark, [a, a[:-1] + "b", a])).collect()}
    assert got == {0: (0, 1), 1: (1, 0), 2: (0, 1)}


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    base = [f"b{i}" for i in range(100)]
    docs = make(spark, [" ".join(base[: 40 + i % 3] + [f"x{i}"] + base[43:]) for i in range(60)])
    got = jaccard_join.near_duplicates(docs, small=4).collect()
    assert all(r.class_id == 0 and r.n_links == 59 for r in got)


@pytest.mark.parametrize(("hot", "mapped", "looked_up"), [(10_000, 10_000, 10_000), (2, 10_000, 10_000), (2, 10_000, 0), (2, 0, 10_000)])
def test_repeats_match_brute_force(spark, texts, hot, mapped, looked_up, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_windows, "__defaults__", (50, 15, hot, mapped, looked_up))
    got = {r.uid: r for r in suffix_dedup.repeats(make(spark, texts)).collect()}
    windows = {i: [tuple((t or "").split()[s : s + 50]) for s in range(len((t or "").split()) - 49)] for i, t in enumerate(texts)}
    count, seen = collections.Counter(w for ws in windows.values() for w in ws), set()
    for i, ws in windows.items():
        cut, kept = set(), set()
        for s, w in enumerate(ws):
            if count[w] > 1:
                (cut if w in seen else kept).update(range(s, s + 50))
                seen.add(w)
        of = lambda spans: {p for x in spans for p in range(x.start, x.start + x.n)}  # noqa: B023, E731
        assert (of(got[i].cut), of(got[i].kept)) == (cut, kept) if i in got else not cut | kept


def test_cut_repeats_keeps_first_places_and_clean_bytes(spark, texts):
    docs = make(spark, texts)
    out = {r.doc_id: r for r in suffix_dedup.cut_repeats(docs).collect()}
    assert out[2].text == texts[2] and out[0].text == texts[0] and 30 not in out and out[39].text is None and out[40].text == ""
    assert suffix_dedup.repeats(suffix_dedup.cut_repeats(docs)).where(F.size("cut") > 0).count() == 0
    assert set(docs.columns) == set(suffix_dedup.cut_repeats(docs).columns)


def test_cut_repeats_leaves_periods_their_first_place(spark):
    """Held against a plain rule, word by word: a word goes under a window first met in an earlier text, or in this one where no first window covers it."""
    r = random.Random(5)
    some = [f"w{i}" for i in range(200)]
    tail = " ".join(some[60:130])
    texts = ["the same " * 3000, "the same " * 1000, " ".join(some[:70] + some[:70] + some[:55]), "a b c d e f g " * 30 + tail, "q " * 120 + tail + " q" * 120, " ".join(r.choice("xy") for _ in range(700)), "intro " + tail + " a b c d e f g" * 9]
    seen, want = {}, []
    count = collections.Counter(tuple(t.split()[s : s + 50]) for t in texts for s in range(len(t.split()) - 49))
    for i, t in enumerate(texts):
        ws, far, near, kept = t.split(), set(), set(), set()
        for s in range(len(ws) - 49):
            w = tuple(ws[s : s + 50])
            at = seen.setdefault(w, (i, s))
            if count[w] > 1:
                (kept if at == (i, s) else near if at[0] == i else far).update(range(s, s + 50))
        want.append([w for p, w in enumerate(ws) if p not in far and (p not in near or p in kept)])
    got = {x.doc_id: x.text.split() for x in suffix_dedup.cut_repeats(make(spark, texts)).collect()}
    assert got == {i: w for i, w in enumerate(want) if w}
    assert len(got[0]) == 51 and 1 not in got and len(got[2]) == 70 + 49


def test_contamination_matches_brute_force(spark, texts):
    items = [texts[3].upper()[:300], "one two", "", None, texts[33], "w1, w2 w3", "one two", "the same " * 30, " ".join(texts[30].split()[:8])]
    texts = [*texts, "the same " * 300 + "end", " ".join(x + (" new" if i % 5 == 4 else "") for i, x in enumerate(texts[3].split()[:40]))]
    got = {r.doc_id: r for r in decontaminate.contamination(make(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    df = collections.Counter(w for t in texts for w in words(t))
    for d, t in enumerate(texts):
        w, hit, found, near = words(t), set(), set(), set()
        at = collections.defaultdict(set)
        for p, x in enumerate(w):
            at[x].add(p)
        for i, x in enumerate(items):
            v = words(x)
            n = min(10, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                r = min(range(n), key=lambda k: (df[v[s + k]], k))  # noqa: B023
                if any(all(any(p - r + k + e in at[v[s + k]] for e in (-2, -1, 0, 1, 2)) for k in range(n)) for p in at[v[s + r]]):
                    near.add(str(i))
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].items, got[d].n_near) == (len(w), len(hit), len(found), sorted(found), len(near))
    assert got[len(texts) - 1].n_near and not got[len(texts) - 1].n_hit


def test_base_measures(spark, texts):
    got = {r.doc_id: r for r in quality_rules.judge(make(spark, [*texts, "a b c a b c\na b\na b\n# $"])).collect()}
    for d, t in enumerate([*texts, "a b c a b c\na b\na b\n# $"]):
        w = (t or "").split()
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {p for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert (got[d].n_words, got[d].word_chars, got[d].n_dup_lines, got[d].n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert got[d].base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_bucket_boundaries_are_optimal():
    r = random.Random(1)
    for _ in range(40):
        lengths = np.array(sorted(r.sample(range(1, 60), r.randint(1, 9))))
        counts = np.array([r.randint(1, 9) for _ in lengths])
        k = r.randint(1, 4)
        best = min(
            sum(c * (min(b for b in [*cut, lengths[-1]] if b >= x) - x) for x, c in zip(lengths, counts, strict=True))
            for n in range(min(k, len(lengths)))
            for cut in itertools.combinations(lengths[:-1], n)
        )
        assert packing.optimal_boundaries(lengths, counts, k)[1] == best


def test_packing_lays_out_every_token(spark, texts):
    rows = packing.pack(make(spark, texts), max_len=256, budget=2048, buckets=3).collect()
    enc = token_counts.encoder(token_counts.VOCABULARY)
    want = {i: n for i, t in enumerate(texts) if (n := token_counts.encoded_length(t, enc))}
    total = collections.Counter()
    batches = collections.defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.n_tokens
        batches[r.bucket, r.batch].append(r.slot)
    assert total == want
    assert all(len(set(s)) == len(s) and len(s) * b <= 2048 for (b, _), s in batches.items())
    short = collections.Counter(b for (b, _), s in batches.items() if len(s) < 2048 // b)
    assert all(n == 1 for n in short.values())


def test_token_sums(spark, texts):
    sums = token_counts.suffix_sums(token_counts.length_histogram(token_counts.with_token_counts(make(spark, texts))))
    enc = token_counts.encoder(token_counts.VOCABULARY)
    n = [token_counts.encoded_length(t, enc) for t in texts]
    for r in sums.collect():
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n) and r.docs_at_least == sum(x >= r.n_tokens for x in n)
    assert token_counts.truncated_total(sums, 100).first().truncated_tokens == sum(min(x, 100) for x in n)
    long = " ".join(["word, and other things"] * 60_000)
    assert token_counts.encoded_length(long, enc) == len(enc.encode_ordinary(long))


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(100, x) for x in range(101, 140)]
    root = {}
    find = lambda a: a if root.setdefault(a, a) == a else find(root[a])
    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in root if any(u != v and n in (u, v) for u, v in edges)}


def test_urls(spark):
    urls = ["http://a.com/fr/1", "http://x.org", "http://example.org/es/2?a", "http://www.EXAMPLE.org/en/1#t", "http://n.net/q", "http://www.n.net/q/", None, "nothing", "http://z.com/de/9", "http://notcom/fr/1"]
    html = {4: '<link href="http://z.com/de/9" rel="canonical">'}
    pages = spark.createDataFrame([(i, u, html.get(i)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, spelling=url_filter.page_form).collect()}
    assert got[0] == ("a.com", "/fr/1", "com/fr/", "allow") and got[1] == ("x.org", "", None, "allow")
    assert got[2][2:] == ("example.org/es/", "block") and got[3] == ("www.example.org", "/en/1", "example.org/en/1", "block")
    assert got[4] == ("n.net", "/q", None, "block") and got[5] == ("www.n.net", "/q/", None, "block")  # by the alias of a blocked page
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[9][2] is None


def test_licenses(spark):
    header = license_scan.TEMPLATES["apache-2.0-header"]
    edited = header.replace("compliance", "accordance")
    docs = make(spark, ["x y z. Released under the MIT License.", f"{'a b ' * 90}{edited} {'c d ' * 50}", "released under a license", None, ""])
    got = {r.doc_id: {x.license for x in r.licenses} for r in license_scan.scan(docs).collect()}
    assert got[0] == {"mit-notice"} and "apache-2.0-header" in got[1] and not got[2] and not got[3] and not got[4]


def test_language_models(spark):
    r = random.Random(2)
    good = [" ".join(r.choices(["tion", "the", "and", "ering", "ed", "of"], k=80)) for _ in range(150)]
    bad = ["".join(r.choices("#$%&xzqj 0123456789", k=400)) for _ in range(20)]
    docs = make(spark, [*good, *bad, None, ""])
    trusted = spark.createDataFrame([(i,) for i in range(120)], "doc_id long")
    one = {x.doc_id: x for x in perplexity.classify(docs, trusted).collect()}
    two = {x.doc_id: x for x in perplexity.classify(docs, trusted, table_rows=0).collect()}
    assert len(one) == 172 and sum(one[i].kept for i in range(150)) >= 148 and not any(one[i].kept for i in range(150, 170)) and one[170].kept
    assert all(abs(one[i].perplexity - two[i].perplexity) < 1e-3 for i in one)  # a broadcast table and sharded joins agree

    rude = [t.replace("ed", f"stupi{r.choice('dtlk')}", 3) for t in good[:75]]
    labels = spark.createDataFrame([(i, int(i >= 150)) for i in range(225)], "doc_id long, toxic int")
    scored = {x.doc_id: x for x in toxicity.score(make(spark, [*good, *rude, None, ""]), labels).collect()}
    held = [i for i in range(225) if scored[i].held_out]
    assert sum(scored[i].predicted == int(i >= 150) for i in held) >= 0.95 * len(held)
    assert 0 <= scored[225].score <= 1 and scored[225].score == scored[226].score


def test_probabilities_sum_to_one(spark):
    docs = make(spark, ["abab abba baab", "aabb"])
    table = charlm.count_keys(docs, {"all_": F.lit(True)}).cache()
    p = {x.key: x.p_c_all_ for x in charlm.probabilities(table, ["c_all_"]).collect()}
    assert len(p) == table.count() and all(0 < x <= 1 for x in p.values())
    by = collections.Counter()
    for k, v in p.items():
        by[k >> charlm.BITS] += v
    assert all(v <= 1 + 1e-9 for v in by.values())


def test_empty_tables(spark):
    docs = make(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        packing.pack(docs), suffix_dedup.repeats(docs), suffix_dedup.cut_repeats(docs), jaccard_join.near_duplicates(docs), license_scan.scan(docs), quality_rules.judge(docs),
        toxicity.score(docs, labels), perplexity.classify(docs, labels.select("doc_id")), token_counts.suffix_sums(token_counts.length_histogram(token_counts.with_token_counts(docs))),
        decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")), url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert out.count() == 0
    assert decontaminate.contamination(make(spark, ["one two"]), spark.createDataFrame([], "item_id long, text string")).first().n_words == 2


def test_one_id_on_two_texts_and_ids_of_any_type(spark):
    r = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    passage = " ".join(r.choices(words, k=60))
    longer, short = " ".join(r.choices(words, k=300)), " ".join(r.choices(words, k=80))
    for ids, kind in (([7, 7, 1, None], "long"), (["b", "b", "a", None], "string"), ([1.5, 1.5, 0.5, None], "double")):
        rows = [(ids[0], longer), (ids[1], f"{short} {passage}"), (ids[2], f"{passage} {short[:100]}"), (ids[3], longer + " end")]
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        out = sorted(x.text for x in suffix_dedup.cut_repeats(docs).collect())
        assert longer in out or longer + " end" in out  # one of the two stays whole, the other loses what repeats
        assert sum(len(x.split()) for x in out) == 300 + 1 + 80 + 60 + len(short[:100].split())
        near = {(x.doc_id, x.n_shingles): x for x in jaccard_join.near_duplicates(docs).collect()}
        assert [near[ids[0], 296].n_links, near[ids[1], 136].n_links, near[ids[3], 297].n_links] == [1, 0, 1]
        assert near[ids[3], 297].class_id == ids[0] and near[ids[0], 296].first and not near[ids[3], 297].first
        assert license_scan.scan(docs).count() == 4 and packing.pack(docs).count() == 4


def test_extra_columns_of_clashing_names(spark, texts):
    extra = {n: F.lit(i) for i, n in enumerate(("uid", "tid", "cut", "span_uid", "Span_TID", "_uid", "gone_uid", "gone_tid", "key", "first", "rep", "n", "mins", "at", "kept"))}
    docs = make(spark, texts).drop("uid").withColumns(extra)
    for step in (suffix_dedup.cut_repeats, lambda d: corpus_pipeline.drop_near_copies(spark, d, "")):
        out = step(docs)
        assert out.columns == docs.columns and out.select(*extra).distinct().count() == 1
    assert jaccard_join.near_duplicates(docs).count() == quality_rules.judge(docs).count() == len(texts)


def test_very_long_runs_are_encoded(spark, monkeypatch):
    enc = token_counts.encoder(token_counts.VOCABULARY)
    assert token_counts.encoded_length(" " * 1_000_000, enc) == 1_000_000
    assert token_counts.encoded_length("a" * 1_000_000, enc) == len(enc._encode_single_piece(b"a" * 1_000_000))
    assert packing.pack(make(spark, [" " * 1_000_000, "b" * 1_000_000])).count() > 2
    monkeypatch.setattr(token_counts, "PART", 30)
    monkeypatch.setattr(token_counts, "RUN", 8)
    r = random.Random(3)
    parts = ["a", "b ", "  ", "\n", "\t", "é", "1", "23", ".", "!!", "'s", "'ll", "漢", " \n ", "x y", "\x1c", "\x85", "ß", " 'd"]
    for _ in range(3000):
        s = "".join(r.choices(parts, k=r.randint(0, 60)))
        s = s[:10] + r.choice([" ", "\n", "a", "1", "."]) * r.randint(0, 80) + s[10:]
        assert token_counts.encoded_length(s, enc) == len(enc.encode_ordinary(s)), repr(s)


def test_quantiles_of_lengths(spark, texts):
    sums = token_counts.suffix_sums(token_counts.length_histogram(token_counts.with_token_counts(make(spark, texts))))
    enc = token_counts.encoder(token_counts.VOCABULARY)
    n = sorted(token_counts.encoded_length(t, enc) for t in texts)
    got = {x.share: x.n_tokens for x in token_counts.quantile_at(sums, [0.1, 0.5, 0.9, 1.0]).collect()}
    assert got == {p: min(v for v in n if sum(x <= v for x in n) >= p * len(n)) for p in got}


def test_components_with_hubs(spark):
    r = random.Random(8)
    edges = [(0, x) for x in range(1, 60)] + [(100, x) for x in range(50, 90)] + [(x, x + 1) for x in range(200, 240)] + [(r.randint(300, 340), r.randint(300, 340)) for _ in range(30)]
    one = {tuple(x) for x in connected_components(spark.createDataFrame(edges, "u long, v long"), hub=1).collect()}
    two = {tuple(x) for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert one == two and {root for node, root in one if node < 200} == {0} and {root for node, root in one if 200 <= node < 300} == {200}


def test_links_of_pages(spark):
    rows = [
        ("http://n.net/q", None), ("http://m.net/a/b.html", '<link rel=canonical href="HTTPS://n.net/q2/">'), ("https://n.net/q2", '<META http-equiv="refresh" content="0; url=http://z.com/de/1?a=1&amp;b=2">'),
        ("http://x.net/f/g/h", "<link href='../k' rel='canonical'><link rel=canonical href=//y.net/>"), ("http://x.net/f/k", None), ("http://y.net", "<link rel=canonical href='http://example.org/es/x'>"),
        ("http://c.org/1", "<link rel=canonical href='http://z.com/de/1?a=1&b=2'>"), ("http://e.net/1", "<link rel=stylesheet href='http://z.com/de/2'>"), ("http://q.net/?p=1", "<link rel=canonical href='?p=2'>"), ("http://q.net/?p=2", None),
        *[(f"http://hub.net/{i}", "<link rel=canonical href='/0'>") for i in range(30)],
    ]
    pages = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "page_id long, url string, html string")
    got = {x.page_id: (x.verdict, x.rule, x.blocked_by) for x in url_filter.judge(pages).collect()}
    assert got[0] == got[9] == ("allow", None, None) and got[1] == got[2] == ("block", None, "com/de/")  # over a canonical link and a refresh
    assert got[3] == got[4] == got[5] == ("block", None, "example.org/es/")  # relative target, second link, closing slash
    assert got[6] == ("allow", "org/", None) and got[7] == ("allow", None, None)  # an explicit allow stays; a stylesheet is no alias
    assert {got[i][0] for i in range(10, 40)} == {"allow"}
    log = spark.createDataFrame([("http://hub.net/0", "http://w.com/de/"), (None, "http://n.net/q")], "u string, v string")
    again = {x.page_id: x.verdict for x in url_filter.judge(pages, redirects=log).collect()}
    assert {again[i] for i in range(10, 40)} == {"block"} and again[0] == "allow"
    both = spark.createDataFrame([(0, "https://www.n.net/p.html?utm_source=x"), (1, "http://n.net/p/"), (2, None)], "page_id long, url string")
    to = spark.createDataFrame([("http://n.net/p", "http://z.com/de/")], "u string, v string")
    assert [{x.page_id: x.verdict for x in url_filter.judge(both, to, spelling=f).collect()} for f in (url_filter.plain_form, url_filter.page_form)] == [{0: "allow", 1: "block", 2: "allow"}, {0: "block", 1: "block", 2: "allow"}]


def test_adaptive_limits_match_brute_force(spark):
    r = random.Random(11)

    def text(long):
        return "\n".join(" ".join("x" * (r.randint(3, 7) + long) + str(r.randint(0, 9999)) for _ in range(12)) for _ in range(6))

    rows = [(i, text(0), "en", "a") for i in range(60)] + [(100 + i, text(6), "en", "b") for i in range(60)] + [(200 + i, text(0) + " #$%" * 30, None, "b") for i in range(3)]
    rows += [(300, text(40), "en", "a"), (301, "few words", "en", "a"), (302, None, "en", "a"), (303, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality_rules.judge(docs, least_group=20).collect()}
    names = quality_rules.MEASURES
    top = lambda x: x | ((1 << max(x.bit_length() - 8, 0)) - 1)

    def limit(values):
        v = sorted(map(top, values))
        low, middle, high = (v[-(-len(v) * p // 1000) - 1] for p in (50, 500, 995))
        return middle + 4 * (middle - low) if middle > low else high if high > middle else None

    ok = [x for x in got.values() if not x.base_failed]
    for x in got.values():
        groups = [[y for y in ok if (y.lang, y.source) == (x.lang, x.source)], [y for y in ok if y.lang == x.lang], ok]
        reasons = []
        for m in names:
            limits = [limit([y[m] for y in g]) for i, g in enumerate(groups) if len(g) >= (20, 20, 0)[i]]
            reasons += [m for lim in [next((z for z in limits if z is not None), None)] if not x.base_failed and lim is not None and x[m] > lim]
        assert (x.reasons, x.kept) == (reasons, not x.base_failed and not reasons), x.doc_id
    assert not got[300].kept and got[301].base_failed and got[302].base_failed and got[303].base_failed
    sketch = quality_rules.sketches(quality_rules.with_measures(quality_rules.base_measures(docs)))
    lims = {x.source: x.limit_mean_word for x in quality_rules.thresholds(sketch, 20).where("lang = 'en'").collect()}
    assert lims["b"] > 1.3 * lims["a"]  # a group whose words are longer has its own limit


def test_kneser_ney_matches_plain_python(spark):
    texts = ["abab abba baab abc", "aabb cab", "ab"]
    n = charlm.ORDER
    table = charlm.count_keys(make(spark, texts), {"x": F.lit(True)}).cache()
    got = {x.key: x.p_c_x for x in charlm.probabilities(table, ["c_x"]).collect()}
    grams = {n: collections.Counter()}
    for t in texts:
        c = (0,) * (n - 1) + tuple(map(ord, t))
        grams[n].update(c[i : i + n] for i in range(len(c) - n + 1))
    for k in range(n - 1, 0, -1):
        grams[k] = collections.Counter(g[1:] for g in grams[k + 1])

    def prob(g):
        if not g:
            return 1 / 4096
        c, k = grams[len(g)], len(g)
        m = [sum(v == i for v in c.values()) for i in range(5)]
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
        d = [0] + [min(max(i - (i + 1) * y * m[i + 1] / m[i], 0.1), i - 0.05) if m[i] and m[i + 1] else min(0.5 * i, 1.5) for i in (1, 2, 3)]
        ctx = {h: v for h, v in c.items() if h[: k - 1] == g[: k - 1]}
        left = sum(d[min(v, 3)] for v in ctx.values())
        return (max(c[g] - d[min(c[g], 3)], 0) + left * prob(g[1:])) / sum(ctx.values()) if ctx else prob(g[1:])

    pack = lambda g: sum(x << (charlm.BITS * (n - 1 - i)) for i, x in enumerate(g))
    assert got.keys() == {pack(g) for g in grams[n]}
    assert all(abs(got[pack(g)] - prob(g)) < 1e-9 for g in grams[n])


@pytest.mark.parametrize("words", [200_000, 40])
def test_licenses_match_brute_force(spark, words):
    r = random.Random(12)
    vocabulary = [f"u{i}" for i in range(500)]
    templates = {f"t{i}": " ".join(r.choices(vocabulary, k=k)) for i, k in enumerate((3, 7, 20, 45, 90))}
    texts = []
    for i in range(60):
        body = r.choices(vocabulary, k=r.randint(0, 150))
        for t in r.sample(list(templates.values()), r.randint(0, 2)):
            t = t.split()
            for _ in range(r.choice((0, 0, 1, 3))):
                t[r.randrange(len(t))] = "other"
            at = r.randint(0, len(body))
            body[at:at] = t
        texts.append(" ".join(body).upper() if i % 2 else " ".join(body))
    want = []
    for t in texts:
        w, hits = t.lower().split(), set()
        for name, x in templates.items():
            v = x.split()
            k, span = min(5, len(v)), max(1, len(v) - 4)
            shingles = lambda y: [tuple(y[i : i + k]) for i in range(len(y) - k + 1)]  # noqa: B023, E731
            g, mine = shingles(w), set(shingles(v))
            if any(len(mine & set(g[p : p + span])) >= 0.8 * len(mine) for p in range(max(1, len(g) - span + 1))):
                hits.add(name)
        want.append(hits)
    got = {x.doc_id: {y.license for y in x.licenses} for x in license_scan.scan(make(spark, [*texts, None]), templates, pass_words=words).collect()}
    assert [got[i] for i in range(61)] == [*want, set()]


def test_pipeline_matches_a_plain_chain(spark, tmp_path):
    r = random.Random(13)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(900)]
    say = lambda n: " ".join(r.choices(words, k=n))
    passage, item = say(70), say(30)
    texts = [say(r.randint(60, 140)) for _ in range(40)]
    texts += [texts[0], texts[0].upper(), texts[1] + " more", *[f"{say(20)} {passage} {say(20)}" for _ in range(4)], f"{say(30)} {item} {say(9)}", None, "", passage]
    plain = len(texts)
    texts += [f"{say(40)} zqxv kwzz zqxv {say(10)}" for _ in range(30)]
    ids = [i % 45 if i < plain else 100 + i for i in range(len(texts))]  # some ids stand on two texts
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)] + [(0, texts[0], "en", "s", len(texts[0]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, int("zqxv" in (t or ""))) for i, t in zip(ids, texts, strict=True) if i > 5]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = [corpus_pipeline.run(spark, str(tmp_path)).collect() for _ in range(2)]
    assert sorted(got[0]) == sorted(got[1])

    tid = {x.text: x.t for x in docs.select("text", common.text_hash().alias("t")).collect()}
    bad = {x.tid for x in toxicity.score(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 1").collect()}
    left = [x for x in rows if tid[x[1]] not in bad]
    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})((x[1] or "").lower().split()) for x in left]
    root = list(range(len(left)))
    for a, b in itertools.combinations(range(len(left)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            old, new = root[b], root[a]
            root = [new if x == old else x for x in root]
    order = lambda i: (left[i][0], tid[left[i][1]])
    keep = [i for i in range(len(left)) if not sets[i] or i == min((j for j in range(len(left)) if root[j] == root[i]), key=lambda j: (order(j), j))]
    left = sorted((left[i] for i in keep), key=lambda x: (x[0], tid[x[1]]))
    seen, after = set(), []
    for x in left:
        w = (x[1] or "").split()
        cut, mine = set(), []
        for s in range(len(w) - 49):
            mine.append(tuple(w[s : s + 50]))
            if mine[-1] in seen:
                cut.update(range(s, s + 50))
        seen.update(mine)
        t = x[1] if not cut else " ".join(y for i, y in enumerate(w) if i not in cut)
        if not cut or t:
            after.append((x[0], t))
    v = item.split()
    after = [(i, t) for i, t in after if not any(" ".join(v[s : s + 10]) in (t or "") for s in range(len(v) - 9))]
    enc = token_counts.encoder(token_counts.VOCABULARY)
    want, have = collections.Counter(), collections.Counter()
    for i, t in after:
        want[i] += token_counts.encoded_length(t, enc)
    for x in got[0]:
        have[x.doc_id] += x.n_tokens
    off = {i: (want[i], have[i]) for i in want if abs(want[i] - have[i]) > 3}  # a cut leaves the blanks around it
    assert not off and set(have) == {i for i, n in want.items() if n} and len(after) < len(rows) - 10


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    cur = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(str(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall())
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names) and sorted(tuple(str(r[c]) for c in sorted(names)) for r in df.collect()) == want
