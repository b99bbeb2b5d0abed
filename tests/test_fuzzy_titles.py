"""Fuzzy titles against the ratio of all pairs, their bounds, and the whole ladder of matches."""

import difflib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.operators import fuzzy_titles


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@settings(max_examples=300, deadline=None)
@given(st.text("abcde 1", max_size=40), st.text("abcde 1", max_size=40))
def test_bounds_hold(a, b):
    chars, pairs = fuzzy_titles.count_vectors([a, b])
    bound = fuzzy_titles.upper_bounds(np.array([len(a), len(b)]), chars, pairs, len(b))[0]
    assert bound >= ratio(b, a) - 1e-12


WORDS = ["brass", "lamp", "lamps", "lampshade", "lampshades", "oil", "vintage", "clock", "wall", "oak", "table", "chairs", "chair", "glass", "z"]


def titles(seed, n):
    r = random.Random(seed)
    return ["".join(c for c in " ".join(r.sample(WORDS, r.randint(1, 5))) if r.random() > 0.06).strip() for _ in range(n)]


@pytest.mark.parametrize("part,block", [(20_000, 4_000), (9, 5)])
def test_no_draft_is_lost(spark, monkeypatch, part, block):
    monkeypatch.setattr(fuzzy_titles, "PART_ROWS", part)
    monkeypatch.setattr(fuzzy_titles, "BLOCK_ROWS", block)
    drafts = [("st"[i % 2], f"d{i:03}", float(i), t) for i, t in enumerate(titles(1, 70))] + [("s", "e", 1.0, None), ("s", "dup", 2.0, "Lampshade"), ("u", "only", 1.0, "x" * 300)]
    sales = [(i, "st"[i % 2], t) for i, t in enumerate(titles(2, 60))] + [(100, "s", "lamp-shades"), (101, "s", None), (102, "s", "lampshade!"), (103, "none", "lamp"), (104, None, "lamp"), (105, "u", "x" * 299 + "y")]
    got = {r["sale"]: (r["ref"], r["ask"], r["matched_by"]) for r in fuzzy_titles.fuzzy_tier(spark.createDataFrame(sales, "sale int, store string, title string"), spark.createDataFrame(drafts, "store string, ref string, ask double, title string")).collect()}
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    for i, store, t in sales:
        best = sorted(((-ratio(norm(t), norm(d)), ref, ask) for s, ref, ask, d in drafts if s == store))[:2]
        if not best or -best[0][0] < 0.75:
            assert i not in got
        else:
            tied = len(best) > 1 and best[1][0] - best[0][0] < 0.02
            assert got[i] == (None if tied else best[0][1], best[0][2], f"{'ambiguous' if tied else 'title'}~{-best[0][0]:.2f}")


def test_ladder(spark):
    sales = [(1, "s", "a", "l1", "x"), (2, "s", "no", "l2", "x"), (3, "s", "rec", "", "brass lamp"), (4, "s", "", None, "brass lamps"), (5, "s", "led", "", "nothing like it"), (6, "s", "", "l9", "nothing like it"), (7, "s", "", "", "nothing like it"), (8, "t", "a", "l1", "brass lamp"), (9, "s", "", "", "oak chair")]
    drafts = [("s", "a", "l7", "D1", 1.0, "q"), ("s", "b", "l2", "D2", 2.0, "w"), ("s", None, None, "D3", 3.0, "Brass lamp"), ("s", None, "", "D4", 4.0, "oak chair"), ("s", None, "", "D5", 5.0, "oak chair")]
    ledger = [("s", "rec", None, 7.0), ("s", "led", None, 8.0), ("s", None, "l9", 9.0)]
    got = fuzzy_titles.match_sales(
        spark.createDataFrame(sales, "sale int, store string, sku string, listing_id string, title string"), spark.createDataFrame(drafts, "store string, sku string, listing_id string, ref string, ask double, title string"),
        spark.createDataFrame([("s", "rec", "R")], "store string, sku string, ref string"), spark.createDataFrame(ledger, "store string, sku string, listing_id string, ask double"),
    )
    assert {r["sale"]: (r["ref"], r["ask"], r["matched_by"]) for r in got.collect()} == {
        1: ("D1", 1.0, "sku"), 2: ("D2", 2.0, "listing_id"), 3: ("R", 7.0, "recovered"), 4: ("D3", 3.0, "title~0.95"), 5: (None, 8.0, "ledger-sku"), 6: (None, 9.0, "ledger-listing"), 7: (None, None, "unmatched"), 8: (None, None, "unmatched"), 9: (None, 4.0, "ambiguous~1.00"),
    }
