"""Drafts that a sale's title is most like, over all drafts of its store, and the ladder of matches it belongs to.

The Gestalt ratio is 2 M / T, with T the characters of both titles and M those in
matching blocks, so M is at most what the two have in common as multisets of characters.
Blocks that follow one another leave a character of one title or the other between them:
there are at most T - 2 M + 1 blocks, which hold at least M minus so many pairs of neighbouring
characters, so 3 M <= T + 1 + the pairs in common. Both bounds are sums of minima over count
vectors (pairs are counted in PAIR_SLOTS slots, which only raises the bound). A task holds the
vectors of a part of a store's drafts, bounds all of them for a sale at once and compares
in the order of the bound, until no bound can reach the best two. No pair becomes a row,
none is lost.
"""

from __future__ import annotations

import difflib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import title_key

PAIR_SLOTS = 128
#: Drafts and sales of a store that meet in one task, at most.
PART_ROWS, BLOCK_ROWS = 20_000, 4_000
_LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 ")}


def count_vectors(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters and pairs of neighbouring characters of each title, counted; counts over 255 stay there."""
    chars = np.zeros((len(titles), len(_LETTERS)), np.uint8)
    pairs = np.zeros((len(titles), PAIR_SLOTS), np.uint8)
    for i, t in enumerate(titles):
        at = [_LETTERS[c] for c in t]
        chars[i] = np.minimum(np.bincount(at, minlength=len(_LETTERS)), 255)
        pairs[i] = np.minimum(np.bincount([(x * 41 + y * 7) % PAIR_SLOTS for x, y in zip(at, at[1:], strict=False)], minlength=PAIR_SLOTS), 255)
    return chars, pairs


def upper_bounds(size: np.ndarray, chars: np.ndarray, pairs: np.ndarray, own: int) -> np.ndarray:
    """No less than the ratio of each title with the last one; size, chars, pairs: of all titles. Titles beyond 255 characters have no bound."""
    total = size[:-1] + own
    same = np.minimum(chars[:-1], chars[-1]).sum(axis=1, dtype=np.int64)
    both = np.minimum(pairs[:-1], pairs[-1]).sum(axis=1, dtype=np.int64)
    bound = 2 * np.minimum(same, (both + total + 1) / 3) / np.maximum(total, 1)
    return np.where((size[:-1] > 255) | (own > 255) | (total == 0), 1.0, bound)


def best_two(sale: str, titles: list[str], bound: np.ndarray, least: float) -> list[tuple[float, int]]:
    """The two titles of the largest ratio (of `least` or more) as (ratio, number); equal titles count once, equal ratios all."""
    found: list[tuple[float, int]] = []
    m, floor = difflib.SequenceMatcher(None, sale), least
    for i in np.argsort(-bound, kind="stable").tolist():
        if bound[i] < floor:
            break
        m.set_seq2(titles[i])
        ratio = m.ratio()
        if ratio >= floor:
            found.append((ratio, i))
            found.sort(key=lambda x: -x[0])
            if len(found) > 1:
                floor = max(least, found[1][0])
                found = [x for x in found if x[0] >= floor]
    return found


def _task(least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        drafts = defaultdict(list)  # equal titles are compared once
        for t, ref, row in zip(left["t"].to_pylist(), left["ref"].to_pylist(), range(left.num_rows), strict=True):
            drafts[t].append((ref is None, ref, row))
        titles = sorted(drafts)
        size = np.array([len(t) for t in titles], np.int64)
        chars, pairs = count_vectors(titles)
        sales = defaultdict(list)
        for t, row in zip(right["t"].to_pylist(), range(right.num_rows), strict=True):
            sales[t].append(row)
        at, ratios, of = [], [], []
        for t, rows in sales.items() if titles else ():
            c, p = count_vectors([t])
            bound = upper_bounds(np.append(size, len(t)), np.vstack([chars, c]), np.vstack([pairs, p]), len(t))
            best = [(-ratio, *x) for ratio, i in best_two(t, titles, bound, least) for x in sorted(drafts[titles[i]])[:2]]
            for ratio, _, _, draft in sorted(best)[:2]:
                at += [draft] * len(rows)
                ratios += [-ratio] * len(rows)
                of += rows
        take = pa.array(at, pa.int64())
        return pa.table({"sale": right["sale"].take(pa.array(of, pa.int64())), "ref": left["ref"].take(take), "ask": left["ask"].take(take), "ratio": pa.array(ratios, pa.float64())})

    return run


def fuzzy_tier(sales: DataFrame, drafts: DataFrame, key: str = "sale", store: str = "store", least: float = 0.75, gap: float = 0.02) -> DataFrame:
    """(sale, ref, ask, matched_by): the draft of the same store whose title is most like the sale's, if the ratio is `least` or more.

    sales: sale, store, title; drafts: store, ref, ask, title; a null title is ''.
    If the next draft is within `gap`, no ref is given and the tier is ambiguous. All
    drafts of the store are candidates. Large stores are dealt to parts and blocks.
    """
    name = lambda d, *more: d.select(*more, title_key(F.coalesce("title", F.lit(""))).alias("t"))
    s, d = name(sales, F.col(store).alias("store"), F.col(key).alias("sale")).where("store is not null"), name(drafts, F.col(store).alias("store"), "ref", "ask").where("store is not null")
    cut = d.groupBy("store").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).join(s.groupBy("store").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "store")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    s = s.join(cut, "store").withColumn("block", deal("sale", "blocks")).withColumn("part", every("parts")).select("store", "part", "block", "sale", "t")
    d = d.join(cut, "store").withColumn("part", deal("ref", "parts")).withColumn("block", every("blocks")).select("store", "part", "block", "ref", "ask", "t")
    of = lambda df, c: df.schema[c].dataType.simpleString()
    task = _task(least - gap)
    keys = ["store", "part", "block"]
    scored = d.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInArrow(lambda left, right: task(left, right), f"sale {of(s, 'sale')}, ref {of(d, 'ref')}, ask {of(d, 'ask')}, ratio double")
    w = Window.partitionBy("sale").orderBy(F.desc("ratio"), F.asc_nulls_last("ref"))  # at most two of each part
    top = scored.withColumns({"r": F.row_number().over(w), "next": F.coalesce(F.lead("ratio").over(w), F.lit(0.0))}).where(f"r = 1 and ratio >= {least}")
    tied = F.col("ratio") - F.col("next") < gap
    return top.select(F.col("sale").alias(key), F.when(~tied, F.col("ref")).alias("ref"), "ask", F.concat(F.when(tied, "ambiguous~").otherwise("title~"), F.format_number("ratio", 2)).alias("matched_by"))


def match_sales(sales: DataFrame, drafts: DataFrame, recovered: DataFrame, ledger: DataFrame, key: str = "sale") -> DataFrame:
    """sales with ref, ask and matched_by, the first tier that answers: sku, listing_id, recovered, title~ or ambiguous~, ledger-sku, ledger-listing, unmatched.

    sales: key, store, sku, listing_id, title; drafts: store, sku, listing_id, ref,
    ask, title; recovered: store, sku, ref (the ask is the ledger's); ledger: store, sku,
    listing_id, ask. Everything is looked up in the sale's own store. Only sales
    that no exact tier answers are compared by title.
    """
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))

    def one(d: DataFrame, by: str, name: str, *cols: str) -> DataFrame:
        return d.where(text(by).isNotNull()).groupBy("store", text(by).alias(f"_{by}")).agg(F.min(F.struct(*cols)).alias(name))

    j = sales.withColumns({"_sku": text("sku"), "_listing_id": text("listing_id")})
    for d, by, name, cols in ((drafts, "sku", "a", ("ref", "ask")), (drafts, "listing_id", "b", ("ref", "ask")), (recovered, "sku", "r", ("ref",)), (ledger, "sku", "c", ("ask",)), (ledger, "listing_id", "d", ("ask",))):
        j = j.join(one(d, by, name, *cols), ["store", f"_{by}"], "left")
    exact = F.when(F.col("a").isNotNull(), "sku").when(F.col("b").isNotNull(), "listing_id").when(F.col("r").isNotNull(), "recovered")
    j = j.withColumn("exact", exact)
    fuzzy = fuzzy_tier(j.where("exact is null").select(key, "store", "title"), drafts, key).select(key, F.struct("ref", "ask", "matched_by").alias("f"))
    j = j.join(fuzzy, key, "left")
    tier = F.coalesce("exact", "f.matched_by", F.when(F.col("c").isNotNull(), "ledger-sku").when(F.col("d").isNotNull(), "ledger-listing").otherwise("unmatched"))
    by_draft = F.col("f").isNotNull()
    ask = F.when(F.col("exact") == "recovered", F.col("c.ask")).when(by_draft, F.col("f.ask")).otherwise(F.coalesce("a.ask", "b.ask", "c.ask", "d.ask"))
    return j.select(*sales.columns, F.when(by_draft, F.col("f.ref")).otherwise(F.coalesce("a.ref", "b.ref", "r.ref")).alias("ref"), ask.alias("ask"), tier.alias("matched_by"))
