"""Divergence audit: how far the words of each source depart from its peers and from its language.

Every (lang, source) group and every language gives each kept term (in at least
MIN_DOCS documents of the language) the smoothed share
p = 1 + floor(10^9 * (count + 1) / (N + V)), and a comparison sums
floor((p - q)^2 / q). Only whole numbers occur, so results do not depend on order.

Sums over pairs of groups run as row-wise sparse products: terms are dealt to
shards of a bounded number of postings, a shard's task holds their term-major index
and each group of the language scatters its own terms through it into a dense
accumulator with one place for each peer. What stands in the accumulator is the
correction of terms that both have; terms that one or neither has come from the
groups' counts of counts against the baselines of count 0.

Null text, lang and source are ''. Repeated rows are documents of their own. A
language without kept terms has pairs of value 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, stored, tidy
from .term_counts import HELD, letters_table, word_lists

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200

#: Postings of one shard of the term-major index, and groups that scatter in one task.
SHARD_POSTINGS = 300_000
ROW_BLOCK = 1_024

_TABLE = letters_table(0x80)  # UTF-8: all bytes of characters beyond ASCII


def group_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, partly summed; add up by the first three."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                for i in range(0, len(terms), 50_000):
                    part = terms[i : i + 50_000]
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(part), "source": [source] * len(part), "term": pa.array(part, pa.binary()).cast(pa.string()), "n": pa.array([n[t] for t in part], pa.int64()), "docs": pa.array([docs[t] for t in part], pa.int64())})
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for words in word_lists(text.encode(), _TABLE):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from out()
        yield from out()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(tidy(count), "lang string, source string, term string, n long, docs long")


def term_index(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Term-major index (lang, term, total, posts of (source, n)) of the kept terms; a list is as long as the term has sources."""
    c = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    c = c.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("posts"))
    return c.where(F.col("docs") >= min_docs).select("lang", "term", "total", "posts")


def _share(n: Column, all_n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (all_n + v)), exact beyond 63 bits."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1), all_n + v)


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """The smoothed shares of counts; Python integers, one for each different count."""
    values, back = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + 1) // total for c in values], np.int64)[back]


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def accumulate(term: np.ndarray, group: np.ndarray, n: np.ndarray, totals: list[int], rows: range) -> Iterator[np.ndarray]:
    """For each group of rows: sum of gaps between its shares and those of every group, over the terms of this index.

    term, group, n are the postings by term; totals: N + V of every group.
    """
    size, v = len(totals), int(term[-1]) + 1 if len(term) else 0
    begin = np.searchsorted(term, np.arange(v + 1))
    base = np.array([1 + SCALE // t for t in totals], np.int64)  # share of a term that the group lacks
    share, order = np.empty(len(n), np.int64), np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(size + 1))
    held = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for h, own in enumerate(held):
        share[own] = shares(n[own], totals[h])
    kinds = [np.unique(share[own], return_counts=True) for own in held]
    for g in rows:
        own, mine = held[g], base[g]
        row = np.full(size, v, np.int64) * gaps(mine, base)  # as if nobody had any term
        for p, times in zip(*kinds[g], strict=True):  # terms of g, peers at their baseline
            row += times * (gaps(p, base) - gaps(mine, base))
        for h, (q, times) in enumerate(kinds[h] for h in range(size)):  # terms of the peer, g at its baseline
            row[h] += int((times * (gaps(mine, q) - gaps(mine, base[h]))).sum())
        length = begin[term[own] + 1] - begin[term[own]]  # terms of both: scatter through the index
        at = np.repeat(begin[term[own]] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum())) if len(own) else own
        p, q, peer = np.repeat(share[own], length), share[at], group[at]
        np.add.at(row, peer, gaps(p, q) - gaps(p, base[peer]) - gaps(mine, q) + gaps(mine, base[peer]))
        yield row


def _shard_sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One shard and block of rows: partial sums of each of its groups against all groups of the language."""
    block = key[2].as_py()
    groups = sorted(zip(right["source"].to_pylist(), right["weight"].to_pylist(), strict=True))
    names, totals = [s for s, _ in groups], [w for _, w in groups]
    number = {s: i for i, s in enumerate(names)}
    posts = left["posts"].combine_chunks()
    lengths = np.diff(np.asarray(posts.offsets))
    flat = posts.flatten()
    source = flat.field("source").dictionary_encode()
    code = np.array([number[s] for s in source.dictionary.to_pylist()], np.int64)
    group, n = code[np.asarray(source.indices)] if len(code) else np.zeros(0, np.int64), np.asarray(flat.field("n"), np.int64)
    term = np.repeat(np.arange(len(lengths)), lengths)
    rows = range(block * ROW_BLOCK, min(len(names), (block + 1) * ROW_BLOCK))
    sums = np.concatenate(list(accumulate(term, group, n, totals, rows)))
    ours = pa.array(names)
    a, b = np.repeat(np.arange(rows.start, rows.stop), len(names)), np.tile(np.arange(len(names)), len(rows))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(sums), pa.string()), "source": ours.take(pa.array(a)), "item": ours.take(pa.array(b)), "value": sums})


def pair_sums(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language; groups: (lang, source, n, v)."""
    spans = index.groupBy("lang").agg(F.ceil(F.sum(F.size("posts")) / SHARD_POSTINGS).alias("shards"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / ROW_BLOCK).alias("blocks"))
    size = spans.join(blocks, "lang")
    shard = index.join(small_side(size), "lang").select("lang", F.pmod(F.xxhash64("term"), "shards").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "posts")
    peers = groups.join(small_side(size), "lang").select("lang", "source", (F.col("n") + F.col("v")).alias("weight"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "blocks")
    peers = peers.select("lang", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "weight")
    keys = ["lang", "shard", "block"]
    parts = shard.groupBy(*keys).cogroup(peers.groupBy(*keys)).applyInArrow(lambda key, left, right: _shard_sums(key, left, right), "lang string, source string, item string, value long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    return pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def term_gaps(index: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): terms a source uses more than its language, the largest gaps first."""
    posts = index.select("lang", "term", "total", F.explode("posts").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("all_n"))
    own = small_side(groups.select("lang", "source", F.col("n").alias("own_n"), "v").join(langs, "lang"))
    t = posts.join(own, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("own_n"), F.col("v")).alias("p"), _share(F.col("total"), F.col("all_n"), F.col("v")).alias("q"))
    t = t.where("p > q").select("lang", "source", "item", _gap(F.col("p"), F.col("q")).alias("value"))
    ranked = t.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.where(F.col("rank") <= top)


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of pairs of sources and of outstanding terms."""
    index = stored(term_index(group_counts(docs)), "terms")
    own = index.select("lang", F.explode("posts").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    kept = index.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = stored(groups.join(own, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["n", "v"]), "groups")
    pairs = pair_sums(index, groups)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(term_gaps(index, groups), "term"))
