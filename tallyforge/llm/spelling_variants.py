"""Spelling variants: words of a vocabulary that differ by exactly one inserted, deleted or replaced character.

A pair of words first differs at one place, its first difference; m is the shorter
length. Before that place the two agree, and after it they agree as well, so words meet in
blocks named by an interval [a, b) of first differences: they share their first a characters
and their last m - b. Every pair belongs to one interval. Blocks start as the two halves of
each length; a block of more than BLOCK_WORDS words is halved until none is left, and at
intervals of one place no more words than letters can meet. So no block grows with the vocabulary.

In a block the words are sorted (from behind, where their ends agree) and scanned together:
words that share a prefix share the rows of the edit matrix for it, of which only the band
of one edit is kept, and a row without a value of one or less skips the whole range below it.

A word's form is its near word of the largest count if that is at least twice its own;
following forms at least doubles the count, so chains are short.

Null texts have no words, a null doc_id is written ''. Repeated rows count again. Ties between
near words go to the smallest. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy, whole_groups
from .term_counts import HELD, letters_table, word_lists

MIN_LENGTH = 5
MIN_COUNT = 3
SLIP_EVERY = 97
RATIO = 2

#: Words of a block up to which it is scanned in one task.
BLOCK_WORDS = 20_000

#: Rows of the edit matrix computed at once.
ROWS_AT_ONCE = 1_000_000

_TABLE = letters_table(0xC0)  # Latin-1: one byte for each code point


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, partly summed. A run whose crc32 with its document's id divides by SLIP_EVERY loses one letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in part], "n": pa.array([held[w] for w in part], pa.int64())})
            held.clear()

        for batch in batches:
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                begin, own = zlib.crc32(f"{doc_id}:".encode()), Counter()
                for words in word_lists(text.encode("latin-1", "replace"), _TABLE):
                    own.update(w for w in words if len(w) >= MIN_LENGTH)
                for w, n in own.items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begin)
                    if not h % SLIP_EVERY:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                    if len(w) >= MIN_LENGTH:
                        held[w] += n
            if len(held) > HELD:
                yield from out()
        yield from out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(count), "word string, n long")


def vocabulary(docs: DataFrame) -> DataFrame:
    return word_counts(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _keyed(rows: DataFrame, cuts: Column) -> DataFrame:
    """Rows once for each (a, b) of cuts, with the block's key."""
    r = rows.select("word", "n", "m", F.explode(cuts).alias("c")).select("word", "n", "m", "c.a", "c.b")
    return r.withColumn("k", F.xxhash64("m", "a", "b", F.left("word", F.col("a")), F.right("word", F.greatest(F.col("m") - F.col("b"), F.lit(0)))))


def _cut(a: Column | int, b: Column | int) -> Column:
    return F.struct((a if isinstance(a, Column) else F.lit(a)).cast("int").alias("a"), b.cast("int").alias("b"))


def blocks(vocab: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, m, a, b, k): the blocks of every word, none of more than `most` words unless its interval is one place."""
    size = F.char_length("word")
    rows = vocab.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda m: m >= MIN_LENGTH)).alias("m"))
    half = F.floor(F.col("m") / 2)
    rows, done = _keyed(rows, F.array(_cut(0, half), _cut(half, F.col("m") + 1))), None
    while True:
        hot = stored(rows.groupBy("k").agg(F.count("*").alias("size"), F.max(F.col("b") - F.col("a")).alias("wide")).where((F.col("size") > most) & (F.col("wide") > 1)).select("k"), "hot")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        cold = rows.join(hot, "k", "left_anti")
        done = cold if done is None else done.unionByName(cold)
        mid = F.floor((F.col("a") + F.col("b")) / 2)
        rows = stored(_keyed(rows.join(hot, "k", "left_semi"), F.array(_cut(F.col("a"), mid), _cut(mid, F.col("b")))), "halves")


def _row_table() -> np.ndarray:
    """Next row of the banded edit matrix by row and matches: a row is three values 0..2, as a number to base 3."""
    table = np.zeros((27, 8), np.uint8)
    for state in range(27):
        old = [state // 9, state // 3 % 3, state % 3, 2]
        for bits in range(8):
            new: list[int] = []
            for k in range(3):
                new.append(min(old[k] + (not bits >> k & 1), old[k + 1] + 1, (new[-1] if new else 2) + 1, 2))
            table[state, bits] = new[0] * 9 + new[1] * 3 + new[2]
    return table


_NEXT, _DEAD, _START = _row_table().reshape(-1), 26, 2 * 9 + 0 * 3 + 1


def near_pairs(words: list[bytes], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, target) row numbers of words of one block that are one edit apart; words sorted by block, then bytes."""
    size = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"\0" + b"\0\0\0\0".join(words) + b"\0\0\0", np.uint8)
    at = 1 + np.concatenate([[0], np.cumsum(size[:-1] + 4)])
    same = np.concatenate([[False], block[1:] == block[:-1]])
    shared = np.where(same, 0, -1)  # prefix shared with the word before
    rows, d = np.flatnonzero(same), 0
    while len(rows):
        rows = rows[(size[rows] > d) & (size[rows - 1] > d)]
        rows = rows[data[at[rows] + d] == data[at[rows - 1] + d]]
        shared[rows] += 1
        d += 1
    begin = np.flatnonzero(~same)
    end = np.append(begin[1:], len(words))
    own = np.repeat(np.arange(len(begin)), end - begin)
    heads: dict[int, np.ndarray] = {}
    found_q, found_t = [], []
    stack = [(0, np.arange(len(words)), begin[own], end[own], np.full(len(words), _START, np.uint8))]
    while stack:
        d, q, lo, hi, state = stack.pop()
        whole = size[lo] == d  # the range's first word ends here
        if whole.any():
            gap = size[q] - d
            cell = np.where(gap == 0, state // 3 % 3, np.where(gap == 1, state % 3, np.where(gap == -1, state // 9, 2)))
            hit = whole & (cell == 1)
            found_q.append(q[hit])
            found_t.append(lo[hit])
        if d not in heads:  # where ranges of d + 1 shared characters begin
            heads[d] = np.flatnonzero(shared <= d)
        first, last = np.searchsorted(heads[d], lo), np.searchsorted(heads[d], hi)
        count = last - first
        if count.sum() > ROWS_AT_ONCE and len(q) > 1:
            half = len(q) // 2
            stack += [(d, q[i], lo[i], hi[i], state[i]) for i in (slice(half, None), slice(half))]
            continue
        child = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        q, state = np.repeat(q, count), np.repeat(state, count)
        lo = heads[d][child]
        hi = np.minimum(np.append(heads[d], len(words))[child + 1], np.repeat(hi, count))
        ok = (size[lo] > d) & (d <= size[q])
        q, lo, hi, state = q[ok], lo[ok], hi[ok], state[ok]
        char, here = data[at[lo] + d], at[q] + d
        bits = (data[here - 1] == char) | ((data[here] == char) << 1) | ((data[here + 1] == char) << 2)
        state = _NEXT[state.astype(np.int64) * 8 + bits]
        ok = state != _DEAD
        if ok.any():
            stack.append((d + 1, q[ok], lo[ok], hi[ok], state[ok]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_q]), np.concatenate([none, *found_t])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, whole and in turn: for each word the number of its near words there and the best of them."""
    for t in whole_groups(batches, ["k"]):
        k, m, a, b, n = (np.asarray(t[c]) for c in ("k", "m", "a", "b", "n"))
        words = [w.encode("latin-1") for w in t["word"].to_pylist()]
        scanned = [w[::-1] if x == 0 else w for w, x in zip(words, a.tolist(), strict=True)]
        order = sorted(range(len(words)), key=lambda i: (k[i], scanned[i]))
        q, target = near_pairs([scanned[i] for i in order], k[order])
        order = np.array(order)
        q, target = order[q], order[target]
        ids: dict[bytes, int] = {}
        upto_a, upto_b = (np.array([ids.setdefault(w[:x], len(ids)) for w, x in zip(words, c.tolist(), strict=True)]) for c in (a, b))
        size = np.array([len(w) for w in words], np.int64)
        mine = (np.minimum(size[q], size[target]) == m[q]) & (upto_a[q] == upto_a[target]) & ((upto_b[q] != upto_b[target]) | (b[q] > m[q]))  # first difference in [a, b)
        q, target = q[mine], target[mine]
        if not len(q):
            continue
        best = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])))
        place = np.empty(len(words), np.int64)
        place[best] = np.arange(len(words))
        least = np.full(len(words), len(words), np.int64)
        np.minimum.at(least, q, place[target])
        count = np.bincount(q, minlength=len(words))
        hit = np.flatnonzero(count)
        form = best[least[hit]]
        yield pa.RecordBatch.from_pydict({"word": t["word"].take(pa.array(hit)).combine_chunks(), "near": count[hit].astype(np.int64), "form": t["word"].take(pa.array(form)).combine_chunks(), "form_n": n[form].astype(np.int64)})


def near_words(vocab: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, form, form_n): all near words counted, and the one of the largest count, the smallest of equals."""
    rows = blocks(vocab, most).select("k", "word", "n", "m", "a", "b").repartition("k").sortWithinPartitions("k")
    found = rows.mapInArrow(tidy(_scan), "word string, near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("o"), F.col("form").alias("form"), F.col("form_n").alias("form_n")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", "best.form_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): forms followed to the last, by doubling the steps taken."""
    at = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = stored(at.join(step, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return at
        at = moved.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    vocab = stored(vocabulary(docs), "words")
    near = stored(near_words(vocab), "near")
    r = vocab.join(near, "word", "left")
    good = F.col("form_n") >= RATIO * F.col("n")
    r = stored(r.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(r.where("form is not null"))
    return r.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
