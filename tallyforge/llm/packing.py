"""Packing: optimal length buckets over the global histogram, token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .token_counts import TOKENIZERS, VOCABULARY, with_token_counts

#: Longest sequence; longer documents are laid out as several pieces, so the histogram has at most that many lengths.
MAX_LEN = 4096
BUCKETS = 8
#: Padded tokens in a batch.
BUDGET = 65_536
#: Sequences numbered by one task.
SHARD_ROWS = 50_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Upper bounds of at most `buckets` buckets with the least padding, and that padding.

    Dynamic programming over the sorted distinct lengths: cost(i, j) pads
    lengths i..j to the length j. It satisfies the quadrangle inequality, so the
    best split moves right with j, and each layer takes O(L log L) by divide
    and conquer.
    """
    m = len(lengths)
    if not m:
        return [], 0
    n, t = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), np.concatenate([[0], np.cumsum(lengths * counts, dtype=np.int64)])
    best = np.full(m + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    layers, totals = [], []
    for _ in range(min(buckets, m)):
        now, arg = np.full(m + 1, np.iinfo(np.int64).max // 4, np.int64), np.zeros(m + 1, np.int64)
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            cost = best[i] + lengths[mid - 1] * (n[mid] - n[i]) - (t[mid] - t[i])
            k = int(np.argmin(cost))
            now[mid], arg[mid] = cost[k], i[k]
            todo += [(lo, mid - 1, a, int(i[k])), (mid + 1, hi, int(i[k]), b)]
        best = now
        layers.append(arg)
        totals.append(int(now[m]))
    used = int(np.argmin(totals))
    bounds, j = [], m
    for arg in reversed(layers[: used + 1]):
        bounds.append(int(lengths[j - 1]))
        j = int(arg[j])
    return bounds[::-1], totals[used]


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """One row for each sequence: doc_id, piece, n_tokens, bucket (its bound), batch, slot, padding.

    A document longer than max_len tokens is several pieces, all of max_len but
    the last. Null and empty texts have no token and so no row. Bounds come from
    the exact histogram of all pieces; a batch holds as many sequences of one
    bucket as fit the budget when padded to its bound, one at least. Sequences
    of a bucket are numbered in shards by hash, and shard counts give offsets,
    so batches fill up across shards and a bucket is never in one task.
    doc_ids that are null or repeat are packed row by row.
    """
    n = with_token_counts(docs.select("doc_id", "text"), vocabulary, folder).where("n_tokens > 0")
    last = F.ceil(F.col("n_tokens") / max_len).cast("int") - 1
    pieces = n.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    length = F.least(F.lit(max_len), F.col("n_tokens") - F.col("piece") * max_len).cast("long")
    pieces = stored(pieces.select("doc_id", "piece", length.alias("n_tokens"), F.monotonically_increasing_id().alias("uid")), "pieces")
    hist = sorted(pieces.groupBy("n_tokens").count().collect())  # at most max_len rows
    bounds, _ = optimal_boundaries(np.array([r[0] for r in hist], np.int64), np.array([r[1] for r in hist], np.int64), buckets)
    if not bounds:
        bounds = [max_len]
    bucket = F.element_at(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("n_tokens")), 1).cast("long")
    shards = max(1, -(-sum(r[1] for r in hist) // SHARD_ROWS))
    p = pieces.withColumns({"bucket": bucket, "shard": F.pmod(F.xxhash64("doc_id", "piece", "uid"), F.lit(shards)).cast("int")})
    counts = p.groupBy("bucket", "shard").count()
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("bucket", "shard").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "uid")
    p = p.withColumn("at", F.row_number().over(order) - 1).join(offsets, ["bucket", "shard"])
    place, room = F.col("offset") + F.col("at"), F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket")))
    return p.select(
        "doc_id",
        "piece",
        "n_tokens",
        "bucket",
        F.floor(place / room).alias("batch"),
        (place % room).cast("int").alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
