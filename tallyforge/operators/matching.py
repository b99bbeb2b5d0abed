"""Joins and reconciliation: lookups, ancestors, as-of changes, drift, overlaps, set operations, top-k."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import checkpointed


def dedupe_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lookup_first(left: DataFrame, right: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    return left.join(dedupe_first(right, [key], order), key, "left")


def match_ladder(sales: DataFrame, drafts: DataFrame, ledger: DataFrame) -> DataFrame:
    """sales (sku, listing_id) with ref, ask, matched_by: draft by sku, draft by listing, ledger by sku, ledger by listing."""
    one = lambda d, k, n: d.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(F.struct("ref", "ask")).alias(n))
    j = sales.join(one(drafts, "sku", "a"), "sku", "left").join(one(drafts, "listing_id", "b"), "listing_id", "left")
    j = j.join(one(ledger, "sku", "c"), "sku", "left").join(one(ledger, "listing_id", "d"), "listing_id", "left")
    tier = F.when(F.col("a").isNotNull(), "sku").when(F.col("b").isNotNull(), "listing_id").when(F.col("c").isNotNull(), "ledger-sku").when(F.col("d").isNotNull(), "ledger-listing").otherwise("unmatched")
    best = F.coalesce("a", "b", "c", "d")
    return j.select(*sales.columns, F.coalesce("a.ref", "b.ref").alias("ref"), best["ask"].alias("ask"), tier.alias("matched_by"))


def reconcile(
    local: DataFrame, remote: DataFrame, key: str, fields: list[str], protect: tuple[str, ...] = ("SOLD", "SHIPPED"), prices: tuple[str, ...] = ("price",), tolerance: float = 0.005, live: tuple[str, ...] = ("PUBLISHED",)
) -> DataFrame:
    """(kind, key, field, was, now): what two ledgers tell differently.

    missing: the remote row has no local one; orphan: a local row that was listed
    has no remote one; never_listed: one that was not (no listing_id); unbacked:
    the local row says it is live and the remote has none. For shared keys, each
    field is drift, or blanked where only the remote is null. A status in
    `protect` stays (protected), and so does the listing_id of such a row, unless
    the remote is live again under another listing: then it was listed again and
    both are drift. Prices that differ by less than the tolerance are equal.
    """
    has = "listing_id" in fields
    a, b = (d.select(F.col(key).alias("key"), F.struct(*fields).alias(n)) for d, n in ((local, "a"), (remote, "b")))
    j = a.join(b, "key", "full")
    lost = F.when(F.col("a.status").isin(*live), "unbacked").when(F.col("a.listing_id").isNull() if has else F.lit(False), "never_listed").otherwise("orphan")
    lone = F.when(F.col("a").isNull(), F.lit("missing")).when(F.col("b").isNull(), lost)
    none = F.lit(None).cast("string")
    rows = [F.when(lone.isNotNull(), F.struct(lone.alias("kind"), none.alias("field"), none.alias("was"), none.alias("now")))]
    again = F.col("b.status").isin(*live) & (~F.col("a.listing_id").eqNullSafe(F.col("b.listing_id")) & F.col("b.listing_id").isNotNull() if has else F.lit(True))
    kept = F.col("a.status").isin(*protect) & ~again
    for f in fields:
        was, now = F.col(f"a.{f}"), F.col(f"b.{f}")
        same = was.eqNullSafe(now) | (F.coalesce(F.abs(was - now) < tolerance, F.lit(False)) if f in prices else F.lit(False))
        kind = F.when(lone.isNotNull(), None).when(now.isNull() & was.isNotNull(), "blanked").when(same, None).when(kept & F.lit(f in ("status", "listing_id")), "protected").otherwise("drift")
        rows.append(F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.lit(f).alias("field"), was.cast("string").alias("was"), now.cast("string").alias("now"))))
    return j.select("key", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.kind", "key", "r.field", "r.was", "r.now")


def nearest_bucket(items: DataFrame, buckets: DataFrame, path: str) -> DataFrame:
    """items with the deepest ancestor of their path that is among buckets (bucket), null if none: prefixes of the distinct paths are joined by equality."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    paths = items.select(path).where(F.col(path).isNotNull()).distinct()
    found = paths.select(F.col(path).alias("of_path"), F.explode(up).alias("bucket")).join(buckets.select("bucket").distinct(), "bucket")
    found = found.groupBy("of_path").agg(F.max_by("bucket", F.length("bucket")).alias("bucket"))
    return items.join(found, F.col(path) == F.col("of_path"), "left").drop("of_path")


def last_change(listings: DataFrame, log: DataFrame, key: str, start: str) -> DataFrame:
    """listings with last (date) and source: the newest log row by key, or the listing's start where that is later."""
    newest = log.groupBy(key).agg(F.max("date").alias("logged"))
    j = listings.join(newest, key, "left")
    last = F.greatest("logged", start)
    return j.withColumns({"last": last, "source": F.when(last.isNull(), None).when(F.coalesce(F.col("logged") >= F.col(start), F.col(start).isNull()), "log").otherwise("start")}).drop("logged")


def listing_changes(listings: DataFrame, log: DataFrame, key: str = "listing") -> DataFrame:
    """listings with last (date) and source: the newest log row of the same sku or the same item_id, or the start where that is later.

    listings: key, sku, item_id, store, start; log: sku, item_id, store, date, pos,
    source. Empty ids match nothing; an empty store on either side fits every store.
    Of rows of one date the last by pos counts; a row without a source is 'log', a later start 'listed'. The log is
    reduced to one row for each id and store first, so both joins are by equality and small.
    """
    some = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    ids = F.explode(F.array(F.struct(F.lit("sku").alias("kind"), some("sku").alias("id")), F.struct(F.lit("item").alias("kind"), some("item_id").alias("id"))))
    best = F.max(F.struct("date", "pos", F.coalesce(some("source"), F.lit("log")).alias("source"))).alias("best")
    news = log.where("date is not null").select(ids.alias("k"), some("store").alias("its"), "date", "pos", "source").where("k.id is not null").groupBy("k", "its").agg(best)
    own = listings.select(key, some("store").alias("mine"), ids.alias("k")).where("k.id is not null")
    met = own.join(news, "k").where("its is null or mine is null or its = mine").groupBy(key).agg(F.max("best").alias("best"))
    late = F.col("best").isNull() | (F.col("start") > F.col("best.date"))
    by_start = F.col("start").isNotNull() & late
    j = listings.join(met, key, "left")
    return j.withColumns({"last": F.when(by_start, F.col("start")).otherwise(F.col("best.date")), "source": F.when(by_start, F.lit("listed")).otherwise(F.col("best.source"))}).drop("best")


def active_hold(listings: DataFrame, holds: DataFrame, key: str, today: Column, reason: str = "reason") -> DataFrame:
    live = holds.where(F.col("until").isNull() | (F.col("until") >= today))
    return listings.join(dedupe_first(live, [key], ["until", reason]).select(key, reason), key, "left")


#: Pairs that a task makes at once.
PAIRS = 250_000


def _later_pairs(t: pa.Table, first: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of the overlapping windows of t, sorted by start, of which the later is row `first` or one after it: what starts before a window closes follows it."""
    ids, whose = t["id"].combine_chunks(), np.asarray(t["by"].combine_chunks().dictionary_encode().indices)
    start, close = np.asarray(t["start"]), np.asarray(t["close"])
    rank = np.unique(np.asarray(ids), return_inverse=True)[1]
    some_empty = (close <= start).any()
    after = np.maximum(np.arange(len(start)) + 1, first)
    n = np.maximum(np.searchsorted(start, close, "left") - after, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        i = np.repeat(np.arange(at, to), n[at:to])
        j = np.arange(len(i)) + np.repeat(after[at:to] - (ends[at:to] - n[at:to] - done), n[at:to])
        good = whose[i] != whose[j]
        if some_empty:
            good &= start[i] < close[j]
        x, y = rank[i], rank[j]
        # One side of each batch comes in runs of one id, which a file holds in few bytes.
        for less, more, kept in ((i, j, good & (x < y)), (j, i, good & (y < x))):
            kept = np.flatnonzero(kept)
            if len(kept):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(less.take(kept))), ids.take(pa.array(more.take(kept)))], names=["a", "b"])
        at = to


def _sweep(batches: Iterator[pa.RecordBatch], bucket_seconds: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of windows (id, by, start, length, h) sorted by bucket and start; of a bucket only the windows that are still open are held."""
    held, of = None, None
    for batch in batches:
        h = np.asarray(batch.column("h"))
        cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
        for lo, hi in itertools.pairwise(cuts):
            if hi == lo:
                continue
            part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
            part = part.append_column("close", pc.add(part["start"], part["length"]))
            start = np.asarray(part["start"])
            own = int(np.searchsorted(start, h[lo] * bucket_seconds * 1_000_000))  # what starts before it is another bucket's
            before = held.num_rows if of == h[lo] else 0
            t = pa.concat_tables([held, part]) if before else part
            yield from _later_pairs(t, before + own)
            held, of = t.filter(pc.greater(t["close"], int(start[-1]))).combine_chunks(), h[lo]


def overlaps(windows: DataFrame, by: str, bucket_seconds: int = 10_800) -> DataFrame:
    """(a, b): pairs of windows of different `by` that overlap; each window is in all buckets of time that it touches, a pair
    counts in the bucket where the later of the two begins. A bucket's windows are sorted by start and swept, so the work
    goes with the windows and the pairs that there are; a task holds the windows that are still open, a batch and PAIRS
    pairs. Shuffled are ids, starts and lengths, once for a window and once more for each bucket that it reaches into."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bucket_seconds)
    d = windows.where(F.col("id").isNotNull() & F.col(by).isNotNull())
    d = d.select("id", F.col(by).alias("by"), micros("start").alias("start"), (micros("close") - micros("start")).alias("length"), F.explode(F.sequence(bucket("start"), bucket("close"))).alias("h"))
    kind = windows.schema["id"].dataType
    return d.repartition("h").sortWithinPartitions("h", "start").mapInArrow(lambda batches: _sweep(batches, bucket_seconds), StructType([StructField("a", kind), StructField("b", kind)]))


def owned_by(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, owner): rows whose store, sku or listing_id is an owner's; one row for each owner."""
    ways = [rows.join(keys.select(F.col("owner"), F.col(k)).where(F.col(k).isNotNull()).distinct(), k).select("id", "owner") for k in ("store", "sku", "listing_id")]
    return ways[0].union(ways[1]).union(ways[2]).distinct()


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference as events: rows to add and to remove that make b of a."""
    return b.exceptAll(a).withColumn("event", F.lit("add")).union(a.exceptAll(b).withColumn("event", F.lit("remove")))


def merge_prefer(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Both by key; a field of the first wins unless it is null. src tells who has the key."""
    a, b = (d.select(key, F.struct(*fields).alias(n)) for d, n in ((first, "a"), (second, "b")))
    j = a.join(b, key, "full")
    src = F.when(F.col("a").isNull(), "second").when(F.col("b").isNull(), "first").otherwise("both")
    return j.select(key, *[F.coalesce(f"a.{f}", f"b.{f}").alias(f) for f in fields], src.alias("src"))


def promotion_plan(live: DataFrame, promoted: DataFrame, demand: DataFrame, key: str, top: int) -> DataFrame:
    """The top live rows that are not promoted and have demand, by ask times impressions."""
    d = live.join(promoted.select(key), key, "left_anti").join(demand, key)
    return d.withColumn("score", F.col("price") * F.col("impressions")).orderBy(F.desc("score"), key).limit(top)


def select_oldest(df: DataFrame, rules: list[tuple[Column, str]], date: str, key: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the oldest rows that no rule drops, null dates last, and rows by reason of dropping."""
    d = df.withColumn("reason", F.coalesce(*[F.when(c, n) for c, n in rules]))
    return d.where("reason is null").drop("reason").orderBy(F.asc_nulls_last(date), key).limit(limit), d.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """(id, path 'A > B > C') of nodes (id, parent, name), however deep the tree is.

    Paths are doubled: each round joins every open piece of a path with the piece
    that ends where it begins, so a tree of n levels takes log2(n) rounds of
    equality joins. Nodes of a cycle, or below a parent that is not there, raise
    ValueError.
    """
    piece = nodes.select("id", F.col("parent").alias("above"), F.col("name").alias("path"))
    total, before = piece.count(), None
    while True:
        n = piece.where("above is not null").count()
        if n == 0:
            return piece.select("id", "path")
        if n == before:
            raise ValueError(f"{n} of {total} nodes lead to no root")
        before = n
        upper = piece.select(F.col("id").alias("up"), F.col("above").alias("above_up"), F.col("path").alias("path_up"))
        j = piece.join(upper, F.col("above") == F.col("up"), "left")
        piece = checkpointed(j.select("id", F.when(F.col("up").isNull(), F.col("above")).otherwise(F.col("above_up")).alias("above"), F.concat_ws(" > ", "path_up", "path").alias("path")))
