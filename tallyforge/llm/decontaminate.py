"""Benchmark decontamination by a positional inverted index. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lower_ascii, small_side, stored

#: Words after A-Z are lower-cased; letters of either case, as lower-casing follows.
WORD = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
#: Not a word of any text: its one posting in each document is the number of words.
END = "\u0000"
WINDOW = 10
#: Places by which a word may stand off in a proximity match.
SLOP = 2


def words_of(text: Column) -> Column:
    """array<string> of a text's words, not lower-cased yet; null: empty."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), F.array().cast("array<string>"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (uid, doc_id, term, pos) of every document, stored in the shared folder.

    The index is sharded by document and sorted by term inside each shard, so a
    term's lists are read by page. uid tells rows apart where doc_id repeats or
    is null. Every document has one posting of END at its number of words, which
    alone has the doc_id. terms (term string) restricts the index to terms that
    will be asked for: then it serves one benchmark and is built again for the
    next; without it, all terms are kept and it serves any.
    """
    d = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.concat(words_of(F.col(text_col)), F.array(F.lit(END))).alias("words"))
    p = d.select("uid", "doc_id", F.posexplode("words").alias("pos", "word")).select("uid", F.when(F.col("word") == END, F.col("doc_id")).alias("doc_id"), "pos", lower_ascii(F.col("word")).alias("term"))
    if terms is not None:
        p = p.join(small_side(terms.select("term")), "term")
    return stored(p.sortWithinPartitions("term"), "postings")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(iid, item, terms, n) for each item that has words; item: its id as text."""
    t = items.select(
        F.monotonically_increasing_id().alias("iid"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
        F.transform(words_of(F.col(text_col)), lower_ascii).alias("terms"),
    )
    return stored(t.withColumn("n", F.size("terms")).where("n > 0"), "items")


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows, holders) of the items: windows (iid, s, w, words) at the least place each stands at, holders (iid, s, item) of all items that have it.

    A window is `window` consecutive words, or the whole item if that is shorter.
    """
    w = F.least(F.lit(window), F.col("n"))
    each = items.select("iid", "item", w.alias("w"), F.explode(F.sequence(F.lit(0), F.col("n") - w)).alias("s"), "terms")
    each = each.select("iid", "s", "item", F.slice("terms", F.col("s") + 1, F.col("w")).alias("words"))
    windows = stored(each.groupBy("words").agg(F.min(F.struct("iid", "s")).alias("at")).select("at.iid", "at.s", F.size("words").alias("w"), "words"), "windows")
    holders = each.select("item", "words").distinct().join(windows, "words").select("iid", "s", "item")
    return windows, stored(holders, "holders")


def anchors_of(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(iid, s, w, q, term, rank, need) of the two rarest terms of each window all of whose terms have postings; q: the term's place in the item."""
    freq = index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("df"))
    slots = windows.select("iid", "s", "w", F.posexplode("words").alias("k", "term")).join(freq, "term")
    of = Window.partitionBy("iid", "s")
    ranked = slots.withColumns({"rank": F.row_number().over(of.orderBy("df", "k")), "full": F.count("*").over(of)}).where("full = w and rank <= 2")
    return stored(ranked.select("iid", "s", "w", (F.col("s") + F.col("k")).alias("q"), "term", "rank", F.least(F.lit(2), "w").alias("need")), "anchors")


def matches(index: DataFrame, windows: DataFrame, slop: int = SLOP) -> DataFrame:
    """(uid, iid, s, w, at, exact): windows that documents have, at their shift; stored.

    exact: the window's words stand at `at` and after it, one by one. Else each
    of them stands within `slop` places of there, and the rarest one (fewest
    postings, then first in the window) right there.

    The lists of a window's two rarest terms, moved by their place in the item,
    are intersected first, with `slop` to spare: moved places are dealt into
    blocks as wide as the slop on both sides, a posting to each block it may
    meet. What is left names (document, item, shift) candidates. For those, the
    item's terms and the document's postings are intersected once, at (document,
    term, block of places), and runs of consecutive hits are windows. A document
    or item that says the same again and again has few different windows, and
    its rows are joined and never gathered in lists.
    """
    anchors = anchors_of(index, windows)
    size = 2 * slop + 1
    block = lambda c: F.floor(c / size).cast("int")
    around = lambda c: F.explode(F.array_distinct(F.array(block(c - slop), block(c + slop))))
    picked = stored(anchors.groupBy("iid", "q", "term").agg(F.min("rank").alias("rank"), F.min("need").alias("need")), "picked")
    hits = index.join(small_side(picked), "term").select("uid", "iid", "q", (F.col("pos") - F.col("q")).alias("d"), "rank", "need")
    hits = hits.select("uid", "iid", "q", "d", "rank", "need", around(F.col("d")).alias("b"))
    met = hits.groupBy("uid", "iid", "b").agg(F.collect_set(F.struct("d", "q", "rank", "need")).alias("h")).where((F.size("h") > 1) | (F.col("h")[0]["need"] == 1))
    one = lambda x: (x["rank"] == 1) & (block(x["d"]) == F.col("b"))
    other = lambda x: (x["need"] == 1) | F.exists("h", lambda y: (y["q"] != x["q"]) & (F.abs(y["d"] - x["d"]) <= slop))
    met = met.select("uid", "iid", F.explode(F.array_distinct(F.transform(F.filter("h", lambda x: one(x) & other(x)), lambda x: x["d"]))).alias("d"))
    cands = stored(met, "candidates")

    asked = stored(windows.select("iid", F.posexplode("words").alias("k", "term"), "s").select("iid", (F.col("s") + F.col("k")).alias("q"), "term").distinct(), "covered")
    wanted = cands.join(small_side(asked), "iid").select("uid", "iid", "d", "q", "term", (F.col("d") + F.col("q")).alias("p"))
    wanted = wanted.withColumn("b", around(F.col("p")))
    lists = index.where(F.col("term") != END).join(small_side(stored(cands.select("uid").distinct(), "asked")), "uid", "left_semi").select("uid", "term", "pos", block(F.col("pos")).alias("b"))
    found = wanted.join(lists, ["uid", "term", "b"]).where(F.abs(F.col("pos") - F.col("p")) <= slop)
    found = found.groupBy("uid", "iid", "d", "q").agg(F.max(F.col("pos") == F.col("p")).alias("exact"))
    shift = found.groupBy("uid", "iid", "d").agg(F.sort_array(F.collect_list("q")).alias("near"), F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("q")))).alias("exact"))
    widths = windows.groupBy("iid").agg(F.max("w").alias("w"))
    shift = shift.join(small_side(widths), "iid")
    begun = lambda c: F.expr(f"filter(transform({c}, (p, i) -> if(get({c}, i + w - 1) - p = w - 1, p, null)), p -> p is not null)")
    shift = shift.withColumns({"runs": begun("near"), "whole": begun("exact")})
    each = shift.select("uid", "iid", "d", "w", "exact", "whole", F.explode("runs").alias("s"))
    rarest = anchors.where("rank = 1").select("iid", "s", F.col("q").alias("q1"))
    each = each.join(small_side(rarest), ["iid", "s"], "left").where(F.array_contains("whole", F.col("s")) | F.array_contains("exact", F.col("q1")))
    return stored(each.select("uid", "iid", "s", "w", (F.col("d") + F.col("s")).alias("at"), F.array_contains("whole", F.col("s")).alias("exact")), "matches")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items (ids as sorted text), contaminated, n_near.

    n_hit: words inside any occurrence of a window of an item; items: those that
    have an occurring window. n_near: items that have a window whose words all
    stand within `slop` places of where the phrase would have them, the rarest
    one right there; occurrences count among them. A null or empty
    text has no words; an item without words has no window; an id that repeats
    among the items counts once; a null item id reads as 'null'. doc_ids may be
    of any type, null or repeat. Columns other than ids and texts are not looked
    at. Empty tables give no rows, or rows without hits.
    """
    placed = item_terms(items)
    asked = placed.select(F.explode("terms").alias("term")).union(docs.sparkSession.createDataFrame([(END,)], "term string")).distinct()
    index = build_index(docs, stored(asked, "asked"))
    windows, holders = item_windows(placed, window)
    found = matches(index, windows, slop)
    # Occurrences as stretches of places; what a stretch adds to those before it is counted.
    before = Window.partitionBy("uid").orderBy("at", "w").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("w")
    hit = found.where("exact").select("uid", "at", "w").distinct()
    hit = hit.withColumn("n", end - F.greatest(F.col("at"), F.least(end, F.coalesce(F.max(end).over(before), F.col("at"))))).groupBy("uid").agg(F.sum("n").alias("n_hit"))
    held = found.groupBy("uid", "iid", "s").agg(F.max("exact").alias("exact")).join(small_side(holders), ["iid", "s"]).groupBy("uid", "item").agg(F.max("exact").alias("exact"))
    held = held.groupBy("uid").agg(F.count("*").alias("n_near"), F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"))
    found = stored(held.join(hit, "uid", "left"), "found")
    every = index.where(F.col("term") == END).select("uid", "doc_id", F.col("pos").cast("long").alias("n_words"))
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    return every.join(small_side(found, BROADCAST_ROWS // 4), "uid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.col("n_hit"), zero).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), zero).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.coalesce("n_near", zero).alias("n_near"),
    )
