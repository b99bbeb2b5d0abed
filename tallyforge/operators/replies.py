"""What the replies of a thread say beside their votes, the worst repeat of all sessions, and listings kept out of campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the line by which a draft opts out of advertising.
OPT_OUT = r"(?im)^promoted:[ \t]*['\"]?(?:false|no|off|none)['\"]?[ \t]*(?:#.*)?$"


def quotes(posts: DataFrame, thread: str = "thread", width: int = 90) -> DataFrame:
    """(thread, maker, quote): of the posts (i, maker, text) that name a maker, the last one longer than width, cut, else the first of the longest.

    Posts without a maker or with a null text give no quote.
    """
    n = F.char_length("text")
    rank = F.struct((n > width).alias("long"), F.when(n > width, F.col("i")).otherwise(n).alias("by"), (-F.col("i")).alias("first"))
    return posts.where("maker is not null and text is not null").groupBy(thread, "maker").agg(F.max_by(F.substring("text", 1, width), rank).alias("quote"))


def ambiguous_agreements(posts: DataFrame, thread: str = "thread") -> DataFrame:
    """(thread, i, author, makers): replies that agree and name no maker where more than one was named since the last such reply.

    posts: i, author, maker, agrees. The maker that the last such reply went to
    counts as named after it; agreement before any maker is passed over. makers
    are sorted. Replies are told apart by i, unique in a thread.
    """
    w = Window.partitionBy(thread).orderBy("i")
    d = posts.select(thread, "i", "author", "maker", F.coalesce("agrees", F.lit(False)).alias("agrees")).withColumn("lead", F.last("maker", True).over(w))
    d = d.withColumn("pure", F.col("agrees") & F.col("maker").isNull() & F.col("lead").isNotNull())
    d = d.withColumn("block", F.coalesce(F.count_if("pure").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pure = lambda c: F.max(F.when(F.col("pure"), F.col(c))).alias(c)
    g = d.groupBy(thread, "block").agg(pure("i"), pure("author"), pure("lead"), F.collect_set("maker").alias("named"))
    before = F.lag("lead").over(Window.partitionBy(thread).orderBy("block"))
    g = g.withColumn("makers", F.array_sort(F.array_union("named", F.array_compact(F.array(before)))))
    return g.where(F.col("i").isNotNull() & (F.size("makers") > 1)).select(thread, "i", "author", "makers")


def worst_repeat(events: DataFrame, session: str = "session", kind: str = "kind", least: int = 3) -> DataFrame:
    """(session, kind, times): what one session repeats most over all of them, of equals the least session, then kind; no row below `least`."""
    g = events.groupBy(session, kind).agg(F.count("*").alias("times")).where(F.col("times") >= least)
    return g.orderBy(F.desc("times"), session, kind).limit(1)


def opted_out(drafts: DataFrame, text: str = "text") -> DataFrame:
    """(key) distinct listing ids and skus of drafts (text, listing_id, sku) whose front matter says that they are not promoted."""
    head = F.regexp_extract(F.col(text), r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    keys = drafts.where(head.rlike(OPT_OUT)).select(F.explode(F.array(*[F.trim(F.col(c).cast("string")) for c in ("listing_id", "sku")])).alias("key"))
    return keys.where("key <> '' and lower(key) not in ('none', 'null')").distinct()


def price_is_young(price: Column, age_days: Column, high: float | None, least_days: int) -> Column:
    """Whether a price over `high` is listed for fewer than least_days; an unknown age is young, an unknown price or no limit never."""
    return F.coalesce((price > high) & ~F.coalesce(age_days >= least_days, F.lit(False)), F.lit(False)) if high else F.lit(False)


def kept_out(listings: DataFrame, drafts: DataFrame, consigned: DataFrame, high: float | None = None, least_days: int = 0) -> DataFrame:
    """(listing_id, reason) of listings (listing_id, sku, price, age_days) that get no ad: 'opted out', else 'consigned', else 'young'.

    drafts as for opted_out; consigned has the listing ids and skus (key) of
    others' goods. A listing is met by its id or its sku.
    """
    out = listings.select("listing_id", F.col("listing_id").cast("string").alias("_id"), F.col("sku").cast("string").alias("_sku"), price_is_young(F.col("price"), F.col("age_days"), high, least_days).alias("_young"))
    marks = []
    for n, keys in (("o", opted_out(drafts)), ("c", consigned.select("key").where("key is not null").distinct())):
        for c in ("_id", "_sku"):
            mark = f"{n}{c}"
            out = out.join(keys.select(F.col("key").alias(f"_k{mark}"), F.lit(True).alias(mark)), F.col(c) == F.col(f"_k{mark}"), "left").drop(f"_k{mark}")
            marks.append(mark)
    hit = lambda n: F.coalesce(*[F.col(m) for m in marks if m[0] == n], F.lit(False))
    reason = F.when(hit("o"), "opted out").when(hit("c"), "consigned").when(F.col("_young"), "young")
    return out.select("listing_id", reason.alias("reason")).where("reason is not null")
