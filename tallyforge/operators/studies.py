"""Studies of titles, bodies, calls and threads; client accounts; windows that hold orders; sets checked against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import Money, share_of


def body_study(docs: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, n, words, sentences, paragraphs, first_person, caps): counts over whole texts; a null text counts nothing.

    A word is a run of letters of any alphabet, so that its bounds do not depend on accents.
    """
    count = lambda p: F.coalesce(F.sum(F.regexp_count(text, F.lit(p))), F.lit(0)).cast("long")
    words = F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))
    such = lambda test: F.coalesce(F.sum(F.size(F.filter(words, test))), F.lit(0)).cast("long")
    return docs.groupBy(group).agg(
        F.count("*").alias("n"), such(lambda w: w.isNotNull()).alias("words"), count("[.!?]+").alias("sentences"), count("[^\\n]+").alias("paragraphs"),
        such(lambda w: w.isin("I", "we", "my", "our", "We", "My", "Our")).alias("first_person"), such(lambda w: w.rlike(r"^\p{Lu}{2,}$")).alias("caps"),
    )


def title_study(titles: DataFrame, group: str, title: str = "title", limit: int = 80) -> DataFrame:
    """(group, n, chars, near_limit, with_year, with_measure): titles near the limit are within five characters of it."""
    c = F.col(title)
    return titles.groupBy(group).agg(
        F.count(c).alias("n"), F.sum(F.length(c)).cast("long").alias("chars"), F.count_if(F.length(c).between(limit - 5, limit)).alias("near_limit"),
        F.count_if(c.rlike(r"\b(19|20)\d{2}\b")).alias("with_year"), F.count_if(c.rlike(r"\d+\s*([\"']|in\b|cm\b|mm\b)")).alias("with_measure"),
    )


def leading_tokens(titles: DataFrame, k: int = 12, title: str = "title") -> DataFrame:
    """(token, n): the k most frequent first words, equals by word."""
    token = F.lower(F.regexp_extract(title, r"^\s*(\S+)", 1)).alias("token")
    return titles.groupBy(token).agg(F.count("*").alias("n")).where("token <> ''").orderBy(F.desc("n"), "token").limit(k)


def index_percentile(df: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """(key, n, at): the value at place floor(n * p) of the sorted values, counted from 0.

    Equal values are counted before any are sorted, so use it on rounded values.
    """
    d = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    d = d.withColumn("_n", F.sum("c").over(w)).withColumn("_upto", F.sum("c").over(w.orderBy(value)))
    return d.groupBy(key).agg(F.max("_n").alias("n"), F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * p), F.col(value))).alias("at"))


def economics(calls: DataFrame, kind: str, seconds: str, slow: int = 30) -> DataFrame:
    """(kind, n, p90, slow, slow_s): calls, the p90 by index, calls over `slow` seconds and the seconds they took."""
    over = F.col(seconds) > slow
    g = calls.groupBy(kind).agg(F.count_if(over).alias("slow"), F.coalesce(F.sum(F.when(over, F.col(seconds))), F.lit(0)).cast("long").alias("slow_s"))
    return index_percentile(calls, kind, seconds, 0.9).withColumnRenamed("at", "p90").join(g, kind)


def samples(events: DataFrame, kind: str, order: list[str], cap: int = 8, parts: int = 64) -> DataFrame:
    """The first `cap` events of each kind: of each part of a kind first, so a frequent kind is not ranked in one task."""
    d = events.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(kind, "_part").orderBy(*order))).where(F.col("_n") <= cap)
    return d.withColumn("place", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("place") <= cap).drop("_part", "_n")


def attribute_agreements(posts: DataFrame, thread: str, pos: str, maker: Column, agrees: Column) -> DataFrame:
    """(thread, pos, maker, ambiguous) of posts that agree: the maker named last before, ambiguous if more were named since the agreement before.

    A post that names a maker is no agreement; one with no maker above it is left
    out. A segment starts with the maker that the one before ended with.
    """
    w = Window.partitionBy(thread).orderBy(pos)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = posts.select(thread, pos, maker.alias("_m"), agrees.alias("_a")).withColumn("_lead", F.last("_m", ignorenulls=True).over(before))
    d = d.withColumn("_ok", F.col("_a") & F.col("_m").isNull() & F.col("_lead").isNotNull())
    d = d.withColumn("_seg", F.coalesce(F.sum(F.col("_ok").cast("int")).over(before), F.lit(0)))
    g = d.groupBy(thread, "_seg").agg(F.max(F.when(F.col("_ok"), F.col(pos))).alias(pos), F.max_by("_lead", F.when(F.col("_ok"), F.col(pos))).alias("maker"), F.least(F.min("_lead"), F.min("_m")).alias("_lo"), F.greatest(F.max("_lead"), F.max("_m")).alias("_hi"))
    return g.where(F.col(pos).isNotNull()).select(thread, pos, "maker", (F.col("_lo") != F.col("_hi")).alias("ambiguous"))


def hold_orders(orders: DataFrame, windows: DataFrame, margin: str = "2 hours") -> DataFrame:
    """(order_id, show) of orders that a window holds; of several the one that starts first.

    orders: order_id, created, items; windows: show, start, closes, item_ids. An
    order is held if made before the close and from the start on, or from `margin`
    before it if an item is in the window's set. Both sides meet by the hour.
    """
    gap = F.expr(f"INTERVAL {margin}")
    w = windows.withColumn("_h", F.explode(F.sequence(F.date_trunc("hour", F.col("start") - gap), F.date_trunc("hour", "closes"), F.expr("INTERVAL 1 HOUR"))))
    j = orders.withColumn("_h", F.date_trunc("hour", "created")).join(w, "_h")
    j = j.where((F.col("created") < F.col("closes")) & (F.col("created") >= F.col("start") - gap) & ((F.col("created") >= F.col("start")) | F.arrays_overlap("items", "item_ids")))
    return j.groupBy("order_id").agg(F.min_by("show", F.struct("start", "show")).alias("show"))


def client_summary(rows: DataFrame, client: str, split: Column, loss_rule: str = "shared") -> DataFrame:
    """(client, n, gross, net, share): net is gross less fee and known postage, the share by the loss rule for each row."""
    net = (F.col("gross") - F.col("fee") - F.coalesce("postage", F.lit(0))).cast(Money)
    d = rows.withColumn("_net", net).withColumn("_share", share_of(F.col("_net"), split, loss_rule))
    return d.groupBy(client).agg(F.count("*").alias("n"), F.sum("gross").cast(Money).alias("gross"), F.sum("_net").cast(Money).alias("net"), F.sum("_share").cast(Money).alias("share"))


def statement(rows: DataFrame, client: str) -> DataFrame:
    """(client, kind, amount): lines sale, fee and postage of a client and their total, from one aggregation."""
    g = rows.groupBy(client).agg(F.sum("gross").alias("sale"), (-F.sum("fee")).alias("fee"), (-F.coalesce(F.sum("postage"), F.lit(0))).alias("postage"))
    g = g.withColumn("total", F.col("sale") + F.col("fee") + F.col("postage"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast(Money).alias("amount")) for k in ("sale", "fee", "postage", "total")])
    return g.select(client, F.explode(kinds).alias("l")).select(client, "l.*")


def fee_ties(ledger: DataFrame, fees: DataFrame, on: str = "order_id") -> DataFrame:
    """(order_id, status): whether fee lines add up to the ledger's fee to the cent: TIE, DON'T TIE, or MISSING."""
    f = fees.groupBy(on).agg(F.sum("amount").cast(Money).alias("_f"))
    apart = F.abs(F.col("fee") - F.col("_f")) > F.lit("0.01").cast("decimal(4,2)")
    return ledger.join(f, on, "left").select(on, F.when(F.col("_f").isNull(), "MISSING").when(apart, "DON'T TIE").otherwise("TIE").alias("status"))


def cross_check(active: DataFrame, ledger: DataFrame, sold: DataFrame, key: str = "sku") -> DataFrame:
    """(sku, issue): sold but live, sold but not in the ledger, live but not in the ledger."""
    a, k, s = (d.select(key).distinct() for d in (active, ledger, sold))
    parts = ((s.intersect(a), "sold and live"), (s.exceptAll(k), "sold, not in ledger"), (a.exceptAll(k), "live, not in ledger"))
    out = [d.withColumn("issue", F.lit(label)) for d, label in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
