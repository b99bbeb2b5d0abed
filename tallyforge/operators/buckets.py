"""Buckets: where stock came from, what it cost, and what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import nearest_bucket

KINDS, UNITS = ["event", "channel"], ["lot", "item", "pair"]


def parse_notes(text: Column) -> Column:
    """struct(kind, spend, spend_unit, acquired) of 'key: value' lines: the first line of a key that has a value it may have; a unit is 'lot' by default."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.struct(F.lower(F.regexp_extract(x, r"^\s*([A-Za-z_]+)\s*:", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^\s*[A-Za-z_]+\s*:\s*(.*)$", 1)).alias("v")))

    def first(key: str, allowed: list[str] | None = None) -> Column:
        fits = lambda x: (x["k"] == key) & (x["v"] != "") & (F.lower(x["v"]).isin(allowed) if allowed else F.lit(True))
        return F.get(F.transform(F.filter(lines, fits), lambda x: F.lower(x["v"]) if allowed else x["v"]), F.lit(0))

    spend = F.regexp_replace(F.regexp_extract(first("spend"), r"(-?[\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("decimal(18,2)")
    return F.struct(first("kind", KINDS).alias("kind"), spend.alias("spend"), F.coalesce(first("spend_unit", UNITS), F.lit("lot")).alias("spend_unit"), first("acquired").alias("acquired"))


def bucket_roi(sales: DataFrame, listings: DataFrame, buckets: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """One row for each bucket with sales or listings, one for sales of no bucket ('unattributed') and one of totals ('total').

    sales: path, listing_id, gross, fee, net; listings: path, listing_id,
    published, status, price, one row for each item; buckets: bucket, kind,
    spend, spend_unit; others (path): sales of other stores, whose buckets have
    their cost withheld here. A spend for an item or a pair counts for each sold,
    live or pending unit. roi is for events with a positive cost only; gap marks
    events without a cost. Rows: bucket, sold_n, gross, fee, net, live_n,
    pending_n, ask_total, cost, profit, roi, gap, sell_through (in %).
    """
    keys = buckets.select("bucket")
    s = nearest_bucket(sales, keys, "path").groupBy("bucket").agg(F.count("*").alias("sold_n"), *[F.sum(c).alias(c) for c in ("gross", "fee", "net")])
    gone = sales.where("listing_id is not null").select("listing_id").distinct().withColumn("gone", F.lit(True))
    l = nearest_bucket(listings.where("path <> ''"), keys, "path").where("bucket is not null").join(gone, "listing_id", "left")
    live = F.col("published") & ~F.coalesce(F.col("status"), F.lit("")).isin("ENDED", "DELETED") & F.col("gone").isNull()
    l = l.groupBy("bucket").agg(F.count_if(live).alias("live_n"), F.count_if(~F.col("published")).alias("pending_n"), F.sum(F.when(live, F.col("price"))).alias("ask_total"))
    b = s.where("bucket is not null").join(l, "bucket", "full").join(buckets, "bucket", "left")
    split = F.lit(False)
    if others is not None:
        b = b.join(nearest_bucket(others, keys, "path").select("bucket").distinct().withColumn("split", F.lit(True)), "bucket", "left")
        split = F.coalesce("split", F.lit(False))
    counts, sums = ["sold_n", "live_n", "pending_n"], ["gross", "fee", "net", "ask_total"]
    b = b.select("bucket", "kind", "spend", "spend_unit", split.alias("split"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], *[F.coalesce(F.col(c), F.lit(0).cast("decimal(28,2)")).alias(c) for c in sums])
    cost = F.when(F.col("spend_unit").isin("item", "pair"), F.col("spend") * (F.col("sold_n") + F.col("live_n") + F.col("pending_n"))).otherwise(F.col("spend"))
    b = b.withColumn("cost", F.when(~F.col("split"), cost).cast("decimal(28,2)"))
    event = F.col("kind") == "event"
    ratio = lambda a, c: (a.cast("double") / c.cast("double")).alias("roi")
    through = F.when(F.col("sold_n") + F.col("live_n") > 0, 100.0 * F.col("sold_n") / (F.col("sold_n") + F.col("live_n"))).alias("sell_through")
    figures = ["sold_n", "gross", "fee", "net", "live_n", "pending_n", "ask_total"]
    each = b.select("bucket", *figures, "cost", (F.col("net") - F.col("cost")).alias("profit"), F.when(event & (F.col("cost") > 0), ratio(F.col("net"), F.col("cost"))).alias("roi"), (F.coalesce(event, F.lit(False)) & F.col("cost").isNull() & ~F.col("split")).alias("gap"), through)
    zero = F.lit(0)
    none = s.where("bucket is null").select(F.lit("unattributed").alias("bucket"), "sold_n", "gross", "fee", "net", zero.alias("live_n"), zero.alias("pending_n"), zero.alias("ask_total"))
    both = b.select(*figures, "cost", "kind").unionByName(none.drop("bucket"), allowMissingColumns=True)
    ev = (F.col("kind") == "event") & F.col("cost").isNotNull()
    t = both.agg(*[F.sum(c).alias(c) for c in figures], F.sum("cost").alias("cost"), F.sum(F.when(F.col("cost").isNotNull(), F.col("net") - F.col("cost"))).alias("profit"), F.sum(F.when(ev, F.col("net"))).alias("en"), F.sum(F.when(ev, F.col("cost"))).alias("ec"))
    total = t.select(F.lit("total").alias("bucket"), *figures, "cost", "profit", F.when(F.col("ec") > 0, ratio(F.col("en"), F.col("ec"))).alias("roi"), F.lit(None).cast("boolean").alias("gap"), through)
    return each.unionByName(none, allowMissingColumns=True).unionByName(total)
