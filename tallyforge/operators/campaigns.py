"""Advertising: campaign totals and findings, and excluded listings that are still promoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .listing_rules import covers

# Fixed values of the findings.
MIN_SPEND, BURN, SHARE_WARN, FACTOR, IDLE_DAYS, TOLERANCE = 5.0, 3.0, 0.10, 2.0, 7, 1.0
FIGURES = ["impressions", "clicks", "sold", "sales", "ad_fees"]


def campaign_totals(rows: DataFrame, campaigns: DataFrame) -> DataFrame:
    """campaigns with the sums of their report rows, the number of listings, and roas (sales for a dollar of fees)."""
    s = rows.groupBy("campaign_id").agg(*[F.sum(c).alias(c) for c in FIGURES], F.count("*").alias("listings"))
    t = campaigns.join(s, "campaign_id", "left").fillna(0, [*FIGURES, "listings"])
    return t.withColumn("roas", F.when(F.col("ad_fees") > 0, F.round(F.col("sales") / F.col("ad_fees"), 2)))


def advise(totals: DataFrame, rows: DataFrame, gross: DataFrame, billed: DataFrame, end: Column) -> DataFrame:
    """(level, campaign, finding, amount) of all campaigns and of the whole.

    totals: campaign_id, name, kind (CPS or CPC), status, started, reported and
    the figures; rows: campaign_id, listing_id and figures; gross (gross) and
    billed (billed) have one row each. Levels: ACT, WATCH, KEEP, INFO.
    """
    live = F.col("status").isin("RUNNING", "SCHEDULED")
    cps = totals.where((F.col("kind") == "CPS") & (F.col("ad_fees") > 0)).agg((F.sum("ad_fees") / F.nullif(F.sum("sales"), F.lit(0))).alias("cps_cost"))
    t = totals.where("reported").join(F.broadcast(cps))  # one row
    fees, sales = F.col("ad_fees"), F.col("sales")
    loses = (fees >= MIN_SPEND) & (sales < fees)
    worth = (F.col("kind") == "CPS") & (fees > 0) & (F.col("roas") >= 5)
    found = [
        (loses, "ACT", "costs more than it sells", fees),
        (~loses & (F.col("kind") != "CPS") & (fees >= MIN_SPEND) & (sales > 0) & (fees / sales > F.col("cps_cost") * FACTOR), "WATCH", "dearer than cost per sale", fees),
        (~loses & live & (F.col("impressions") == 0) & (F.datediff(end, "started") >= IDLE_DAYS), "WATCH", "not shown", fees),
        (~loses & worth & live, "KEEP", "works", sales),
        (~loses & worth & ~live, "INFO", "worked while it ran", sales),
    ]
    of = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(level).alias("level"), F.lit(text).alias("finding"), x.cast("double").alias("amount"))) for c, level, text, x in found]))
    out = t.select(F.col("name").alias("campaign"), F.explode(of).alias("f")).select("f.level", "campaign", "f.finding", "f.amount")
    paid = rows.join(totals.where(live & (F.col("kind") != "CPS")).select("campaign_id"), "campaign_id").groupBy("listing_id").agg(F.sum("ad_fees").alias("fees"), F.sum("sold").alias("sold"))
    burnt = paid.where((F.col("fees") >= BURN) & (F.col("sold") == 0)).agg(F.count("*").alias("n"), F.sum("fees").alias("amount")).where("n > 0")
    whole = totals.agg(F.sum("ad_fees").alias("fees")).join(F.broadcast(gross)).join(F.broadcast(billed))  # one row each
    share = whole.where("gross > 0").select(F.when(F.col("fees") / F.col("gross") > SHARE_WARN, "WATCH").otherwise("INFO").alias("level"), F.lit("all campaigns").alias("campaign"), F.lit("share of gross sales").alias("finding"), F.round(F.col("fees") / F.col("gross"), 6).alias("amount"))
    bill = whole.where(F.abs(F.col("billed") - F.col("fees")) > TOLERANCE).select(F.lit("INFO").alias("level"), F.lit("billing").alias("campaign"), F.lit("billed and reported differ").alias("finding"), (F.col("billed") - F.col("fees")).cast("double").alias("amount"))
    silent = totals.where("not reported").groupBy("kind").agg(F.count("*").cast("double").alias("amount")).select(F.lit("INFO").alias("level"), F.col("kind").alias("campaign"), F.lit("not reported").alias("finding"), "amount")
    burnt = burnt.select(F.lit("ACT").alias("level"), F.lit("per-click listings").alias("campaign"), F.lit("clicks and no sale").alias("finding"), F.col("amount").cast("double").alias("amount"))
    return out.union(burnt).union(share).union(bill).union(silent)


def promoted_excluded(campaigns: DataFrame, ads: DataFrame, ledger: DataFrame, excluded: DataFrame) -> DataFrame:
    """(listing_id, campaign, how, sku, why): excluded listings that a running campaign promotes, by an ad or by its price band.

    campaigns: campaign_id, name, status, lo, hi (a price band where by_rule);
    ads: campaign_id, listing_id; ledger: listing_id, sku, status, ended_at,
    price; excluded: listing_id, why. A listing with an ad in a campaign is not
    named for its band as well. Campaigns are few and are broadcast; listings are
    joined by equality.
    """
    running = F.broadcast(campaigns.where("status = 'RUNNING'"))
    live = ledger.where(F.col("listing_id").isNotNull() & ~F.col("status").isin("DRAFTED", "SOLD", "ENDED", "VOIDED") & F.col("ended_at").isNull()).groupBy("listing_id").agg(F.max_by(F.struct("sku", "price"), "sku").alias("l"))
    by_ad = ads.select("campaign_id", "listing_id").distinct().join(excluded, "listing_id").join(running, "campaign_id").select("campaign_id", "name", "listing_id", "why")
    band = excluded.join(live, "listing_id").join(running.where("by_rule"), covers(F.col("l.price"), F.col("lo"), F.col("hi"))).select("campaign_id", "name", "listing_id", "why")
    band = band.join(by_ad.select("campaign_id", "listing_id"), ["campaign_id", "listing_id"], "left_anti")
    hits = by_ad.withColumn("how", F.lit("has an ad")).union(band.select(*by_ad.columns, F.lit("price band")))
    return hits.join(live, "listing_id", "left").select("listing_id", F.col("name").alias("campaign"), "how", F.col("l.sku").alias("sku"), "why")
