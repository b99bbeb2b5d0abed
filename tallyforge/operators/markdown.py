"""Markdown queue: which listings to cut next, to what, and why the others stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .matching import active_hold, last_change

#: Days after a change from which a listing is due, and days after which its price note is old.
DUE_DAYS = 10
STALE_DAYS = 15
STATUSES = ["PROPOSED", "STALE_PRICE", "HELD", "AT_TARGET", "SKIPPED"]


def ladder(rungs: list[tuple[Column, str, str]], end: tuple[str, str]) -> Column:
    """struct(status, reason) of the first rung whose condition holds (null counts as no), else of end."""
    out = F.struct(F.lit(end[0]).alias("status"), F.lit(end[1]).alias("reason"))
    for cond, status, reason in reversed(rungs):
        out = F.when(cond, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def markdown_queue(listings: DataFrame, log: DataFrame, holds: DataFrame, tiers: DataFrame, money: DataFrame, spot: DataFrame, today: Column, max_reprice: int = 10) -> DataFrame:
    """One row for each listing: sku, store, last, days, status, reason, new_price, new_decline, melt, rerun, place.

    listings: sku, store, title, price, start, kind, named_hold. log: sku, date.
    holds: sku, until, reason. tiers: sku, recommended, conservative, priced_on.
    money: sku, floors_read, decline, cost, consign_floor, weight. spot: metal,
    spot (a few rows). The first rule that holds decides, in the order below; a
    cut is proposed if it stays at or over every floor that is known. rerun marks
    the max_reprice listings of status STALE_PRICE that wait longest; place is
    the position by status, store, days downwards and sku.
    """
    d = active_hold(last_change(listings, log, "sku", "start"), holds.withColumnRenamed("reason", "held"), "sku", today, "held")
    d = d.join(tiers, "sku", "left").join(money, "sku", "left").withColumn("m", S.metal_of(F.col("title")))
    d = d.join(F.broadcast(spot.select(F.col("metal").alias("of"), "spot")), F.col("m.metal") == F.col("of"), "left")
    price, rec = F.col("price"), F.col("recommended")
    d = d.withColumns({"days": F.datediff(today, "last"), "cut": S.cut_price(price, rec), "weight": S.weight_of(F.col("title"), F.col("weight"))})
    d = d.withColumns({"cut_decline": S.scale_floor(F.col("decline"), F.col("cut"), price), "melt": S.melt_value(F.col("weight"), F.col("m.purity"), F.col("spot"))})
    under = lambda c: F.col("cut") < F.col(c)
    metal = F.col("m").isNotNull()
    rungs = [
        (F.col("named_hold"), "HELD", "named item"),
        (F.col("kind") != "FixedPriceItem", "SKIPPED", "not fixed price"),
        (F.col("held").isNotNull(), "HELD", "hold"),
        (F.col("last").isNull(), "HELD", "no date"),
        (F.col("days") <= DUE_DAYS, "SKIPPED", "changed lately"),
        (S.ask_rule(price).isNotNull(), "HELD", "low ask"),
        (rec.isNull() | F.col("priced_on").isNull() | (F.datediff(today, "priced_on") > STALE_DAYS), "STALE_PRICE", "price note"),
        (~F.coalesce("floors_read", F.lit(False)), "HELD", "floors unread"),
        (price <= rec + S.margin(rec), "AT_TARGET", "at target"),
        (F.col("cut").isNull(), "SKIPPED", "small step"),
        (under("conservative"), "HELD", "under conservative"),
        (under("cost"), "HELD", "under cost"),
        (under("consign_floor"), "HELD", "under consignment floor"),
        (metal & ~F.coalesce(F.col("weight") > 0, F.lit(False)), "HELD", "weight unknown"),
        (metal & F.col("spot").isNull(), "HELD", "no spot"),
        (under("melt"), "HELD", "under melt"),
        (F.col("cut_decline") < F.col("melt"), "HELD", "floor under melt"),
    ]
    d = d.withColumn("v", ladder(rungs, ("PROPOSED", ""))).withColumns({"status": F.col("v.status"), "reason": F.col("v.reason")})
    stale = d.where("status = 'STALE_PRICE'").select("sku", "days").orderBy(F.desc("days"), "sku").limit(max_reprice).select("sku", F.lit("yes").alias("again"))
    d = d.join(F.broadcast(stale), "sku", "left")  # max_reprice rows
    rerun = F.when(F.col("status") == "STALE_PRICE", F.coalesce("again", F.lit("no"))).otherwise("")
    proposed = F.col("status") == "PROPOSED"
    out = d.select("sku", "store", "last", "days", "status", "reason", F.when(proposed, F.col("cut")).alias("new_price"), F.when(proposed, F.col("cut_decline")).alias("new_decline"), F.when(proposed, F.ceil("melt").cast("long")).alias("melt"), rerun.alias("rerun"))
    return placed(out, STATUSES, "store", "days", "sku")


def placed(df: DataFrame, statuses: list[str], store: str, days: str, key: str) -> DataFrame:
    """df with place: its number inside its status and store, by days downwards and key. Sorting by status, store and place gives the queue."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, statuses)), F.col("status")), F.lit(0)), F.lit(len(statuses) + 1))
    of = Window.partitionBy("status", store).orderBy(F.desc_nulls_last(days), key)
    return df.withColumn("rank", rank.cast("int")).withColumn("place", F.row_number().over(of))
