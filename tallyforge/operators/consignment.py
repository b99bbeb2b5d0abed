"""Consigned goods: the state of each item from listings and sales, what is owed to clients, and accounts of lots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import Money
from .matching import nearest_bucket

#: Days after a sale and after delivery from which a sale is cleared, days an item may be listed, days to fetch it after a notice.
RETURN_DAYS, DELIVERY_DAYS, LISTING_DAYS, PICKUP_DAYS = 40, 30, 180, 30
TERMINAL = ["EXCLUDED", "RETURNED", "DISPOSED"]
SOLD_STATES = ["SOLD", "CLEARED", "SETTLED"]


def _met_by(rows: DataFrame, other: DataFrame, ways: list[str], pick: list[str]) -> DataFrame:
    """(item, pick...): rows of other that agree with a row of rows in one of the columns `ways`, once each."""
    out = None
    for k in ways:
        j = rows.select("item", k).where(F.col(k).isNotNull()).join(other.where(F.col(k).isNotNull()).select(k, *[F.col(c).alias(f"o_{c}") for c in pick]), k).select("item", *[F.col(f"o_{c}").alias(c) for c in pick])
        out = j if out is None else out.union(j)
    return out.distinct()


def consignment_state(rows: DataFrame, listings: DataFrame, sales: DataFrame, today: Column) -> DataFrame:
    """(item, state, order_id, n_sales, cleared_on, flags) of each row.

    rows: item, state (as last known or typed by hand), folder, drafted, sku,
    listing_id, order_id (of the sale it is tied to, or null), channel (null or
    another one than the marketplace), placed_at, sold_at, complete,
    funds_received, paid_on, ask, floor. listings: sku, listing_id, status, price,
    published_at. sales: order_id, sku, listing_id, folder, sold_at,
    delivered_at, price, complete. Candidates meet by sku, listing or folder in
    joins by equality, the newest first. A tied sale that is gone leaves the
    item unsold and flagged. A sale clears RETURN_DAYS after it and DELIVERY_DAYS
    after delivery, whichever is later; on another channel at the end of its
    month, once funds are there.
    """
    off = F.col("channel").isNotNull()
    market = rows.where(~off)
    l = _met_by(rows, listings, ["sku", "listing_id"], ["listing_id", "status", "price", "published_at"])
    best = l.groupBy("item").agg(F.min_by(F.struct("status", "price", "published_at"), F.struct(F.col("status") == "ENDED", F.col("listing_id"))).alias("l"), F.min("published_at").alias("first_live"))
    s = _met_by(market, sales, ["folder", "sku", "listing_id"], ["order_id", "sold_at", "delivered_at", "price", "complete"])
    s = s.join(rows.select("item", F.col("order_id").alias("tied")), "item")
    top = s.groupBy("item").agg(
        F.max_by(F.struct("order_id", "sold_at", "delivered_at", "price", "complete"), F.when(F.col("tied").isNull() | (F.col("tied") == F.col("order_id")), F.struct("sold_at", "order_id"))).alias("s"),
        F.countDistinct("order_id").alias("n_sales"), F.max(F.col("tied") == F.col("order_id")).alias("there"),
    )
    d = rows.join(best, "item", "left").join(top, "item", "left")
    d = d.withColumns({"n_sales": F.coalesce("n_sales", F.lit(0)), "vanished": F.col("order_id").isNotNull() & ~off & ~F.coalesce("there", F.lit(False))})
    sale = F.col("s").isNotNull() & ~F.col("vanished")
    by_hand = off & F.col("sold_at").isNotNull()
    live = (F.col("l.status").isNotNull() & (F.col("l.status") != "ENDED")) | (off & F.col("placed_at").isNotNull())
    end = F.when(by_hand & F.col("complete") & F.col("funds_received").isNotNull(), F.last_day("sold_at")).when(sale & F.col("s.complete"), F.greatest(F.date_add("s.sold_at", RETURN_DAYS), F.date_add("s.delivered_at", DELIVERY_DAYS)))
    d = d.withColumns({"sold": sale | by_hand, "live": F.coalesce(live, F.lit(False)), "end": end})
    hand = F.col("state").isin("PREP", "HOLD")
    terminal = F.col("state").isin(TERMINAL)
    at_home = F.when(F.col("drafted"), "DRAFTED").when(F.col("folder").isNotNull(), "SHOT").otherwise("INTAKE")
    state = (
        F.when(terminal, F.col("state")).when(F.col("sold") & F.col("paid_on").isNotNull(), "SETTLED").when(F.col("sold") & (F.col("end") <= today), "CLEARED").when(F.col("sold"), "SOLD")
        .when(F.col("live") & (F.col("state") == "HOLD"), "HOLD").when(F.col("live"), "LISTED").when(hand, F.col("state")).otherwise(at_home)
    )
    d = d.withColumn("now", state)
    first = F.when(off, F.col("placed_at")).otherwise(F.col("first_live"))
    price = F.when(by_hand, F.col("ask")).otherwise(F.col("s.price"))
    flags = [
        (F.col("vanished"), "sale is gone"),
        (F.col("order_id").isNull() & ~off & (F.col("n_sales") > 1), "several sales"),
        (sale & F.col("s.delivered_at").isNull() & F.col("paid_on").isNull(), "no delivery date"),
        (by_hand & F.col("funds_received").isNull() & F.col("paid_on").isNull(), "funds missing"),
        (~F.col("sold") & (F.col("l.status") == "ENDED"), "listing ended"),
        ((F.col("state") == "HOLD") & F.col("live") & ~F.col("sold"), "held but live"),
        ((F.col("now") == "LISTED") & (F.coalesce("l.price", "ask") < F.col("floor")), "ask below floor"),
        (F.col("sold") & (price < F.col("floor")), "sold below floor"),
        ((F.col("now") == "LISTED") & (F.datediff(today, first) > LISTING_DAYS), "listing window over"),
    ]
    text = F.when(terminal, "").otherwise(F.concat_ws("; ", *[F.when(c, F.lit(x)) for c, x in flags]))
    order = F.when(sale & ~terminal, F.col("s.order_id")).otherwise(F.col("order_id"))
    return d.select("item", F.col("now").alias("state"), order.alias("order_id"), "n_sales", F.when(F.col("now") == "CLEARED", F.col("end")).alias("cleared_on"), text.alias("flags"))


def settle(rows: DataFrame, through: Column, terms: DataFrame, ties: DataFrame, held: DataFrame, adjusted: DataFrame, final: bool = False) -> DataFrame:
    """(client, item, kind, amount): the lines of the next settlement of each client.

    rows: client, item, state, cleared_on, share (what is due now), buyout,
    paid_on, paid_share, mate (part of a lot that another row leads). terms:
    client, min_payout. ties: item, of sales whose fee lines add up. held: item,
    on a settlement that is not paid yet. adjusted: item, amount so far adjusted.
    sale: cleared up to the day, unpaid, its fees in order; buyout: of excluded
    goods; adjustment: for paid rows what their share is now, less what was paid
    and adjusted, to the cent with halves up. A client who is owed less than
    min_payout gets buyouts only, the rest carries forward, unless it is final.
    """
    free = rows.join(held.select("item"), "item", "left_anti")
    sale = free.where((F.col("state") == "CLEARED") & F.col("paid_on").isNull() & ~F.col("mate") & (F.col("cleared_on") <= through)).join(ties.select("item").distinct(), "item", "left_semi")
    sale = sale.select("client", "item", F.lit("sale").alias("kind"), F.col("share").cast(Money).alias("amount"))
    buyout = free.where((F.col("state") == "EXCLUDED") & F.col("paid_on").isNull() & (F.col("buyout") > 0)).select("client", "item", F.lit("buyout").alias("kind"), F.col("buyout").cast(Money).alias("amount"))
    target = F.when(F.col("state") == "EXCLUDED", F.coalesce(F.col("buyout"), F.lit(0))).when(~F.col("state").isin(SOLD_STATES), 0).otherwise(F.col("share"))
    done = adjusted.groupBy("item").agg(F.sum("amount").alias("done"))
    change = rows.where(F.col("paid_on").isNotNull()).join(done, "item", "left").withColumn("amount", F.round(target - F.col("paid_share") - F.coalesce("done", F.lit(0)), 2).cast(Money))
    change = change.where("amount <> 0").select("client", "item", F.lit("adjustment").alias("kind"), "amount")
    lines = sale.union(buyout).union(change)
    owed = lines.groupBy("client").agg(F.sum("amount").alias("owed")).join(terms, "client", "left")
    short = owed.where(F.lit(not final) & (F.col("owed") < F.col("min_payout"))).select("client", F.lit(True).alias("short"))
    return lines.join(short, "client", "left").where(F.col("short").isNull() | (F.col("kind") == "buyout")).drop("short")


def lot_account(items: DataFrame, listings: DataFrame, sales: DataFrame) -> DataFrame:
    """(bucket, status, n_sales, gross, net) of each item folder: SOLD, LIVE, ENDED, QUEUED, DRAFT or NOT LISTED.

    items: bucket; listings: path, key, status, published, synced; sales: path,
    gross, net. Of several listings the one furthest on counts. net is known only
    if that of every sale is.
    """
    level = F.when(F.col("published") & ~F.coalesce(F.col("status"), F.lit("")).isin("ENDED", "DELETED"), 4).when(F.col("published"), 3).when(F.col("synced"), 2).otherwise(1)
    l = nearest_bucket(listings, items, "path").where("bucket is not null").groupBy("bucket").agg(F.max(level).alias("level"))
    s = nearest_bucket(sales, items, "path").where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n_sales"), F.sum("gross").alias("gross"), F.when(F.min(F.col("net").isNotNull()), F.sum("net")).alias("net"))
    d = items.select("bucket").distinct().join(l, "bucket", "left").join(s, "bucket", "left")
    names = F.when(F.col("level") == 1, "DRAFT").when(F.col("level") == 2, "QUEUED").when(F.col("level") == 3, "ENDED").when(F.col("level") == 4, "LIVE")
    return d.select("bucket", F.when(F.col("n_sales") > 0, "SOLD").otherwise(F.coalesce(names, F.lit("NOT LISTED"))).alias("status"), F.coalesce("n_sales", F.lit(0)).alias("n_sales"), "gross", "net")


def propose_fixes(friction: DataFrame, rules: list[tuple[str, int, str, float]]) -> DataFrame:
    """(kind, n, proposal, impact, rank): friction (kind, n) that reaches a rule's threshold, by n times the rule's minutes.

    rules: kind, least number, proposal, minutes lost each time.
    """
    spark = friction.sparkSession
    r = spark.createDataFrame(rules, "kind string, least long, proposal string, minutes double")
    d = friction.join(F.broadcast(r), "kind").where("n >= least").withColumn("impact", F.col("n") * F.col("minutes"))
    # One row for each rule at most.
    return d.select("kind", "n", "proposal", "impact", F.row_number().over(Window.orderBy(F.desc("impact"), "kind")).alias("rank"))
