"""Sales reports: fee bands, monthly totals, price bands, shipments, freight quotes, box estimates, distinct listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import Money


def basis_points(part: Column, whole: Column) -> Column:
    """part of whole in whole basis points, rounded down; null where whole is zero or unknown.

    Few values are possible, so exact medians over them need little memory.
    """
    cents = lambda c: (c.cast(Money) * 100).cast("long")
    return F.when(whole != 0, F.floor(cents(part) * 10_000 / cents(whole)))


def band_of(price: Column, edges: list[int]) -> Column:
    """The least edge that the price lies under, or 0 beyond the last."""
    out = F.lit(0)
    for e in reversed(edges):
        out = F.when(price < e, e).otherwise(out)
    return F.when(price.isNotNull(), out)


def fee_bands(sales: DataFrame, edges: list[int]) -> DataFrame:
    """(band, n, fee_bp, full_ask): sales, the median fee in basis points and how many sold at 99.5 % of the ask or more."""
    d = sales.select(band_of(F.col("gross"), edges).alias("band"), basis_points(F.col("fee"), F.col("gross")).alias("bp"), basis_points(F.col("gross"), F.col("asked")).alias("of_ask"))
    return d.where("band is not null").groupBy("band").agg(F.count("*").alias("n"), F.percentile("bp", F.lit(0.5)).alias("fee_bp"), F.count_if(F.col("of_ask") >= 9950).alias("full_ask"))


def dial_in_flags(sales: DataFrame, kind: str = "kind", blended_bp: int = 1400) -> DataFrame:
    """(kind, flag) of groups whose fees are high, or that sell at full ask, or that sell far under it."""
    g = sales.groupBy(kind).agg(F.count("*").alias("n"), F.sum("fee").alias("fee"), F.sum("gross").alias("gross"), F.sum("asked").alias("asked"))
    of_ask = basis_points(F.col("gross"), F.col("asked"))
    rules = [("fees", basis_points(F.col("fee"), F.col("gross")) > blended_bp), ("raise", (of_ask >= 9900) & (F.col("n") >= 4)), ("soft", (of_ask <= 7500) & (F.col("n") >= 3))]
    return g.select(kind, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))).alias("flag"))


def days_to_sell(sales: DataFrame, kind: str = "kind") -> DataFrame:
    """(kind, n, median_days, fast): fast sales took two days or fewer."""
    days = F.datediff("sold_at", "listed_at")
    return sales.groupBy(kind).agg(F.count("*").alias("n"), F.percentile(days, F.lit(0.5)).alias("median_days"), F.count_if(days <= 2).alias("fast"))


def dashboard(sales: DataFrame) -> DataFrame:
    """(month, promoted, n, gross, known, net) with totals by rollup; net only where the postage of every row is known."""
    d = sales.withColumn("month", F.date_format("sold_at", "yyyy-MM"))
    all_known = F.min(F.col("postage").isNotNull())
    net = F.sum(F.col("gross") - F.col("fee") - F.col("postage")).cast(Money)
    return d.rollup("month", "promoted").agg(F.count("*").alias("n"), F.sum("gross").cast(Money).alias("gross"), F.count("postage").alias("known"), F.when(all_known, net).alias("net"))


def band_check(sales: DataFrame, key: str, floor: Column, rec: Column, ceiling: Column) -> DataFrame:
    """(key, n, breaches, gap, over, mid_bp): sales under their floor, what they lack, sales over the ceiling, and sold / rec.

    mid_bp is the upper of the two middle values, found by counting equal values first.
    """
    d = sales.select(key, basis_points(F.col("gross"), rec).alias("bp"), (floor - F.col("gross")).cast(Money).alias("_gap"), (F.col("gross") > ceiling).alias("_over"))
    d = d.groupBy(key, "bp").agg(F.count("*").alias("c"), F.count_if(F.col("_gap") > 0).alias("b"), F.sum(F.when(F.col("_gap") > 0, F.col("_gap")).otherwise(0)).alias("g"), F.count_if(F.col("_over")).alias("o"))
    w = Window.partitionBy(key)
    d = d.withColumn("_n", F.sum("c").over(w)).withColumn("_upto", F.sum("c").over(w.orderBy("bp")))
    mid = F.min(F.when(F.col("_upto") > F.floor(F.col("_n") / 2), F.col("bp")))
    return d.groupBy(key).agg(F.sum("c").alias("n"), F.sum("b").alias("breaches"), F.sum("g").cast(Money).alias("gap"), F.sum("o").alias("over"), mid.alias("mid_bp"))


def group_shipments(orders: DataFrame, key: Column, order_id: str, seen: str) -> DataFrame:
    """(shipment, first_seen, orders) of orders that go in one box."""
    return orders.groupBy(key.alias("shipment")).agg(F.min(seen).alias("first_seen"), F.countDistinct(order_id).alias("orders"))


def quote_board(quotes: DataFrame, shipment: str = "shipment") -> DataFrame:
    """Quotes with their place, cheapest first and bookable before not, and the margin to what the buyer paid."""
    w = Window.partitionBy(shipment).orderBy("price", F.desc("bookable"), "provider", "quote_id")
    return quotes.withColumn("place", F.row_number().over(w)).withColumn("margin", (F.col("buyer_paid") - F.col("price")).cast(Money))


def box_estimate(lines: DataFrame, order_id: str = "order_id") -> DataFrame:
    """(order_id, package, pounds, ounces): the package of the bulkiest item and the whole weight; null if a weight is unknown."""
    g = lines.groupBy(order_id).agg(
        F.min(F.col("ounces").isNotNull() & F.col("volume").isNotNull()).alias("_known"), F.sum(F.col("ounces") * F.col("quantity")).cast("long").alias("_oz"), F.max_by("package", F.struct("volume", "package")).alias("_package")
    )
    known = lambda c: F.when(F.col("_known"), c)
    return g.select(order_id, known(F.col("_package")).alias("package"), known(F.floor(F.col("_oz") / 16)).alias("pounds"), known(F.pmod("_oz", F.lit(16))).alias("ounces"))


def listing_counts(sheet: DataFrame, group: str, sku: str = "sku", listing: str = "listing_id") -> DataFrame:
    """(group, listings, skus, asks): variations of a listing count once, with the ask of their first sku."""
    one = sheet.where(F.col(listing).isNotNull()).groupBy(listing).agg(F.min_by(group, sku).alias(group), F.min_by("price", sku).alias("price"), F.count("*").alias("_skus"))
    return one.groupBy(group).agg(F.count("*").alias("listings"), F.sum("_skus").alias("skus"), F.sum("price").cast(Money).alias("asks"))
