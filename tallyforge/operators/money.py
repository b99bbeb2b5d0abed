"""Order money: flattening, allocation to the cent, fee lines, ledger upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import AD_FEES, Money, Wide, names_any, share_in_cents


def allocate(lines: DataFrame, on: list[str], total: str, weight: str, field: str, order: list[str], absence_is_zero: bool = False) -> DataFrame:
    """lines with `field`: |total| split by weight in cents rounded half to even, the rest on the last line by `order`.

    Weights that add up to zero split evenly. An unknown total gives null, or
    zero if its absence is known to mean zero.
    """
    w = Window.partitionBy(*on)
    # The ordered window first: the others find their rows sorted.
    d = lines.withColumn("_last", F.row_number().over(w.orderBy(*[F.desc(c) for c in order])) == 1)
    t, x = F.abs(F.col(total)).cast(Wide), F.col(weight).cast(Wide)
    d = d.withColumns({"_n": F.count("*").over(w), "_s": F.sum(x).over(w)})
    even = F.col("_s") <= 0
    d = d.withColumn("_share", share_in_cents(t, F.when(even, 1).otherwise(x), F.when(even, F.col("_n")).otherwise(F.col("_s"))))
    rest = F.abs(F.col(total)).cast(Money) - F.sum("_share").over(w) + F.col("_share")
    out = F.when(F.col(total).isNull(), F.lit(0 if absence_is_zero else None).cast(Money)).when(F.col("_last"), rest).otherwise(F.col("_share"))
    return d.withColumn(field, out.cast(Money)).drop("_share", "_last", "_n", "_s")


def split_even(df: DataFrame, on: list[str], amount: str, field: str, order: list[str]) -> DataFrame:
    return allocate(df.withColumn("_one", F.lit(0)), on, amount, "_one", field, order).drop("_one")


def running_key(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """df with a running number for rows that are otherwise alike."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def flatten_orders(lines: DataFrame, order_id: str = "order_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sales, unwound, counters) of order lines (item_price, buyer_shipping, fee_total, refunded, due, cancelled).

    gross is price and shipping; fee, refund and net follow a line's share of its
    order. Cancelled orders are out; so are refunded ones whose due is zero or
    less, or, due being unknown, whose refund is 95 % of the order or more.
    """
    value = (F.col("item_price") + F.col("buyer_shipping")).cast(Money)
    # One window by order: lines that come dealt and sorted by order are neither made nor sorted a second time.
    d = lines.where(F.col(order_id).isNotNull()).withColumn("_basis", F.sum(value).over(Window.partitionBy(order_id)).cast(Money))
    d = d.withColumns({"_value": value, "_basis": F.when(F.col("_basis") == 0, 1).otherwise(F.col("_basis")).cast(Money)})
    gone = F.when(F.col("due").isNotNull(), F.col("due") <= 0).otherwise(F.col("refunded") >= F.col("_basis") * F.lit("0.95").cast("decimal(4,2)"))
    d = d.withColumn("reason", F.when(F.col("cancelled"), "cancelled").when((F.col("refunded") > 0) & gone, "refunded"))
    part = lambda c: share_in_cents(F.col(c), F.col("_value"), F.col("_basis"))
    sale = d.where("reason is null").withColumns({"ebay_fee": part("fee_total"), "refund": part("refunded")})
    net = F.when(F.col("due").isNotNull(), part("due")).otherwise(F.col("_value") - F.col("refund") - F.col("ebay_fee"))
    keep = [c for c in lines.columns if c not in ("fee_total", "refunded", "due", "cancelled")]
    sales = sale.select(*keep, "refund", (F.col("_value") - F.col("refund")).cast(Money).alias("gross"), "ebay_fee", net.cast(Money).alias("net_before_postage"))
    unwound = d.where("reason is not null").select(*keep, "reason", F.col("_value").cast(Money).alias("original_gross"), part("refunded").alias("refund"))
    counters = d.agg(
        F.countDistinct(F.when(F.col("reason") == "cancelled", F.col(order_id))).alias("cancelled"), F.countDistinct(F.when(F.col("reason") == "refunded", F.col(order_id))).alias("refunded"),
        F.count_if(F.col("reason").isNull() & (part("refunded") > 0)).alias("partial_refund"),
    )
    return sales, unwound, counters


def split_transactions(tx: DataFrame, markers: list[str] = AD_FEES) -> DataFrame:
    """(kind, order_id, sku, amount): fee lines AD and OTHER_FEE, POSTAGE, and marketplace fees of sales and refunds, signed.

    tx: transaction_type, order_id, ref_order_id, fee_type, memo, booking, amount,
    skus (array). A charge is AD if a marker stands in its fee_type or memo; one
    that is booked as CREDIT was given back and is negative, as refunds' fees are.
    A fee over several skus is split evenly, the rest on the last; other types go.
    """
    kind = (
        F.when(F.col("transaction_type") == "NON_SALE_CHARGE", F.when(names_any(F.concat_ws(" ", "fee_type", "memo"), markers), "AD").otherwise("OTHER_FEE"))
        .when(F.col("transaction_type") == "SHIPPING_LABEL", "POSTAGE")
        .when(F.col("transaction_type") == "SALE", "SALE_FEE")
        .when(F.col("transaction_type") == "REFUND", "REFUND_FEE")
    )
    d = tx.withColumns({"kind": kind, "order_id": F.coalesce(F.nullif(F.col("order_id").cast("string"), F.lit("")), F.col("ref_order_id").cast("string"))}).where("kind is not null")
    d = d.select("*", F.posexplode_outer("skus").alias("_i", "sku"))
    back = (F.col("kind") == "REFUND_FEE") | ((F.col("transaction_type") == "NON_SALE_CHARGE") & (F.upper(F.coalesce("booking", F.lit(""))) == "CREDIT"))
    n = F.greatest(F.size("skus"), F.lit(1))
    each = F.bround(F.abs(F.col("amount")).cast(Wide) / n, 2).cast(Money)
    last = F.coalesce(F.col("_i") == n - 1, F.lit(True))
    part = F.when(last, F.abs(F.col("amount")).cast(Money) - each * (n - 1)).otherwise(each)
    return d.select("kind", "order_id", "sku", (F.when(back, -1).otherwise(1) * part).cast(Money).alias("amount"))


def fees_by_order(fees: DataFrame, ad_only: bool = True) -> DataFrame:
    f = fees.where("kind = 'AD'") if ad_only else fees.where("kind in ('AD', 'OTHER_FEE')")
    return f.where("order_id is not null").groupBy("order_id").agg(F.sum("amount").alias("fee"))


def fees_by_sku(fees: DataFrame) -> DataFrame:
    return fees.where("sku is not null").groupBy("sku").agg(F.sum("amount").alias("fee"))


def unattributed(fees: DataFrame) -> DataFrame:
    return fees.where("order_id is null and kind = 'AD'").agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(Money).alias("spend"), F.count("*").alias("charges"))


def unwound_losses(ids: DataFrame, fees: DataFrame, postage: DataFrame) -> DataFrame:
    """Excluded orders that still cost a fee or postage: order_id, fee, postage, loss."""
    j = ids.select("order_id").distinct().join(fees, "order_id", "left").join(postage, "order_id", "left").where("fee is not null or postage is not null")
    zero = F.lit(0).cast(Money)
    return j.select("order_id", "fee", "postage", (F.abs(F.coalesce("fee", zero)) + F.abs(F.coalesce("postage", zero))).cast(Money).alias("loss"))


def fee_lines(fees: DataFrame, lines: DataFrame, ads: DataFrame) -> DataFrame:
    """Fee rows with their line's listing_id and sku, and the listing's bid where it has a single one."""
    bid = ads.groupBy("listing_id").agg(F.countDistinct("bid").alias("n"), F.first("bid").alias("bid_pct")).where("n = 1").drop("n")
    return fees.join(lines.select("line_item_id", "listing_id", "sku"), "line_item_id", "left").join(bid, "listing_id", "left")


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str], optional: tuple[str, ...] = (), frozen: tuple[str, ...] = (), gone: DataFrame | None = None) -> DataFrame:
    """stored with fresh rows put over it by key.

    Optional fields keep the stored value where the fresh one is null, frozen
    ones keep their first value. Keys in gone are out. The result has the columns of stored.
    """
    s, f = stored.alias("s").withColumn("_s", F.lit(1)), fresh.alias("f").withColumn("_f", F.lit(1))
    s, f = (d.select(*key, F.struct(*[c for c in d.columns if c not in key]).alias(n)) for d, n in ((s, "s"), (f, "f")))
    j = s.join(f, key, "full")
    has = F.col("f._f") == 1

    def field(c: str) -> Column:
        old = F.col(f"s.{c}")
        new = F.col(f"f.{c}") if c in fresh.columns else F.lit(None)
        value = F.coalesce(old, new) if c in frozen else F.coalesce(new, old) if c in optional else F.when(has, new).otherwise(old)
        return value.cast(stored.schema[c].dataType).alias(c)

    out = j.select(*[F.col(c) if c in key else field(c) for c in stored.columns])
    return out if gone is None else out.join(gone.select(*key), key, "left_anti")


def append_new(log: DataFrame, entries: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """log and the first entry of each key that it does not have: the same call twice changes nothing."""
    whole = F.struct(*[F.col(c) for c in entries.columns])
    first = entries.groupBy(*key).agg(F.min_by(whole, F.struct(*order)).alias("_first")).select("_first.*")
    return log.unionByName(first.join(log.select(*key).distinct(), key, "left_anti"))
