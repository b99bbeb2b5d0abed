"""What sold and how: one pass over the sales for all sections of a report, its flags, the facts of a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import Money
from .reports import band_of, basis_points

#: Basis points of the ask from which a sale counts as one at full ask.
FULL_ASK = 9950


def _sections(d: DataFrame, names: list[str]) -> DataFrame:
    """d grouped by nothing and by each of names alone, in one aggregation (section and label are told by _section)."""
    return d.groupingSets([[], *[[n] for n in names]], *names)


def _section(names: list[str]) -> tuple[Column, Column]:
    """(section, label) of a row of _sections: 'all' and null, or a name and its value."""
    section, label = F.lit("all"), F.lit(None).cast("string")
    for n in names:
        section = F.when(F.grouping(n) == 0, F.lit(n)).otherwise(section)
        label = F.when(F.grouping(n) == 0, F.col(n).cast("string")).otherwise(label)
    return section, label


def performance(sales: DataFrame, edges: list[int], kind: str = "kind", least: int = 3) -> DataFrame:
    """Rows of a report on sales (gross, fee, net, asked, listed_at, sold_at, matched, kind): section, label and figures.

    section is all, fee_band (by gross), ask_band (by ask; with `least` sales or
    more), kind, or matched (false: sales without a record, the gap in coverage).
    fee_bp: fees of gross; mid_fee_bp, mid_ask_bp: medians of the rates and of
    gross by ask, in basis points rounded down; full_ask: sold at 99.5 % of the
    ask or more; aged: sales not before their listing date; fast: within two
    days, fast_full at full ask; share_bp: of the section's gross. A gross or ask
    that is zero, negative or unknown has no rate and no band; null kinds are
    'other', unknown matches count as matched. Without sales there is no row.
    """
    some = (F.col("gross") > 0) & (F.col("asked") > 0)
    days = F.datediff("sold_at", "listed_at")
    names = ["fee_band", "ask_band", "kind", "matched"]
    d = sales.select(
        band_of(F.when(F.col("gross") > 0, F.col("gross")), edges).alias("fee_band"), band_of(F.when(some, F.col("asked")), edges).alias("ask_band"),
        F.coalesce(F.col(kind), F.lit("other")).alias("kind"), F.coalesce("matched", F.lit(True)).alias("matched"), "gross", "fee", "net",
        basis_points(F.col("fee"), F.when(F.col("gross") > 0, F.col("gross"))).alias("fb"), F.when(some, basis_points(F.col("gross"), F.col("asked"))).alias("ab"), F.when(days >= 0, days).alias("days"),
    )
    section, label = _section(names)
    full, fast = F.col("ab") >= FULL_ASK, F.col("days") <= 2
    money = [F.sum(n).cast(Money).alias(n) for n in ("gross", "fee", "net")]
    middle = [F.percentile(c, F.lit(0.5)).alias(n) for c, n in (("fb", "mid_fee_bp"), ("ab", "mid_ask_bp"), ("days", "mid_days"))]
    counts = [F.count_if(c).alias(n) for c, n in ((F.col("ab").isNotNull(), "with_ask"), (full, "full_ask"), (F.col("days").isNotNull(), "aged"), (fast, "fast"), (fast & full, "fast_full"))]
    g = _sections(d, names).agg(section.alias("section"), label.alias("label"), F.count("*").alias("n"), *money, *counts, *middle).drop(*names)
    g = g.where("section = 'all' or label is not null").where((F.col("section") != "ask_band") | (F.col("n") >= least))
    whole = F.sum("gross").over(Window.partitionBy("section"))
    return g.withColumn("fee_bp", basis_points(F.col("fee"), F.col("gross"))).withColumn("share_bp", basis_points(F.col("gross"), whole))


def performance_flags(report: DataFrame, blended_bp: int = 1400) -> DataFrame:
    """(flag, section, label, with_ask, mid_ask_bp, fast) of a performance report.

    fees: all fees above blended_bp; raise: a kind with four asks or more and a
    median of 99 % of them or more; soft: three or more at 75 % or less;
    never_full: an ask band of five sales or more, none at full ask.
    """
    s, n, mid = F.col("section"), F.col("with_ask"), F.col("mid_ask_bp")
    flag = (
        F.when((s == "all") & (F.col("fee_bp") > blended_bp), "fees")
        .when((s == "kind") & (n >= 4) & (mid >= 9900), "raise")
        .when((s == "kind") & (n >= 3) & (mid <= 7500), "soft")
        .when((s == "ask_band") & (n >= 5) & (F.col("full_ask") == 0), "never_full")
    )
    return report.select(flag.alias("flag"), "section", "label", "with_ask", "mid_ask_bp", "fast").where("flag is not null")


def collection_of(folder: Column) -> Column:
    """The first two parts of a folder's path below 'inventory', 'untracked' where there is none."""
    parts = F.filter(F.split(F.replace(folder, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "inventory"))
    return F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, 2), "/"), F.lit("")), F.lit("untracked"))


def store_facts(sales: DataFrame) -> DataFrame:
    """(section, label, n, gross, net, ad_known, ad_fees, known, tracked, ask_bp, net_after) by month, collection, promoted and for all.

    sales: gross, net, ad_fee, postage, asked, sold_at, folder, promoted. ad_fees
    is what is known of them, null where nothing is. known counts rows of which
    both charges are; net_after takes both off and is null unless all are.
    ask_bp is the mean of gross by ask, rounded down.
    """
    names = ["month", "collection", "promoted"]
    both = F.col("ad_fee").isNotNull() & F.col("postage").isNotNull()
    d = sales.select(F.date_format("sold_at", "yyyy-MM").alias("month"), collection_of(F.col("folder")).alias("collection"), F.coalesce("promoted", F.lit(False)).alias("promoted"), "gross", "net", "ad_fee", "postage", both.alias("both"), F.col("folder").isNotNull().alias("has"), F.when(F.col("asked") > 0, basis_points(F.col("gross"), F.col("asked"))).alias("ab"))
    section, label = _section(names)
    after = F.sum(F.col("net") - F.col("ad_fee") - F.col("postage")).cast(Money)
    g = _sections(d, names).agg(
        section.alias("section"), label.alias("label"), F.count("*").alias("n"), F.sum("gross").cast(Money).alias("gross"), F.sum("net").cast(Money).alias("net"), F.count("ad_fee").alias("ad_known"), F.sum("ad_fee").cast(Money).alias("ad_fees"),
        F.count_if("both").alias("known"), F.count_if("has").alias("tracked"), F.expr("sum(ab) div count(ab)").alias("ask_bp"), F.when(F.min("both"), after).alias("net_after"),
    )
    return g.drop(*names).where("section = 'all' or label is not null")


def sell_through(sales: DataFrame, live: DataFrame, listing: str = "listing_id") -> DataFrame:
    """(sold, live, sold_bp): sales, distinct live listings, and sales of both; one row."""
    ids = live.where(F.col(listing).isNotNull()).select(listing).distinct()
    both = sales.agg(F.count("*").alias("sold"), F.lit(0).cast("long").alias("live")).union(ids.agg(F.lit(0).cast("long"), F.count("*")))
    one = both.agg(F.sum("sold").alias("sold"), F.sum("live").alias("live"))
    return one.select("sold", "live", F.expr("case when sold + live > 0 then sold * 10000 div (sold + live) end").alias("sold_bp"))
