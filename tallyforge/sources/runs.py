"""Runs of comparable sales, advertising reports, vendors' rows, prose with prices, threads and inventory sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

COMP = "title string, sold_price double, total_price double, url string, condition string, sold_date string, listing_type string, bids_count long, seller_feedback_score long, bo_accepted boolean, comp_source string, item_id string"
RUN = f"run_id string, queries array<string>, charm_price_share double, currency_leak_suspected boolean, exact_match struct<condition_cohort:string>, comps array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in COMP.split(', '))}>>"


def comps_of(runs: DataFrame, source: str, price_field: str = "sold") -> DataFrame:
    """One row for each comp of runs (RUN) with a sold price: run_id, the comp's fields, price, fell_back, is_row0, cohort, source.

    price is the sold one, or for price_field 'total' the delivered one where it
    is known (fell_back marks the others). The first comp of a price_high run is
    is_row0. A run that is reduced to a cohort gives it to comps of unknown condition.
    """
    d = runs.select("run_id", F.col("exact_match.condition_cohort").alias("reduced"), F.posexplode("comps").alias("pos", "c"))
    return comp_rows(d.select("run_id", "reduced", (F.col("pos") == 0).alias("leads"), "c"), source, price_field)


def comp_rows(comps: DataFrame, source: str, price_field: str = "sold") -> DataFrame:
    """As comps_of, from one row for each comp: run_id, reduced (the run's cohort), leads (it is the run's first comp), c (the comp). No run is held whole."""
    d = comps.where("c.sold_price is not null")
    total, sold = F.col("c.total_price"), F.col("c.sold_price")
    own = S.condition_cohort(F.col("c.condition"))
    cohort = F.when((own == "unknown") & F.col("reduced").isin("new", "used"), F.col("reduced")).otherwise(own)
    price = F.coalesce(total, sold) if price_field == "total" else sold
    return d.select("run_id", "c.*", price.alias("price"), (total.isNull() if price_field == "total" else F.lit(False)).alias("fell_back"), (F.col("leads") & F.lit(source == "price_high")).alias("is_row0"), cohort.alias("cohort"), F.lit(source).alias("source"))


def read_comp_runs(spark: SparkSession, path: str, source: str, price_field: str = "sold") -> DataFrame:
    """comps_of the JSON documents under path, one run each."""
    return comps_of(spark.read.schema(RUN).json(path, multiLine=True), source, price_field)


#: Column labels of advertising reports and the fields they stand for.
AD_LABELS = {
    "campaign id": "campaign_id", "campaign name": "campaign_name", "item id": "listing_id", "listing id": "listing_id", "title": "title", "listing title": "title", "price": "price", "listing price": "price",
    "impressions": "impressions", "total impressions": "impressions", "clicks": "clicks", "total clicks": "clicks", "sold": "sold", "sold quantity": "sold", "quantity sold": "sold", "sales": "sales", "total sales": "sales", "sale amount": "sales", "ad fees": "ad_fees", "total ad fees": "ad_fees",
}
NUMBERS = ["price", "impressions", "clicks", "sold", "sales", "ad_fees"]


def read_ad_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows of advertising reports: the fields of AD_LABELS, figures as numbers (0 where there is none).

    Lines before the header are passed over: the first line with two known labels
    is the header. Tabs or commas part the columns, whichever the header has more
    of; of columns for one field the first counts. Each file is read on its own.
    """
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("l"))
    cells = lambda x: F.when(F.regexp_count(x, F.lit("\t")) >= F.regexp_count(x, F.lit(",")), F.split(x, "\t")).otherwise(F.split(x, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    clean = lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', ""))
    known = F.create_map(*[F.lit(x) for pair in AD_LABELS.items() for x in pair])
    fields = lambda x: F.transform(cells(x), lambda y: F.try_element_at(known, F.lower(clean(y))))
    at = F.get(F.filter(F.transform("l", lambda x, i: F.when(F.size(F.array_compact(fields(x))) >= 2, i)), lambda i: i.isNotNull()), F.lit(0))
    d = lines.withColumn("at", at).where("at is not null").withColumn("names", fields(F.get("l", F.col("at"))))
    rows = d.select("names", F.explode(F.slice("l", F.col("at") + 2, F.size("l"))).alias("x")).where(F.trim("x") != "").select("names", F.transform(cells(F.col("x")), clean).alias("v"))
    place = lambda n: F.array_position("names", n)
    text = lambda n: F.when(place(n) > 0, F.get("v", (place(n) - 1).cast("int")))
    number = lambda n: F.coalesce(F.regexp_replace(F.regexp_extract(text(n), r"(-?\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double"), F.lit(0.0))
    return rows.select(*[(number(n) if n in NUMBERS else text(n)).alias(n) for n in dict.fromkeys(AD_LABELS.values())])


def normalize_active(raw: DataFrame) -> DataFrame:
    """(item_id, title, price, shipping, delivered, seller) of raw (json): delivered is known where shipping is."""
    j = F.from_json("json", "itemId string, title string, price struct<value:string>, shippingOptions array<struct<shippingCost:struct<value:string>>>, seller struct<username:string>")
    d = raw.select(j.alias("j")).select(F.regexp_extract("j.itemId", r"(\d{9,})", 1).alias("item_id"), "j.title", F.col("j.price.value").try_cast("decimal(18,2)").alias("price"), F.get("j.shippingOptions.shippingCost.value", F.lit(0)).try_cast("decimal(18,2)").alias("shipping"), F.col("j.seller.username").alias("seller"))
    return d.select("item_id", "title", "price", "shipping", (F.col("price") + F.col("shipping")).alias("delivered"), "seller")


#: Formats of sold rows and what listings call them.
SOLD_FORMATS = {"AUCTION": "Auction", "FIXED_PRICE": "Buy It Now"}


def normalize_sold(raw: DataFrame) -> DataFrame:
    """Comps of sold rows (json): title, sold_price, url, item_id, sold_date, condition, shipping_cost, shipping_type, total_price, listing_type, bo_accepted.

    Rows without a title or a price that is a number go. An accepted offer is one
    marked true, not one that could not be looked up; it names the listing type.
    total_price is known where the postage is, shipping_type is 'free' at 0.
    """
    text = "price string, title string, url string, item_id string, shipping_cost string, best_offer string, format string, last_sold string, condition string"
    # As rows of an array each text is read once; conditions on its fields would read it again.
    d = raw.select(F.inline(F.array(F.from_json("json", text)))).withColumn("price", F.col("price").try_cast(S.Money)).where("price is not null and title <> ''")
    ship, offer = F.col("shipping_cost").try_cast(S.Money), F.coalesce(F.col("best_offer") == "true", F.lit(False))
    kinds = F.create_map(*[F.lit(x) for pair in SOLD_FORMATS.items() for x in pair])
    return d.select(
        "title", F.col("price").alias("sold_price"), F.coalesce("url", F.lit("")).alias("url"), "item_id", F.substring("last_sold", 1, 10).try_cast("date").alias("sold_date"), "condition", ship.alias("shipping_cost"), F.when(ship == 0, "free").alias("shipping_type"),
        (F.col("price") + ship).cast(S.Money).alias("total_price"), F.when(offer, "Best Offer").otherwise(F.try_element_at(kinds, F.upper("format"))).alias("listing_type"), offer.alias("bo_accepted"),
    )


def extract_tiers(text: Column) -> Column:
    """struct(floor, recommended, ceiling) of the lines 'Conservative', 'Recommended', 'Push high' of a price note, before its end mark."""
    now = F.substring_index(text, "\n=== END", 1)

    def tier(name: str) -> Column:
        return F.regexp_replace(F.regexp_extract(now, rf"(?im)^[\s*#-]*{name}[\s:*=-]*(?:\([^)\n]*\))?[\s:*=-]*\$\s*([\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("decimal(18,2)")

    return F.struct(tier("conservative").alias("floor"), tier("recommended").alias("recommended"), tier(r"push[\s-]*high").alias("ceiling"))


def scan_headers(docs: DataFrame, names: list[str], text: str = "value") -> DataFrame:
    """docs with the scalars of their front matter between '---' lines; where one lacks, that of 'meta.<name>' or of the indented line under 'meta:'."""
    head = F.regexp_extract(F.col(text), r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    own = lambda n: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{n}:[ \t]*[\"']?([^\n\"']*)", 1)), F.lit(""))
    under = lambda n: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^[ \t]+{n}:[ \t]*[\"']?([^\n\"']*)", 1)), F.lit(""))
    return docs.select("*", *[F.coalesce(own(n), own(rf"meta\.{n}"), under(n)).alias(n) for n in names])


def parse_threads(pages: DataFrame, html: str = "html") -> DataFrame:
    """(thread, i, author, text): posts of saved thread pages in order; a post is an article element, its author the data-author attribute."""
    from .pages import html_to_text

    posts = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<article\b.*?</article>)"), F.lit(1))
    d = pages.select("thread", F.posexplode(posts).alias("i", "p"))
    return d.select("thread", "i", F.nullif(F.regexp_extract("p", r"""(?i)data-author=["']([^"']*)""", 1), F.lit("")).alias("author"), html_to_text(F.col("p")).alias("text"))


def inventory_sheet(items: DataFrame, offers: DataFrame, tree: DataFrame) -> DataFrame:
    """One row for each item: sku, title, quantity, listing_id, price, category (its path in tree), live, variations (skus of its listing).

    The offer of an item is the one of the least offer_id.
    """
    first = offers.groupBy("sku").agg(F.min_by(F.struct("listing_id", "price", "status", "listing_status", "category"), "offer_id").alias("o"))
    d = items.join(first, "sku", "left").join(tree.select(F.col("id").alias("cat"), F.col("path").alias("path")), F.col("o.category") == F.col("cat"), "left")
    many = d.where("o.listing_id is not null").groupBy(F.col("o.listing_id").alias("lid")).agg(F.count("*").alias("variations"))
    live = (F.col("o.status") == "PUBLISHED") & F.coalesce(F.col("o.listing_status"), F.lit("ACTIVE")).isin("ACTIVE", "") & (F.col("quantity") > 0)
    d = d.join(many, F.col("o.listing_id") == F.col("lid"), "left")
    return d.select("sku", "title", "quantity", F.col("o.listing_id").alias("listing_id"), F.col("o.price").alias("price"), F.col("path").alias("category"), F.coalesce(live, F.lit(False)).alias("live"), F.coalesce("variations", F.lit(0)).alias("variations"))


def consensus(posts: DataFrame, thread: str = "thread", order: str = "i") -> DataFrame:
    """(thread, maker, weight, n, supporters): what posts (maker, agrees, weight, author) of a thread agree on.

    A post that names a maker speaks for it; one that agrees speaks for the maker
    named last before it.
    """
    w = Window.partitionBy(thread).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = posts.withColumn("m", F.when(F.col("maker").isNotNull(), F.col("maker")).when(F.col("agrees"), F.last("maker", True).over(w))).where("m is not null")
    return d.groupBy(thread, F.col("m").alias("maker")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.countDistinct("author").alias("supporters"))


def append_comps(comps: DataFrame, path: str, run: str, stage: str) -> None:
    """Adds comps to the review table at path, with the run and stage they come from."""
    comps.select(F.lit(run).alias("run"), F.lit(stage).alias("stage"), *comps.columns).write.mode("append").parquet(path)
