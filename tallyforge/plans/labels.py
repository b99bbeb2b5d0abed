"""Rules over free texts, on labels as they occur, each with its expected value in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import Money
from ..operators import money as M
from .views import bind, table, with_views

# Condition labels, carriers' texts, titles and charges, with what each means.
CONDITIONS = {
    "New": "new", "New with tags": "new", "Brand New": "new", "Like New": "new", "Factory sealed": "new", "NWT": "new", "Near Mint": "new", "New (other)": "new", "Used": "used", "Pre-Owned": "used", "preowned": "used",
    "Very Good": "used", "Good - Refurbished": "used", "Acceptable": "used", "Seller refurbished": "used", "Open box": "used", "For parts or not working": "used", "Not working": "used",
    "Vintage": "unknown", "Fair": "unknown", "": "unknown", "--": "unknown",
}
CARRIER_TEXTS = {
    "delivered": "DELIVERED", "Delivered.": "DELIVERED", "complete": "DELIVERED", "Completed": "DELIVERED", "Delivery successful": "DELIVERED", "Pickup successful": "PICKED_UP", "picked up": "PICKED_UP", "pickup-complete": "PICKED_UP",
    "in-transit": "IN_TRANSIT", "In Transit to next stop": "IN_TRANSIT", "Out for delivery": "IN_TRANSIT", "Arrived at terminal": "IN_TRANSIT", "Departed hub 7": "IN_TRANSIT", "could not be delivered": None, "will be delivered tomorrow": None,
    "not delivered": None, "inRouteToPickup": None, "pickupFailed": None, "deliveryFailed": None, "Returned to sender": None, "Refused": None, "In transit - exception": None, "label created": None, "needCarrier": None, "cancelled": None, "": None,
}
TITLES = {
    "Brass lid set and box": True, "Two dolls, matching & boxed": True, "Vintage Raggedy Ann & Andy Dolls 1970s Knickerbocker - All Original SET": True, "Salt and Pepper Shakers": True, "Lot of 5 Raggedy Ann & Andy Dolls": False,
    "Pair of brass candlesticks": True, "Single earring": False, "Ring and bracelet set": False, "Ann and Andy dolls": False, "Set of 2 cups": True, "3 pairs of studs": False, "Oak chair": False,
}
CHARGES = {
    ("AD_FEE", ""): "AD", ("", "This is your Promoted Listings ad fee"): "AD", ("OTHER", "Promotion of a store"): "AD", ("", "Advertising, May"): "AD", ("Promoted Listings - General fee", ""): "AD",
    ("", "ADDRESS fee"): "OTHER_FEE", ("UPGRADE_FEE", "upgrade"): "OTHER_FEE", ("", "adjustment"): "OTHER_FEE", ("INTERNATIONAL_FEE", ""): "OTHER_FEE", ("REGULATORY_OPERATING_FEE", "Ad hoc"): "OTHER_FEE", ("", ""): "OTHER_FEE",
}


def _pick(texts: list[str], of: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, texts)), (of % len(texts) + 1).cast("int"))


def f_labels(spark, d):
    """Every part with a condition, a carrier's text and a title, and what the rules read from them."""
    p = table(spark, d, "part").select("p_partkey", _pick(list(CONDITIONS), F.col("p_partkey")).alias("condition"), _pick(list(CARRIER_TEXTS), F.col("p_partkey")).alias("carrier"), _pick(list(TITLES), F.col("p_partkey")).alias("title"))
    return p.select("p_partkey", S.condition_cohort(F.col("condition")).alias("cohort"), S.freight_status(F.col("carrier")).alias("freight"), S.looks_pair_unit(F.col("title")).alias("pair"))


def transactions(spark, d):
    """Order lines as a feed of transactions: every kind of charge, credits, refunds, several skus."""
    n, k = bind(spark, d, "lines"), F.col("order_id") + F.col("pos")
    kinds = ["NON_SALE_CHARGE", "NON_SALE_CHARGE", "SHIPPING_LABEL", "NON_SALE_CHARGE", "SALE", "REFUND", "TRANSFER"]
    sku = F.col("part").cast("string")
    return n.select(
        _pick(kinds, k).alias("transaction_type"), F.when(k % 3 == 0, F.col("order_id").cast("string")).otherwise("").alias("order_id"), F.when(k % 3 == 1, F.col("order_id").cast("string")).alias("ref_order_id"),
        _pick([x for x, _ in CHARGES], F.col("part")).alias("fee_type"), _pick([x for _, x in CHARGES], F.col("part")).alias("memo"), F.when(k % 4 == 0, "CREDIT").otherwise("DEBIT").alias("booking"),
        F.col("item_price").cast(Money).alias("amount"), F.when(k % 5 == 0, F.array(sku, F.concat(sku, F.lit("b")), F.concat(sku, F.lit("c")))).when(k % 5 < 4, F.array(sku)).alias("skus"),
    )


def s3(spark, d):
    t = M.split_transactions(transactions(spark, d))
    return t.groupBy("kind", "order_id", "sku").agg(F.count("*").alias("n"), F.sum("amount").cast(Money).alias("amount"))


QUERIES = {"f_labels": f_labels, "s3_transactions": s3}


def _list(values) -> str:
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return "[" + ", ".join(map(text, values)) + "]"


def _at(values, of: str) -> str:
    return f"{_list(values)}[CAST(({of}) % {len(values)} + 1 AS INTEGER)]"


ORACLE = {
    "f_labels": f"SELECT p_partkey, {_at(list(CONDITIONS.values()), 'p_partkey')} AS cohort, {_at(list(CARRIER_TEXTS.values()), 'p_partkey')} AS freight, {_at(list(TITLES.values()), 'p_partkey')} AS pair FROM part",
    "s3_transactions": with_views(
        f"""WITH t AS (SELECT order_id + pos AS k, *, {_at(['charge', 'charge', 'POSTAGE', 'charge', 'SALE_FEE', 'REFUND_FEE', None], 'order_id + pos')} AS type, {_at(list(CHARGES.values()), 'part')} AS label FROM {{lines}}),
        u AS (SELECT CASE WHEN type = 'charge' THEN label ELSE type END AS kind, CASE WHEN k % 3 < 2 THEN CAST(order_id AS VARCHAR) END AS order_id, CASE WHEN type = 'REFUND_FEE' OR (type = 'charge' AND k % 4 = 0) THEN -1 ELSE 1 END AS sign, item_price AS a,
          unnest(CASE WHEN k % 5 = 0 THEN [CAST(part AS VARCHAR), CAST(part AS VARCHAR) || 'b', CAST(part AS VARCHAR) || 'c'] WHEN k % 5 < 4 THEN [CAST(part AS VARCHAR)] ELSE [NULL] END) AS sku, unnest(CASE WHEN k % 5 = 0 THEN [0, 1, 2] ELSE [9] END) AS i FROM t WHERE type IS NOT NULL),
        x AS (SELECT *, CAST(a * 100 AS BIGINT) AS c FROM u), e AS (SELECT *, c // 3 + CASE WHEN c % 3 = 2 THEN 1 ELSE 0 END AS each FROM x)
        SELECT kind, order_id, sku, count(*) AS n, CAST(sum(sign * CAST(CASE i WHEN 9 THEN c WHEN 2 THEN c - 2 * each ELSE each END AS DECIMAL(18,2)) / 100) AS DECIMAL(18,2)) AS amount FROM e GROUP BY 1, 2, 3"""
    ),
}
