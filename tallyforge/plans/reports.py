"""Report queries over the sales view, the orders and the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import Money, shipment_key
from ..operators import reports as R
from .views import bind, table, with_views

EDGES = [10_000, 20_000, 40_000, 60_000]


def a6(spark, d):
    return R.fee_bands(bind(spark, d, "sales"), EDGES)


def a6_days(spark, d):
    return R.days_to_sell(bind(spark, d, "sales"))


def a7(spark, d):
    return R.dial_in_flags(bind(spark, d, "sales"), "brand", 500)


def a8(spark, d):
    return R.dashboard(bind(spark, d, "sales"))


def a9(spark, d):
    asked = F.col("asked")
    return R.band_check(bind(spark, d, "sales"), "brand", asked.cast(Money), (asked * 2).cast(Money), (asked * 3).cast(Money))


def a28(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return R.group_shipments(o, shipment_key(F.col("o_custkey").cast("string"), F.col("o_orderpriority")), "o_orderkey", "day")


def a29(spark, d):
    q = bind(spark, d, "lines").select(F.col("order_id").alias("shipment"), F.col("pos").alias("quote_id"), F.col("supplier").alias("provider"), F.col("item_price").alias("price"), (F.col("linestatus") == "F").alias("bookable"), (F.col("quantity") * 1000).cast(Money).alias("buyer_paid"))
    return R.quote_board(q).select("shipment", "quote_id", "place", "margin")


def a31(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("long").alias("volume"), F.col("p_type").alias("package"), F.when(F.col("p_partkey") % 29 != 0, F.col("p_partkey") % 40 + 1).alias("ounces"))
    return R.box_estimate(bind(spark, d, "lines").join(p, "part"))


def a32(spark, d):
    r = bind(spark, d, "remote").withColumn("listing_id", F.floor(F.col("listing_id") / 21))
    return R.listing_counts(r, "status")


QUERIES = {"a6_fee_bands": a6, "a6_days_to_sell": a6_days, "a7_dial_in_flags": a7, "a8_dashboard": a8, "a9_band_check": a9, "a28_shipments": a28, "a29_quote_board": a29, "a31_box_estimate": a31, "a32_listing_counts": a32}


def _bp(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN CAST(floor(CAST(CAST({a} * 100 AS BIGINT) * 10000 AS DOUBLE) / CAST({b} * 100 AS BIGINT)) AS BIGINT) END"


ORACLE = {
    k: with_views(v)
    for k, v in {
        "a6_fee_bands": f"WITH b AS (SELECT CASE WHEN gross < 10000 THEN 10000 WHEN gross < 20000 THEN 20000 WHEN gross < 40000 THEN 40000 WHEN gross < 60000 THEN 60000 ELSE 0 END AS band, {_bp('fee', 'gross')} AS bp, {_bp('gross', 'asked')} AS oa FROM {{sales}}) SELECT band, count(*) AS n, quantile_cont(CAST(bp AS DOUBLE), 0.5) AS fee_bp, count(*) FILTER (oa >= 9950) AS full_ask FROM b GROUP BY 1",
        "a6_days_to_sell": "SELECT kind, count(*) AS n, quantile_cont(CAST(sold_at - listed_at AS DOUBLE), 0.5) AS median_days, count(*) FILTER (sold_at - listed_at <= 2) AS fast FROM {sales} GROUP BY 1",
        "a7_dial_in_flags": f"WITH g AS (SELECT brand, count(*) AS n, sum(fee) AS fee, sum(gross) AS gross, sum(asked) AS asked FROM {{sales}} GROUP BY 1), r AS (SELECT brand, n, {_bp('fee', 'gross')} AS f, {_bp('gross', 'asked')} AS oa FROM g) SELECT brand, 'fees' AS flag FROM r WHERE f > 500 UNION ALL SELECT brand, 'raise' FROM r WHERE oa >= 9900 AND n >= 4 UNION ALL SELECT brand, 'soft' FROM r WHERE oa <= 7500 AND n >= 3",
        "a8_dashboard": "WITH s AS (SELECT *, strftime(sold_at, '%Y-%m') AS month FROM {sales}) SELECT month, promoted, count(*) AS n, CAST(sum(gross) AS DECIMAL(18,2)) AS gross, count(postage) AS known, CASE WHEN count(postage) = count(*) THEN CAST(sum(gross - fee - postage) AS DECIMAL(18,2)) END AS net FROM s GROUP BY ROLLUP (month, promoted)",
        "a9_band_check": f"WITH b AS (SELECT brand, gross, asked, {_bp('gross', '(asked * 2)')} AS bp FROM {{sales}}), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY bp) - 1 AS i, count(*) OVER (PARTITION BY brand) AS n FROM b) SELECT brand, count(*) AS n, count(*) FILTER (gross < asked) AS breaches, CAST(coalesce(sum(asked - gross) FILTER (gross < asked), 0) AS DECIMAL(18,2)) AS gap, count(*) FILTER (gross > asked * 3) AS over, max(bp) FILTER (i = n // 2) AS mid_bp FROM r GROUP BY 1",
        "a28_shipments": "SELECT CAST(o_custkey AS VARCHAR) || '|' || lower(trim(o_orderpriority)) AS shipment, CAST(min(o_orderdate) AS DATE) AS first_seen, count(DISTINCT o_orderkey) AS orders FROM orders GROUP BY 1",
        "a29_quote_board": "SELECT order_id AS shipment, pos AS quote_id, row_number() OVER (PARTITION BY order_id ORDER BY item_price, linestatus = 'F' DESC, supplier, pos) AS place, CAST(quantity * 1000 - item_price AS DECIMAL(18,2)) AS margin FROM {lines}",
        "a31_box_estimate": "WITH l AS (SELECT l.order_id, l.quantity, p_size AS v, p_type AS t, CASE WHEN p_partkey % 29 <> 0 THEN p_partkey % 40 + 1 END AS oz FROM {lines} l JOIN part ON p_partkey = l.part), g AS (SELECT order_id, count(oz) = count(*) AS known, CAST(sum(oz * quantity) AS BIGINT) AS oz, arg_max(t, {'v': v, 't': t}) AS t FROM l GROUP BY 1) SELECT order_id, CASE WHEN known THEN t END AS package, CASE WHEN known THEN oz // 16 END AS pounds, CASE WHEN known THEN oz % 16 END AS ounces FROM g",
        "a32_listing_counts": "WITH o AS (SELECT listing_id // 21 AS l, arg_min(status, sku) AS status, arg_min(CASE WHEN price IS NULL THEN -1 ELSE price END, sku) AS price, count(*) AS c FROM {remote} GROUP BY 1) SELECT status, count(*) AS listings, CAST(sum(c) AS BIGINT) AS skus, CAST(sum(CASE WHEN price >= 0 THEN price END) AS DECIMAL(18,2)) AS asks FROM o GROUP BY 1",
    }.items()
}
