"""Order-money queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import Money
from ..operators import money as M
from .views import bind, with_views


def _order_lines(spark, d):
    n = bind(spark, d, "lines")
    total = F.sum("item_price").over(Window.partitionBy("order_id"))
    cancelled = F.col("order_id") % 31 == 0
    refunded = F.when(F.col("order_id") % 7 == 0, total * F.lit("0.30").cast("decimal(4,2)")).when(F.col("order_id") % 11 == 0, total * 2).otherwise(0).cast(Money)
    return n.select("order_id", "part", "pos", "item_price", "buyer_shipping", (total * F.lit("0.13").cast("decimal(4,2)")).cast(Money).alias("fee_total"), refunded.alias("refunded"), F.when(F.col("order_id") % 7 == 0, 1).cast(Money).alias("due"), cancelled.alias("cancelled"))


def w1(spark, d):
    n = bind(spark, d, "lines").withColumn("total", F.when(F.col("order_id") % 5 != 0, (F.col("order_id") % 1000 + 1) / 7).cast(Money))
    out = M.allocate(n, ["order_id"], "total", "item_price", "share", ["pos"])
    return out.select("order_id", "pos", "total", "share")


def w2(spark, d):
    n = bind(spark, d, "lines").withColumn("total", F.lit("10.00").cast(Money))
    return M.split_even(n, ["order_id"], "total", "share", ["pos"]).select("order_id", "pos", "share")


def w3(spark, d):
    return M.running_key(bind(spark, d, "lines"), ["order_id", "line"], ["pos"]).select("order_id", "line", "pos", "n")


def s2(spark, d):
    return M.flatten_orders(_order_lines(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n"), F.sum("original_gross").alias("gross"))


def _fees(spark, d):
    n = bind(spark, d, "lines")
    kind = F.when(F.col("part") % 4 == 0, "AD").otherwise("OTHER_FEE")
    return n.select(F.when(F.col("part") % 9 != 0, F.col("order_id")).alias("order_id"), F.col("part").alias("sku"), kind.alias("kind"), (F.col("item_price") * F.lit("0.02").cast("decimal(4,2)")).cast(Money).alias("amount"))


def a11(spark, d):
    return M.fees_by_order(_fees(spark, d))


def a11_sku(spark, d):
    return M.fees_by_sku(_fees(spark, d))


def a11_none(spark, d):
    return M.unattributed(_fees(spark, d))


def a12(spark, d):
    n = bind(spark, d, "lines")
    ids = n.where("order_id % 7 = 0").select("order_id")
    post = n.where("linestatus = 'F'").groupBy("order_id").agg(F.sum("buyer_shipping").cast(Money).alias("postage"))
    return M.unwound_losses(ids, M.fees_by_order(_fees(spark, d)), post)


QUERIES = {"w1_allocate": w1, "w2_split_even": w2, "w3_running_key": w3, "s2_flatten_orders": s2, "a11_fees_by_order": a11, "a11_fees_by_sku": a11_sku, "a11_unattributed": a11_none, "a12_unwound_losses": a12}

_F = "f AS (SELECT CASE WHEN part % 9 <> 0 THEN order_id END AS order_id, part AS sku, CASE WHEN part % 4 = 0 THEN 'AD' ELSE 'OTHER_FEE' END AS kind, CAST(item_price * CAST(0.02 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS amount FROM {lines})"
_AD = "a AS (SELECT order_id, sum(amount) AS fee FROM f WHERE kind = 'AD' AND order_id IS NOT NULL GROUP BY 1)"

ORACLE = {
    k: with_views(v)
    for k, v in {
        "w3_running_key": "SELECT order_id, line, pos, row_number() OVER (PARTITION BY order_id, line ORDER BY pos) AS n FROM {lines}",
        "w1_allocate": """WITH n AS (SELECT order_id, pos, item_price, CASE WHEN order_id % 5 <> 0 THEN CAST(round(CAST((order_id % 1000 + 1) / 7 AS DOUBLE), 2) AS DECIMAL(18,2)) END AS total FROM {lines}),
          c AS (SELECT *, CAST(total * 100 AS HUGEINT) * CAST(item_price * 100 AS HUGEINT) AS top, CAST(sum(item_price) OVER (PARTITION BY order_id) * 100 AS HUGEINT) AS s, row_number() OVER (PARTITION BY order_id ORDER BY pos DESC) AS r FROM n),
          q AS (SELECT *, top // s AS q, top % s AS m FROM c), e AS (SELECT *, q + CASE WHEN 2 * m > s OR (2 * m = s AND q % 2 = 1) THEN 1 ELSE 0 END AS cents FROM q)
          SELECT order_id, pos, total, CAST(CASE WHEN r = 1 THEN total * 100 - sum(cents) OVER (PARTITION BY order_id) + cents ELSE cents END AS DECIMAL(18,2)) / 100 AS share FROM e""",
        "w2_split_even": "WITH n AS (SELECT order_id, pos, count(*) OVER (PARTITION BY order_id) AS c, row_number() OVER (PARTITION BY order_id ORDER BY pos DESC) AS r FROM {lines}), s AS (SELECT *, CAST(round_even(10.0 / c, 2) AS DECIMAL(18,2)) AS e FROM n) SELECT order_id, pos, CASE WHEN r = 1 THEN CAST(10 - e * (c - 1) AS DECIMAL(18,2)) ELSE e END AS share FROM s",
        "a11_fees_by_order": f"WITH {_F}, {_AD} SELECT * FROM a",
        "a11_fees_by_sku": f"WITH {_F} SELECT sku, sum(amount) AS fee FROM f GROUP BY 1",
        "a11_unattributed": f"WITH {_F} SELECT CAST(coalesce(sum(amount), 0) AS DECIMAL(18,2)) AS spend, count(*) AS charges FROM f WHERE order_id IS NULL AND kind = 'AD'",
        "a12_unwound_losses": f"WITH {_F}, {_AD}, p AS (SELECT order_id, CAST(sum(buyer_shipping) AS DECIMAL(18,2)) AS postage FROM {{lines}} WHERE linestatus = 'F' GROUP BY 1), i AS (SELECT DISTINCT order_id FROM {{lines}} WHERE order_id % 7 = 0) SELECT i.order_id, fee, postage, CAST(abs(coalesce(fee, 0)) + abs(coalesce(postage, 0)) AS DECIMAL(18,2)) AS loss FROM i LEFT JOIN a ON a.order_id = i.order_id LEFT JOIN p ON p.order_id = i.order_id WHERE fee IS NOT NULL OR postage IS NOT NULL",
    }.items()
}
