"""Queries of sales reports, of the evidence of prices, of sold rows and of accepted offers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comps as C
from ..operators import performance as P
from ..operators.price_evidence import price_evidence_issues
from ..sources.runs import normalize_sold
from .reports import EDGES, _bp
from .views import bind, table, with_views

# Both engines read these.
SOLD = """SELECT *, CAST(gross - fee AS DECIMAL(18,2)) AS net, part % 31 <> 0 AS matched, CASE WHEN part % 50 <> 0 THEN CASE WHEN promoted THEN CAST(1.25 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END END AS ad_fee,
  CASE WHEN part % 31 <> 0 THEN 'inventory/' || brand || '/' || CASE WHEN part % 2 = 0 THEN 'even/x' ELSE 'odd' END END AS folder FROM {sales}"""
DRAFTS = """SELECT p_partkey AS sku, CASE WHEN p_partkey % 11 = 0 THEN CAST(p_partkey AS VARCHAR(20)) END AS listing_id, CASE WHEN p_partkey % 9 = 0 THEN 'auction' WHEN p_partkey % 9 < 5 THEN 'FIXED_PRICE' END AS format,
  p_partkey % 4 <> 0 AS best_offer, CAST(p_retailprice AS DECIMAL(18,2)) AS price, p_partkey % 5 = 0 AS saved,
  CASE WHEN p_partkey % 13 <> 0 THEN 'Notes on ' || p_name || chr(10) || CASE WHEN p_partkey % 17 = 0 THEN '  OPERATOR PRICE: $5' || chr(10) ELSE '' END
    || CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN ' B · Browser : NOT run' || chr(10) WHEN 2 THEN 'B · Browser: THIN, two asks' || chr(10) ELSE 'B · Browser : RAN for ' || p_brand || chr(10) || '    n_kept = ' || CASE WHEN p_size % 6 = 3 THEN '0 of 9' ELSE '10' END || chr(10) END
    || ' C · Chrome : n_kept = 0' || chr(10)
    || CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'ONE-OFF: historian  · judgment $40 · push-high $60' WHEN 2 THEN 'ONE-OFF: Historian ' || p_brand || ' · judgment $40' ELSE ' ONE-OFF: historian ' || p_brand || ', 1950s · judgment $900 · Push-high $1,200.50' END END AS note
  FROM {part}"""
PROOFS = """SELECT l_partkey AS sku, CASE WHEN l_linenumber < 3 THEN ' b' WHEN l_linenumber = 3 THEN 'C' ELSE 'A' END AS stage, CASE WHEN l_suppkey % 3 <> 0 THEN 'https://x.example/' || CAST(l_orderkey AS VARCHAR(20)) ELSE ' ' END AS url,
  CASE WHEN l_suppkey % 2 = 0 THEN 'Active' ELSE 'Auction' END AS listing_type, CASE WHEN l_returnflag = 'R' THEN 'an asking price' END AS note FROM {lineitem} WHERE l_shipdate < TIMESTAMP '1995-06-01 00:00:00'"""


def _sold(spark, d):
    return spark.sql(SOLD, sales=bind(spark, d, "sales"))


def a6(spark, d):
    return P.performance(_sold(spark, d), EDGES)


def a7(spark, d):
    return P.performance_flags(P.performance(_sold(spark, d), EDGES), 400)


def a8(spark, d):
    return P.store_facts(_sold(spark, d))


def a8_through(spark, d):
    return P.sell_through(_sold(spark, d), bind(spark, d, "remote").where("status = 'PUBLISHED'"))


def p6(spark, d):
    drafts = spark.sql(DRAFTS, part=table(spark, d, "part"))
    return price_evidence_issues(drafts, spark.sql(PROOFS, lineitem=table(spark, d, "lineitem"))).select("sku", F.array_join("issues", ",").alias("issues"))


def j4(spark, d):
    c = bind(spark, d, "comps")
    a = c.where("total_price is not null").groupBy("query", "item_id").agg(F.min("price").alias("price"), F.max("bo_accepted").alias("bo_accepted"))
    b = c.where("total_price is not null").groupBy("query", "item_id").agg(F.max(F.when(F.col("bids_count") % 2 == 0, F.col("price")).otherwise(F.col("total_price"))).alias("price"), F.min(F.col("bids_count") > 3).alias("bo_accepted"))
    return C.compare_offers(a, b, ["query"])


def s11(spark, d):
    c = bind(spark, d, "comps")
    ship = F.round(F.col("total_price") - F.col("price"), 2)
    raw = F.to_json(F.struct(F.when(F.col("bids_count") != 5, F.col("price")).alias("price"), F.col("title"), F.col("item_id"), ship.alias("shipping_cost"), F.col("bo_accepted").alias("best_offer"), F.when(F.col("bids_count") % 2 == 0, "auction").otherwise("fixed_price").alias("format"), F.concat(F.col("sold_date").cast("string"), F.lit("T08:00:00Z")).alias("last_sold"), F.col("condition")))
    n = normalize_sold(c.select(raw.alias("json")))
    return n.groupBy("listing_type", "condition", "bo_accepted", F.date_format("sold_date", "yyyy").alias("year")).agg(F.count("*").alias("n"), F.sum("sold_price").alias("sold"), F.count("total_price").alias("delivered"), F.sum("total_price").alias("total"), F.count("shipping_type").alias("free"), F.countDistinct("item_id").alias("ids"))


QUERIES = {"a6_performance": a6, "a7_performance_flags": a7, "a8_store_facts": a8, "a8_sell_through": a8_through, "p6_price_evidence": p6, "j4_best_offers": j4, "s11_sold_rows": s11}

_BAND = "CASE WHEN {0} < 10000 THEN '10000' WHEN {0} < 20000 THEN '20000' WHEN {0} < 40000 THEN '40000' WHEN {0} < 60000 THEN '60000' ELSE '0' END"
_ROWS = f"""s AS ({SOLD}), d AS (SELECT *, CASE WHEN gross > 0 THEN {_bp('fee', 'gross')} END AS fb, CASE WHEN gross > 0 AND asked > 0 THEN {_bp('gross', 'asked')} END AS ab, CASE WHEN sold_at >= listed_at THEN sold_at - listed_at END AS days FROM s),
  x AS (SELECT 'all' AS section, NULL AS label, * FROM d UNION ALL SELECT 'fee_band', {_BAND.format('gross')}, * FROM d WHERE gross > 0 UNION ALL SELECT 'ask_band', {_BAND.format('asked')}, * FROM d WHERE ab IS NOT NULL UNION ALL SELECT 'kind', kind, * FROM d UNION ALL SELECT 'matched', CAST(matched AS VARCHAR), * FROM d),
  g AS (SELECT section, label, count(*) AS n, CAST(sum(gross) AS DECIMAL(18,2)) AS gross, CAST(sum(fee) AS DECIMAL(18,2)) AS fee, CAST(sum(net) AS DECIMAL(18,2)) AS net, count(ab) AS with_ask, count(*) FILTER (ab >= 9950) AS full_ask, count(days) AS aged, count(*) FILTER (days <= 2) AS fast, count(*) FILTER (days <= 2 AND ab >= 9950) AS fast_full,
    quantile_cont(CAST(fb AS DOUBLE), 0.5) AS mid_fee_bp, quantile_cont(CAST(ab AS DOUBLE), 0.5) AS mid_ask_bp, quantile_cont(CAST(days AS DOUBLE), 0.5) AS mid_days FROM x GROUP BY 1, 2),
  h AS (SELECT *, sum(gross) OVER (PARTITION BY section) AS whole FROM g),
  p AS (SELECT * EXCLUDE (whole), {_bp('fee', 'gross')} AS fee_bp, {_bp('gross', 'whole')} AS share_bp FROM h WHERE section <> 'ask_band' OR n >= 3)"""

ORACLE = {
    k: with_views(v)
    for k, v in {
        "a6_performance": f"WITH {_ROWS} SELECT * FROM p",
        "a7_performance_flags": f"""WITH {_ROWS} SELECT * FROM (SELECT CASE WHEN section = 'all' AND fee_bp > 400 THEN 'fees' WHEN section = 'kind' AND with_ask >= 4 AND mid_ask_bp >= 9900 THEN 'raise' WHEN section = 'kind' AND with_ask >= 3 AND mid_ask_bp <= 7500 THEN 'soft'
          WHEN section = 'ask_band' AND with_ask >= 5 AND full_ask = 0 THEN 'never_full' END AS flag, section, label, with_ask, mid_ask_bp, fast FROM p) WHERE flag IS NOT NULL""",
        "a8_store_facts": f"""WITH s AS ({SOLD}), d AS (SELECT *, {_bp('gross', 'asked')} AS ab, CASE WHEN folder IS NULL THEN 'untracked' ELSE split_part(folder, '/', 2) || '/' || split_part(folder, '/', 3) END AS collection FROM s),
          x AS (SELECT 'all' AS section, NULL AS label, * FROM d UNION ALL SELECT 'month', strftime(sold_at, '%Y-%m'), * FROM d UNION ALL SELECT 'collection', collection, * FROM d UNION ALL SELECT 'promoted', CAST(promoted AS VARCHAR), * FROM d)
          SELECT section, label, count(*) AS n, CAST(sum(gross) AS DECIMAL(18,2)) AS gross, CAST(sum(net) AS DECIMAL(18,2)) AS net, count(ad_fee) AS ad_known, CAST(sum(ad_fee) AS DECIMAL(18,2)) AS ad_fees, count(ad_fee + postage) AS known, count(folder) AS tracked, CAST(sum(ab) // count(ab) AS BIGINT) AS ask_bp,
            CASE WHEN count(ad_fee + postage) = count(*) THEN CAST(sum(net - ad_fee - postage) AS DECIMAL(18,2)) END AS net_after FROM x GROUP BY 1, 2""",
        "a8_sell_through": "WITH l AS (SELECT count(DISTINCT listing_id) AS live FROM {remote} WHERE status = 'PUBLISHED'), s AS (SELECT count(*) AS sold FROM {sales}) SELECT sold, live, sold * 10000 // (sold + live) AS sold_bp FROM s, l",
        "p6_price_evidence": """WITH ok AS (SELECT DISTINCT l_partkey AS sku FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01 00:00:00' AND l_linenumber <= 3 AND l_suppkey % 3 <> 0 AND l_suppkey % 2 <> 0 AND l_returnflag <> 'R'),
          d AS (SELECT p_partkey AS k, p_size % 6 AS z, p_partkey % 7 AS o, p_partkey % 5 = 0 OR ok.sku IS NOT NULL AS seen, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part LEFT JOIN ok ON ok.sku = p_partkey)
          SELECT k AS sku, CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN 'no_note' WHEN k % 17 = 0 THEN '' WHEN z = 0 THEN 'no_pull_line' WHEN z = 1 THEN 'not_pulled' WHEN z > 2 AND NOT seen THEN 'no_sold_rows' WHEN z > 3 THEN ''
            WHEN o = 0 THEN 'no_one_off' WHEN o = 1 THEN 'no_historian' WHEN k % 9 = 0 THEN '' ELSE concat_ws(',', CASE WHEN k % 4 = 0 THEN 'no_best_offer' END, CASE WHEN o = 2 THEN 'no_push_high' WHEN price < 1200.50 THEN 'below_push_high' END) END AS issues FROM d""",
        "j4_best_offers": """WITH c AS (SELECT query, item_id, min(price) AS pa, bool_or(bo_accepted) AS oa, max(CASE WHEN bids_count % 2 = 0 THEN price ELSE total_price END) AS pb, bool_and(bids_count > 3) AS ob FROM {comps} WHERE total_price IS NOT NULL GROUP BY 1, 2)
          SELECT query, count(*) AS matched, count(*) FILTER (NOT oa AND abs(pa - pb) < 0.01) AS same_price, count(*) FILTER (NOT oa AND abs(pa - pb) >= 0.01) AS differ, count(*) FILTER (oa) AS offers, count(*) FILTER (oa AND ob) AS offers_agreed, count(*) FILTER (oa AND pb < pa - 0.005) AS offers_below FROM c GROUP BY 1""",
        "s11_sold_rows": """WITH c AS (SELECT *, CAST(price AS DECIMAL(18,2)) AS sp, CAST(total_price AS DECIMAL(18,2)) AS tp FROM {comps} WHERE bids_count <> 5)
          SELECT CASE WHEN bo_accepted THEN 'Best Offer' WHEN bids_count % 2 = 0 THEN 'Auction' ELSE 'Buy It Now' END AS listing_type, condition, bo_accepted, strftime(sold_date, '%Y') AS year, count(*) AS n, sum(sp) AS sold, count(tp) AS delivered, sum(tp) AS total, count(*) FILTER (tp = sp) AS free, count(DISTINCT item_id) AS ids FROM c GROUP BY 1, 2, 3, 4""",
    }.items()
}
