"""Matching and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators.money import append_new, upsert
from .views import bind, table, with_views


def j1(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("first_order"), "o_orderkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return M.lookup_first(c, o, "o_custkey", ["first_order", "o_orderkey"])


def j2(spark, d):
    p, s = bind(spark, d, "local"), bind(spark, d, "remote")
    sales = s.select("sku", "listing_id")
    drafts = p.where("status = 'DRAFTED'").select("sku", "listing_id", F.concat(F.lit("dir"), "sku").alias("ref"), F.col("price").alias("ask"))
    ledger = p.select("sku", "listing_id", F.lit(None).cast("string").alias("ref"), F.col("price").alias("ask"))
    return M.match_ladder(sales, drafts, ledger)


def j5(spark, d):
    return M.reconcile(bind(spark, d, "local"), bind(spark, d, "remote"), "sku", ["status", "price", "listing_id"])


def j6(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), "/$", "").alias("path"))
    buckets = pages.where("page_id % 3 = 0").select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("bucket")).union(pages.select(F.split("path", "/")[0].alias("bucket")))
    return M.nearest_bucket(pages, buckets, "path")


def _j8(spark, d, log):
    listings = table(spark, d, "part").select(F.col("p_partkey").alias("sku"), F.when(F.col("p_size") % 7 != 0, F.date_add(F.lit("1997-01-01").cast("date"), F.col("p_size") * 20)).alias("start"))
    return M.last_change(listings, log.select(F.col("l_partkey").alias("sku"), F.to_date("l_shipdate").alias("date")), "sku", "start")


def j8(spark, d):
    return _j8(spark, d, table(spark, d, "lineitem").where("l_linenumber = 1"))


def j8_all(spark, d):
    """As j8_last_change, over every line."""
    return _j8(spark, d, table(spark, d, "lineitem"))


def j9(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sku"), "p_size")
    holds = p.where("p_size % 2 = 0").select("sku", F.when(F.col("p_size") % 4 == 0, F.date_add(F.lit("2001-11-01").cast("date"), F.col("p_size"))).alias("until"), F.concat(F.lit("hold "), "p_size").alias("reason"))
    return M.active_hold(p, holds, "sku", F.lit("2001-12-01").cast("date"))


def _j10(events):
    e = events.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 20 minutes")).alias("close"))
    return M.overlaps(e, "user_id")


def j10(spark, d):
    return _j10(table(spark, d, "events").where("event_id % 5 = 0"))


def j10_all(spark, d):
    """As j10_overlaps, over every event."""
    return _j10(table(spark, d, "events"))


def s10(spark, d):
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("name"))
    return M.flatten_tree(n.union(r))


def u1(spark, d):
    cols = ["sku", "status", "price"]
    return M.table_diff(bind(spark, d, "local").select(*cols), bind(spark, d, "remote").select(*cols))


def u2(spark, d):
    return M.merge_prefer(bind(spark, d, "local"), bind(spark, d, "remote"), "sku", ["status", "price", "listing_id"])


def w4(spark, d):
    gone = bind(spark, d, "remote").where("sku % 29 = 0")
    return upsert(bind(spark, d, "local"), bind(spark, d, "remote"), ["sku"], optional=("price",), frozen=("listing_id",), gone=gone)


def w5(spark, d):
    a, b = bind(spark, d, "local").select("sku", "price"), bind(spark, d, "remote").where("price is not null").select("sku", "price")
    return append_new(a, b, ["sku"], ["price"])


def k1(spark, d):
    live = bind(spark, d, "local").where("status = 'PUBLISHED'")
    demand = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("sku")).agg(F.count("*").alias("impressions"))
    return M.promotion_plan(live.select("sku", "price"), live.where("sku % 4 = 0"), demand, "sku", 50)


def k9(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus", "o_totalprice")
    return M.select_oldest(o, [(F.col("o_orderstatus") == "F", "finished"), (F.col("o_totalprice") < 1000, "small")], "day", "o_orderkey", 100)[1]


def j8_listing(spark, d):
    """Parts listed in two stores or none, against a log of returned lines that names them by sku, by item or by both."""
    k = F.col("p_partkey")
    listings = table(spark, d, "part").select(k.alias("listing"), F.when(k % 5 != 0, k.cast("string")).alias("sku"), F.when(k % 3 != 0, (k * 7).cast("string")).otherwise("").alias("item_id"), F.when(k % 4 == 0, "a").when(k % 4 == 1, "b").otherwise("").alias("store"), F.when(F.col("p_size") % 7 != 0, F.date_add(F.lit("1997-01-01").cast("date"), F.col("p_size").cast("int") * 20)).alias("start"))
    n, o, p = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_partkey")
    log = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.when(n % 3 != 0, p.cast("string")).alias("sku"), F.when(n % 2 == 0, (p * 7).cast("string")).alias("item_id"), F.when(o % 3 == 0, "a").when(o % 3 == 1, "b").alias("store"), F.to_date("l_shipdate").alias("date"), (o * 10 + n).alias("pos"), F.when(n % 4 == 0, "report").alias("source"))
    return M.listing_changes(listings, log).select("listing", "last", "source")


QUERIES = {"j8_listing_changes": j8_listing, "j1_lookup": j1, "j2_match_ladder": j2, "j5_reconcile": j5, "j6_nearest_bucket": j6, "j8_last_change": j8, "j8_last_change_all": j8_all, "j9_active_hold": j9, "j10_overlaps": j10, "j10_overlaps_all": j10_all, "s10_category_tree": s10, "u1_table_diff": u1, "u2_merge_prefer": u2, "w4_upsert": w4, "w5_append_new": w5, "k1_promotion_plan": k1, "k9_select_oldest": k9}

ORACLE = {
    k: with_views(v)
    for k, v in {
        "j1_lookup": "SELECT c_custkey AS o_custkey, c_name, first_order, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) AS first_order, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS r FROM orders) o ON c_custkey = o.o_custkey AND r = 1",
        "j2_match_ladder": """WITH p AS (SELECT * FROM {local}), f AS (SELECT * FROM p WHERE status = 'DRAFTED') SELECT s.sku, s.listing_id, CASE WHEN a.sku IS NOT NULL THEN 'dir' || a.sku WHEN b.sku IS NOT NULL THEN 'dir' || b.sku END AS ref,
          coalesce(a.price, b.price, c.price, e.price) AS ask, CASE WHEN a.sku IS NOT NULL THEN 'sku' WHEN b.sku IS NOT NULL THEN 'listing_id' WHEN c.sku IS NOT NULL THEN 'ledger-sku' WHEN e.sku IS NOT NULL THEN 'ledger-listing' ELSE 'unmatched' END AS matched_by
          FROM {remote} s LEFT JOIN f a ON a.sku = s.sku LEFT JOIN f b ON b.listing_id = s.listing_id LEFT JOIN p c ON c.sku = s.sku LEFT JOIN p e ON e.listing_id = s.listing_id""",
        "j5_reconcile": """WITH j AS (SELECT coalesce(a.sku, b.sku) AS key, a.sku AS x, b.sku AS y, a.status AS s1, b.status AS s2, a.listing_id AS i1, b.listing_id AS i2, CAST(a.price AS VARCHAR) AS p1, CAST(b.price AS VARCHAR) AS p2, CAST(a.listing_id AS VARCHAR) AS l1, CAST(b.listing_id AS VARCHAR) AS l2 FROM {local} a FULL JOIN {remote} b ON a.sku = b.sku),
          k AS (SELECT *, s1 IN ('SOLD', 'SHIPPED') AND NOT (s2 = 'PUBLISHED' AND i2 IS NOT NULL AND i1 IS DISTINCT FROM i2) AS kept FROM j WHERE x IS NOT NULL AND y IS NOT NULL),
          f AS (SELECT key, kept, 'status' AS field, s1 AS was, s2 AS now FROM k UNION ALL SELECT key, kept, 'price', p1, p2 FROM k UNION ALL SELECT key, kept, 'listing_id', l1, l2 FROM k)
          SELECT CASE WHEN now IS NULL THEN 'blanked' WHEN kept AND field <> 'price' THEN 'protected' ELSE 'drift' END AS kind, key, field, was, now FROM f WHERE was IS DISTINCT FROM now
          UNION ALL SELECT CASE WHEN x IS NULL THEN 'missing' WHEN s1 = 'PUBLISHED' THEN 'unbacked' WHEN i1 IS NULL THEN 'never_listed' ELSE 'orphan' END, key, NULL, NULL, NULL FROM j WHERE x IS NULL OR y IS NULL""",
        "j6_nearest_bucket": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/$', '') AS path FROM pages), b AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS bucket FROM p WHERE page_id % 3 = 0 UNION SELECT split_part(path, '/', 1) FROM p),
          m AS (SELECT page_id, bucket, row_number() OVER (PARTITION BY page_id ORDER BY length(bucket) DESC) AS r FROM p JOIN b ON p.path = b.bucket OR starts_with(p.path, b.bucket || '/')) SELECT p.page_id, path, bucket FROM p LEFT JOIN m ON p.page_id = m.page_id AND r = 1""",
        "j8_listing_changes": """WITH l AS (SELECT p_partkey AS listing, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END AS sku, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 7 END AS item, CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS store, CASE WHEN p_size % 7 <> 0 THEN DATE '1997-01-01' + CAST(p_size * 20 AS INTEGER) END AS start FROM part),
          g AS (SELECT CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END AS sku, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey * 7 END AS item, CASE l_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS store, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 4 = 0 THEN 'report' ELSE 'log' END AS source FROM lineitem WHERE l_returnflag = 'R'),
          m AS (SELECT listing, start, date, pos, source FROM l JOIN g ON l.sku = g.sku AND (l.store = g.store OR l.store IS NULL OR g.store IS NULL) UNION ALL SELECT listing, start, date, pos, source FROM l JOIN g ON l.item = g.item AND (l.store = g.store OR l.store IS NULL OR g.store IS NULL)),
          b AS (SELECT listing, max(date) AS date, arg_max(source, (date, pos, source)) AS source FROM m GROUP BY 1)
          SELECT l.listing, CASE WHEN b.date IS NULL OR start > b.date THEN start ELSE b.date END AS last, CASE WHEN start IS NOT NULL AND (b.date IS NULL OR start > b.date) THEN 'listed' ELSE b.source END AS source FROM l LEFT JOIN b USING (listing)""",
        "j8_last_change": """WITH l AS (SELECT p_partkey AS sku, CASE WHEN p_size % 7 <> 0 THEN DATE '1997-01-01' + p_size * 20 END AS start FROM part), g AS (SELECT l_partkey AS sku, max(CAST(l_shipdate AS DATE)) AS logged FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
          SELECT l.sku, start, greatest(logged, start) AS last, CASE WHEN logged IS NULL AND start IS NULL THEN NULL WHEN start IS NULL OR logged >= start THEN 'log' ELSE 'start' END AS source FROM l LEFT JOIN g ON l.sku = g.sku""",
        "j8_last_change_all": """WITH l AS (SELECT p_partkey AS sku, CASE WHEN p_size % 7 <> 0 THEN DATE '1997-01-01' + p_size * 20 END AS start FROM part), g AS (SELECT l_partkey AS sku, max(CAST(l_shipdate AS DATE)) AS logged FROM lineitem GROUP BY 1)
          SELECT l.sku, start, greatest(logged, start) AS last, CASE WHEN logged IS NULL AND start IS NULL THEN NULL WHEN start IS NULL OR logged >= start THEN 'log' ELSE 'start' END AS source FROM l LEFT JOIN g ON l.sku = g.sku""",
        "j9_active_hold": "SELECT p_partkey AS sku, p_size, CASE WHEN p_size % 2 = 0 AND (p_size % 4 <> 0 OR DATE '2001-11-01' + p_size >= DATE '2001-12-01') THEN 'hold ' || p_size END AS reason FROM part",
        "j10_overlaps": "WITH e AS (SELECT event_id AS id, user_id, ts AS s, ts + INTERVAL 20 MINUTE AS c FROM events WHERE event_id % 5 = 0) SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id < b.id AND a.user_id <> b.user_id AND a.s < b.c AND b.s < a.c",
        "j10_overlaps_all": "WITH e AS (SELECT event_id AS id, user_id, ts AS s, ts + INTERVAL 20 MINUTE AS c FROM events) SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id < b.id AND a.user_id <> b.user_id AND a.s < b.c AND b.s < a.c",
        "s10_category_tree": "SELECT r_regionkey AS id, r_name AS path FROM region UNION ALL SELECT n_nationkey + 100, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey",
        "u1_table_diff": "SELECT *, 'add' AS event FROM (SELECT sku, status, price FROM {remote} EXCEPT ALL SELECT sku, status, price FROM {local}) UNION ALL SELECT *, 'remove' FROM (SELECT sku, status, price FROM {local} EXCEPT ALL SELECT sku, status, price FROM {remote})",
        "u2_merge_prefer": "SELECT coalesce(a.sku, b.sku) AS sku, coalesce(a.status, b.status) AS status, coalesce(a.price, b.price) AS price, coalesce(a.listing_id, b.listing_id) AS listing_id, CASE WHEN a.sku IS NULL THEN 'second' WHEN b.sku IS NULL THEN 'first' ELSE 'both' END AS src FROM {local} a FULL JOIN {remote} b ON a.sku = b.sku",
        "w4_upsert": "SELECT coalesce(a.sku, b.sku) AS sku, CASE WHEN b.sku IS NOT NULL THEN b.status ELSE a.status END AS status, CASE WHEN b.sku IS NOT NULL THEN b.title ELSE a.title END AS title, coalesce(b.price, a.price) AS price, coalesce(a.listing_id, b.listing_id) AS listing_id FROM {local} a FULL JOIN {remote} b ON a.sku = b.sku WHERE coalesce(a.sku, b.sku) NOT IN (SELECT sku FROM {remote} WHERE sku % 29 = 0)",
        "w5_append_new": "SELECT sku, price FROM {local} UNION ALL SELECT sku, price FROM {remote} WHERE price IS NOT NULL AND sku NOT IN (SELECT sku FROM {local})",
        "k1_promotion_plan": "WITH l AS (SELECT sku, price FROM {local} WHERE status = 'PUBLISHED' AND sku % 4 <> 0), d AS (SELECT l_partkey AS sku, count(*) AS impressions FROM lineitem GROUP BY 1) SELECT sku, price, impressions, price * impressions AS score FROM l JOIN d USING (sku) ORDER BY price * impressions DESC, sku LIMIT 50",
        "k9_select_oldest": "SELECT CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'small' END AS reason, count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 1000 GROUP BY 1",
    }.items()
}
