"""Selection, validation and replay queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import Money
from ..operators import selection as K
from ..sources.pages import html_to_text
from .views import bind, table, with_views

TODAY = "2001-12-01"


def k2(spark, d):
    o = table(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast(Money))
    return K.split_by_age(o, F.to_date("o_orderdate"), F.col("price"), TODAY, 1500, 50_000).groupBy("age").agg(F.count("*").alias("n"), F.sum("price").cast(Money).alias("ask"))


def k3(spark, d):
    s = bind(spark, d, "comps").select("seller", "item_id")
    return K.top_sellers(s, 5).groupBy("seller").agg(F.max("listed").alias("listed"), F.countDistinct("item_id").alias("items"))


def k4(spark, d):
    s = bind(spark, d, "calls").select(F.col("session").alias("listing"), F.col("event_id").alias("image"), F.col("value").alias("score"))
    return K.best_per_listing(s, 20).select("listing", "image")


def k5(spark, d):
    o = bind(spark, d, "local").withColumn("days", F.pmod("sku", F.lit(90)))
    return K.queue_order(o, ["PUBLISHED", "DRAFTED"], "title", "days", "sku").select("sku", "status", "days")


def k6(spark, d):
    rec = (F.floor(F.col("sku") % 70) + 900).cast(Money)
    return K.price_audit(bind(spark, d, "local"), rec, F.col("sku") % 60, 30).select("sku", F.col("over_bp").cast("long").alias("over_bp"), F.col("drop_to").cast("long").alias("drop_to"))


def k7(spark, d):
    n = bind(spark, d, "local")
    floor = F.when(F.col("sku") % 7 != 0, F.col("sku") % 150 + 850)
    v = K.floor_verdict(F.col("sku") % 5 != 0, floor, F.col("price"), F.lit(870), F.lit(900))
    return n.select("sku", v.alias("verdict"))


def k8(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    return K.best_answer(c, "conv_id", "turn", F.length("text") >= 80, F.length("text"))


def k10(spark, d):
    e = bind(spark, d, "calls").select("session", "kind", "ts", "event_id")
    return K.latest_per_key(e, "session", ["ts", "event_id"]).select("session", "kind", "event_id")


def u5(spark, d):
    n = bind(spark, d, "remote").select("sku", "title", "listing_id")
    return K.first_per_key(n, F.coalesce(F.nullif("title", F.lit("")), F.col("listing_id").cast("string")), ["sku"])


def w11(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("lot"), F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("state"), (F.col("o_orderstatus") != "P").alias("active"), F.col("o_totalprice").cast(Money).alias("floor"))
    return K.lot_plan(rows).select("number", "lead", "lead_state", "unit_floor")


def w13(spark, d):
    e = bind(spark, d, "calls")
    old = e.where("value < 20").groupBy("session", "kind").agg(F.min("event_id").alias("at"))
    old = old.select("session", "kind", F.expr("row_number() over (partition by session order by at, kind)").alias("number"))
    return K.number_lineup(old, e, "session", "kind", "event_id")


def w15(spark, d):
    e = bind(spark, d, "lines").select(F.col("part").alias("sku"), F.struct("sold_at", "order_id", "pos").alias("pos"), F.col("sold_at").alias("ts"), F.element_at(F.array(*map(F.lit, ["DRAFTED", "SYNCED", "PUBLISHED", "ENDED", "SYNCED"])), (F.col("line") % 5 + 1).cast("int")).alias("status"))
    return K.advance_status(e)


def p5(spark, d):
    p = table(spark, d, "part")
    rules = [(F.col("p_size") > 40, "too large"), (F.lower("p_type").contains("e"), "aspect"), (F.col("p_name").rlike(r"\b(ring|box)\b"), "pattern")]
    return K.rule_reasons(p, rules).select("p_partkey", F.concat_ws(";", "reasons").alias("reasons"))


def p9(spark, d):
    rows = bind(spark, d, "lines").withColumn("id", F.concat_ws("-", "order_id", "pos"))
    row = [(F.col("item_price") > 90_000, "price out of range"), (F.col("buyer_shipping") < 1, "no postage")]
    group = [(["order_id", "line"], F.count("*") > 1, "line twice"), (["order_id"], F.countDistinct("returnflag") == 3, "mixed returns")]
    return K.validate_rows(rows, "id", row, group)


def j18(spark, d):
    n = bind(spark, d, "remote").withColumn("policy", F.col("sku") % 4)
    allowed = table(spark, d, "region").select((F.col("r_regionkey") - 2).cast("long").alias("policy")).where("policy > 0")
    served = bind(spark, d, "local").where("listing_id is not null").select("listing_id", F.col("title").alias("served"))
    return K.terms_survey(n, allowed, served).select("sku", "served")


def j19(spark, d):
    live = bind(spark, d, "remote").where("status = 'PUBLISHED'").select("sku", F.col("title").rlike(r"\b(ring|box|cup)\b").alias("class"))
    return K.live_vs_local(live, bind(spark, d, "local"), "sku", ["status"]).groupBy("class", "found", "local_status").agg(F.count("*").alias("n"))


def h2(spark, d):
    e = bind(spark, d, "calls").select("session", "kind", "ts", F.when(F.col("value") < 60, 1).otherwise(-1).alias("delta"), "event_id")
    return K.replay(e, "session", "kind", F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))


def s12(spark, d):
    return table(spark, d, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


QUERIES = {"k2_split_by_age": k2, "k3_top_sellers": k3, "k4_best_per_listing": k4, "k5_queue_order": k5, "k6_price_audit": k6, "k7_floor_verdict": k7, "k8_best_answer": k8, "k10_latest_per_key": k10, "u5_dedupe_first": u5, "w11_lot_plan": w11, "w13_lineup": w13, "w15_advance_status": w15, "p5_rule_reasons": p5, "p9_validate_rows": p9, "j18_terms_survey": j18, "j19_live_vs_local": j19, "h2_replay": h2, "s12_html_text": s12}

_TAGS = r"html"
for _p, _r in [("(?is)<!--.*?-->", " "), ("(?is)<(script|style)[^>]*>.*?</(script|style)[^>]*>", " "), ("(?is)<(br|/p|/div|/li|/tr|/h[1-6])[^>]*>", "\n"), ("(?s)<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"), (r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n")]:
    _TAGS = f"regexp_replace({_TAGS}, '{_p}', '{_r}', 'g')"

ORACLE = {
    k: with_views(v)
    for k, v in {
        "k2_split_by_age": "SELECT CASE WHEN DATE '2001-12-01' - CAST(o_orderdate AS DATE) >= 1500 AND CAST(o_totalprice AS DECIMAL(18,2)) >= 50000 THEN 'seasoned' ELSE 'young' END AS age, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS ask FROM orders GROUP BY 1",
        "k3_top_sellers": "SELECT seller, count(*) AS listed, count(DISTINCT item_id) AS items FROM {comps} GROUP BY 1 ORDER BY listed DESC, seller LIMIT 5",
        "k4_best_per_listing": "WITH r AS (SELECT session, event_id, value, row_number() OVER (PARTITION BY session ORDER BY value DESC, event_id DESC) AS r FROM {calls}) SELECT session AS listing, event_id AS image FROM r WHERE r = 1 ORDER BY value DESC, session LIMIT 20",
        "k5_queue_order": "SELECT sku, status, sku % 90 AS days FROM {local}",
        "k6_price_audit": "SELECT sku, CAST(floor((CAST(price * 100 AS BIGINT) - (sku % 70 + 900) * 100) * 100.0 / (sku % 70 + 900)) AS BIGINT) AS over_bp, sku % 70 + 900 AS drop_to FROM {local} WHERE status = 'PUBLISHED' AND price > sku % 70 + 900 AND sku % 60 >= 30",
        "k7_floor_verdict": "WITH f AS (SELECT sku, price, CASE WHEN sku % 7 <> 0 THEN sku % 150 + 850 END AS f FROM {local}) SELECT sku, CASE WHEN sku % 5 = 0 THEN 'no best offer' WHEN f IS NULL THEN 'NO FLOOR' WHEN f >= price THEN 'FLOOR >= ASK' WHEN f < 870 THEN 'BELOW FLOOR' WHEN f < 900 THEN 'under rec' ELSE 'ok' END AS verdict FROM f",
        "k8_best_answer": "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) >= 80 DESC, length(text) DESC, turn) AS r FROM conversations WHERE role = 'assistant') SELECT conv_id, turn FROM r WHERE r = 1",
        "k10_latest_per_key": "WITH r AS (SELECT session, kind, event_id, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS r FROM {calls}) SELECT session, kind, event_id FROM r WHERE r = 1",
        "u5_dedupe_first": "WITH r AS (SELECT sku, title, listing_id, row_number() OVER (PARTITION BY coalesce(nullif(title, ''), CAST(listing_id AS VARCHAR)) ORDER BY sku) AS r FROM {remote}) SELECT sku, title, listing_id FROM r WHERE r = 1",
        "w11_lot_plan": "WITH g AS (SELECT o_custkey AS lot, min(o_orderkey) AS lead, arg_min(o_orderstatus, o_orderkey) AS lead_state, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS unit_floor FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT o_orderkey AS number, lead, lead_state, unit_floor FROM orders LEFT JOIN g ON lot = o_custkey",
        "w13_lineup": "WITH o AS (SELECT session, kind, min(event_id) AS seen FROM {calls} WHERE value < 20 GROUP BY 1, 2), e AS (SELECT session, kind, min(event_id) AS seen FROM {calls} GROUP BY 1, 2), m AS (SELECT e.session, e.kind, o.seen IS NULL AS fresh, coalesce(o.seen, e.seen) AS seen FROM e LEFT JOIN o ON o.session = e.session AND o.kind = e.kind) SELECT session, kind, row_number() OVER (PARTITION BY session ORDER BY fresh, seen, kind) AS number FROM m",
        "w15_advance_status": "WITH e AS (SELECT part AS sku, sold_at, order_id, pos, ['DRAFTED', 'SYNCED', 'PUBLISHED', 'ENDED', 'SYNCED'][line % 5 + 1] AS s FROM {lines}), n AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY sold_at, order_id, pos) AS i FROM e), g AS (SELECT sku, arg_max(s, i) FILTER (s IN ('PUBLISHED', 'ENDED')) AS s, max(i) FILTER (s IN ('PUBLISHED', 'ENDED')) AS p, max(i) FILTER (s = 'SYNCED') AS q, min(sold_at) FILTER (s = 'PUBLISHED') AS first_published FROM n GROUP BY 1) SELECT sku, CASE WHEN q IS NOT NULL AND (p IS NULL OR (q > p AND s <> 'PUBLISHED')) THEN 'SYNCED' WHEN p IS NOT NULL THEN s ELSE 'DRAFTED' END AS status, first_published FROM g",
        "p5_rule_reasons": "SELECT p_partkey, concat_ws(';', CASE WHEN p_size > 40 THEN 'too large' END, CASE WHEN lower(p_type) LIKE '%e%' THEN 'aspect' END, CASE WHEN regexp_matches(p_name, '\\b(ring|box)\\b') THEN 'pattern' END) AS reasons FROM part",
        "p9_validate_rows": "WITH l AS (SELECT *, CAST(order_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR) AS id FROM {lines}) SELECT id, 'price out of range' AS error FROM l WHERE item_price > 90000 UNION ALL SELECT id, 'no postage' FROM l WHERE buyer_shipping < 1 UNION ALL SELECT id, 'line twice' FROM l WHERE (order_id, line) IN (SELECT (order_id, line) FROM l GROUP BY order_id, line HAVING count(*) > 1) UNION ALL SELECT id, 'mixed returns' FROM l WHERE order_id IN (SELECT order_id FROM l GROUP BY 1 HAVING count(DISTINCT returnflag) = 3)",
        "j18_terms_survey": "SELECT r.sku, l.title AS served FROM {remote} r LEFT JOIN {local} l ON l.listing_id = r.listing_id WHERE r.status = 'PUBLISHED' AND r.sku % 4 NOT IN (SELECT r_regionkey - 2 FROM region WHERE r_regionkey > 2)",
        "j19_live_vs_local": "SELECT regexp_matches(r.title, '\\b(ring|box|cup)\\b') AS class, l.sku IS NOT NULL AS found, l.status AS local_status, count(*) AS n FROM {remote} r LEFT JOIN {local} l ON l.sku = r.sku WHERE r.status = 'PUBLISHED' GROUP BY 1, 2, 3",
        "h2_replay": "WITH n AS (SELECT session, kind, CAST(sum(CASE WHEN value < 60 THEN 1 ELSE -1 END) AS BIGINT) AS n FROM {calls} WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2) SELECT session, kind, unnest(range(1, n + 1)) AS copy FROM n WHERE n > 0",
        "s12_html_text": f"SELECT page_id, trim({_TAGS}, chr(10) || ' ') AS text FROM pages",
    }.items()
}
