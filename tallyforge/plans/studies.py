"""Queries of the studies, client accounts and holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import Money
from ..operators import studies as T
from ..streaming import streams as X
from .views import bind, table, with_views

SPLIT = "0.60"


def a15(spark, d):
    return T.title_study(bind(spark, d, "comps"), "kind", limit=30)


def a15_tokens(spark, d):
    return T.leading_tokens(bind(spark, d, "comps"))


def a16(spark, d):
    return T.body_study(table(spark, d, "documents"), "lang")


def a18(spark, d):
    return T.client_summary(bind(spark, d, "sales"), "buyer", F.lit(SPLIT).cast("decimal(4,2)"), "client")


def a19(spark, d):
    s = bind(spark, d, "sales").groupBy("order_id").agg(F.sum("fee").cast(Money).alias("fee"))
    lines = bind(spark, d, "sales").where("postage is not null").select("order_id", F.col("fee").alias("amount"))
    return T.fee_ties(s, lines)


def a22(spark, d):
    return T.samples(bind(spark, d, "calls"), "kind", ["ts", "event_id"]).select("kind", "place", "event_id")


def a23(spark, d):
    return T.economics(bind(spark, d, "calls").withColumn("seconds", F.floor("value")), "kind", "seconds")


def a33(spark, d):
    return T.statement(bind(spark, d, "sales"), "buyer")


def w7(spark, d):
    maker = F.when(F.col("role") == "assistant", F.nullif(F.regexp_extract("text", "([a-z]{7,})", 1), F.lit("")))
    return T.attribute_agreements(table(spark, d, "conversations"), "conv_id", "turn", maker, F.col("role") == "user")


def p10(spark, d):
    e = bind(spark, d, "calls")
    day = e.groupBy("kind", F.to_date("ts").alias("day")).agg(F.min("ts").alias("start"), F.min("session").alias("s"))
    w = day.select(F.concat_ws("-", "kind", "day").alias("show"), "start", (F.col("start") + F.expr("INTERVAL 3 HOURS")).alias("closes"), F.array(F.col("s") % 10).alias("item_ids"))
    return T.hold_orders(e.select(F.col("event_id").alias("order_id"), F.col("ts").alias("created"), F.array(F.col("session") % 10).alias("items")), w)


def u4(spark, d):
    live, ledger = bind(spark, d, "remote").where("status = 'PUBLISHED'"), bind(spark, d, "local")
    return T.cross_check(live, ledger, bind(spark, d, "sales").where("brand > 'Brand#3'").select(F.col("part").alias("sku")))


def x4(spark, d):
    """Batch twin of the stream of session activity."""
    e = bind(spark, d, "calls").withColumn("ts", F.col("ts").cast("timestamp"))
    return X.activity(e).select("session", F.unix_seconds("start").alias("start_s"), "n")


QUERIES = {"a15_title_study": a15, "a15_leading_tokens": a15_tokens, "a16_body_study": a16, "a18_client_summary": a18, "a19_fee_ties": a19, "a22_samples": a22, "a23_economics": a23, "a33_statement": a33, "w7_agreements": w7, "p10_hold_orders": p10, "u4_cross_check": u4, "x4_activity": x4}


def _n(p: str) -> str:
    return f"CAST(coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0) AS BIGINT)"


ORACLE = {
    k: with_views(v)
    for k, v in {
        "a15_title_study": "SELECT kind, count(title) AS n, CAST(sum(length(title)) AS BIGINT) AS chars, count(*) FILTER (length(title) BETWEEN 25 AND 30) AS near_limit, count(*) FILTER (regexp_matches(title, '\\b(19|20)\\d{2}\\b')) AS with_year, count(*) FILTER (regexp_matches(title, '\\d+\\s*([\"'']|in\\b|cm\\b|mm\\b)')) AS with_measure FROM {comps} GROUP BY 1",
        "a15_leading_tokens": "SELECT lower(regexp_extract(title, '^\\s*(\\S+)', 1)) AS token, count(*) AS n FROM {comps} GROUP BY 1 HAVING token <> '' ORDER BY n DESC, token LIMIT 12",
        "a16_body_study": rf"WITH w AS (SELECT lang, text, regexp_extract_all(text, '\p{{L}}+') AS w FROM documents) SELECT lang, count(*) AS n, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS words, {_n('[.!?]+')} AS sentences, {_n('[^' + chr(92) + 'n]+')} AS paragraphs, CAST(coalesce(sum(len(list_filter(w, lambda x: x IN ('I', 'we', 'my', 'our', 'We', 'My', 'Our')))), 0) AS BIGINT) AS first_person, CAST(coalesce(sum(len(list_filter(w, lambda x: regexp_full_match(x, '\p{{Lu}}{{2,}}')))), 0) AS BIGINT) AS caps FROM w GROUP BY 1",
        "a18_client_summary": "WITH n AS (SELECT buyer, gross, CAST(gross - fee - coalesce(postage, 0) AS DECIMAL(18,2)) AS net FROM {sales}) SELECT buyer, count(*) AS n, CAST(sum(gross) AS DECIMAL(18,2)) AS gross, CAST(sum(net) AS DECIMAL(18,2)) AS net, CAST(sum(CASE WHEN net < 0 THEN net ELSE CAST(net * CAST(0.60 AS DECIMAL(4,2)) AS DECIMAL(18,2)) END) AS DECIMAL(18,2)) AS share FROM n GROUP BY 1",
        "a19_fee_ties": "SELECT order_id, CASE WHEN count(postage) = 0 THEN 'MISSING' WHEN abs(sum(fee) - sum(fee) FILTER (postage IS NOT NULL)) > 0.01 THEN 'DON''T TIE' ELSE 'TIE' END AS status FROM {sales} GROUP BY 1",
        "a22_samples": "WITH r AS (SELECT kind, event_id, row_number() OVER (PARTITION BY kind ORDER BY ts, event_id) AS place FROM {calls}) SELECT kind, place, event_id FROM r WHERE place <= 8",
        "a23_economics": "WITH s AS (SELECT kind, CAST(floor(value) AS BIGINT) AS s FROM {calls}), r AS (SELECT kind, s, row_number() OVER (PARTITION BY kind ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM s) SELECT kind, count(*) AS n, max(s) FILTER (i = CAST(floor(n * 0.9) AS BIGINT)) AS p90, count(*) FILTER (s > 30) AS slow, CAST(coalesce(sum(s) FILTER (s > 30), 0) AS BIGINT) AS slow_s FROM r GROUP BY 1",
        "a33_statement": "WITH g AS (SELECT buyer, sum(gross) AS sale, -sum(fee) AS fee, -coalesce(sum(postage), 0) AS postage FROM {sales} GROUP BY 1), u AS (SELECT buyer, 'sale' AS kind, sale AS amount FROM g UNION ALL SELECT buyer, 'fee', fee FROM g UNION ALL SELECT buyer, 'postage', postage FROM g UNION ALL SELECT buyer, 'total', sale + fee + postage FROM g) SELECT buyer, kind, CAST(amount AS DECIMAL(18,2)) AS amount FROM u",
        "w7_agreements": "WITH p AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN nullif(regexp_extract(text, '([a-z]{7,})', 1), '') END AS m FROM conversations), l AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead FROM p), o AS (SELECT *, role = 'user' AND lead IS NOT NULL AS ok FROM l), s AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM o), i AS (SELECT conv_id, seg, m AS v FROM s WHERE m IS NOT NULL UNION SELECT conv_id, seg, lead FROM s WHERE lead IS NOT NULL), c AS (SELECT conv_id, seg, count(DISTINCT v) AS c FROM i GROUP BY 1, 2) SELECT s.conv_id, s.turn, s.lead AS maker, c.c > 1 AS ambiguous FROM s JOIN c ON c.conv_id = s.conv_id AND c.seg = s.seg WHERE s.ok",
        "p10_hold_orders": """WITH w AS (SELECT kind || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS "show", min(ts) AS s, min(session) % 10 AS i FROM {calls} GROUP BY kind, CAST(ts AS DATE)), j AS (SELECT event_id, "show", row_number() OVER (PARTITION BY event_id ORDER BY s, "show") AS r FROM {calls}, w WHERE ts < s + INTERVAL 3 HOURS AND ts >= s - INTERVAL 2 HOURS AND (ts >= s OR session % 10 = i)) SELECT event_id AS order_id, "show" FROM j WHERE r = 1""",
        "u4_cross_check": "WITH a AS (SELECT DISTINCT sku FROM {remote} WHERE status = 'PUBLISHED'), s AS (SELECT DISTINCT part AS sku FROM {sales} WHERE brand > 'Brand#3'), k AS (SELECT sku FROM {local}) SELECT sku, 'sold and live' AS issue FROM s WHERE sku IN (SELECT sku FROM a) UNION ALL SELECT sku, 'sold, not in ledger' FROM s WHERE sku NOT IN (SELECT sku FROM k) UNION ALL SELECT sku, 'live, not in ledger' FROM a WHERE sku NOT IN (SELECT sku FROM k)",
        "x4_activity": "WITH g AS (SELECT session, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, event_id) < INTERVAL 300 SECONDS THEN 0 ELSE 1 END AS f FROM {calls}), b AS (SELECT *, sum(f) OVER (PARTITION BY session ORDER BY ts, event_id) AS b FROM g) SELECT session, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM b GROUP BY session, b.b",
    }.items()
}
