"""Queries of replies, the worst repeat and listings kept out of campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replies as R
from .views import bind, table, with_views

POSTS = """SELECT conv_id AS thread, turn AS i, role || turn AS author, text, CASE WHEN length(text) % 3 = 0 THEN 'm' || CAST(length(text) % 5 AS VARCHAR(9)) END AS maker, length(text) % 2 = 0 AS agrees FROM {conversations}"""
DRAFTS = """SELECT p_partkey * 7 AS listing_id, CASE WHEN p_partkey % 4 = 0 THEN p_partkey END AS sku, '---' || chr(10) || 'title: ' || p_name || chr(10) || CASE p_size % 5 WHEN 0 THEN 'promoted: "False" # by hand' WHEN 1 THEN 'promoted: no' WHEN 2 THEN 'promoted: 5%' ELSE 'price: 4' END || chr(10) || '---' || chr(10)
  || CASE WHEN p_size % 5 > 2 THEN 'promoted: false' ELSE '' END AS text FROM {part} WHERE p_partkey % 3 = 0"""


def _posts(spark, d):
    return spark.sql(POSTS, conversations=table(spark, d, "conversations"))


def a26_quotes(spark, d):
    return R.quotes(_posts(spark, d))


def a26_flags(spark, d):
    a = R.ambiguous_agreements(_posts(spark, d))
    return a.select("thread", "i", "author", F.array_join("makers", ",").alias("makers"))


def a22_worst(spark, d):
    return R.worst_repeat(bind(spark, d, "calls"))


def p8(spark, d):
    listings = bind(spark, d, "remote").select("listing_id", "sku", "price", F.when(F.col("sku") % 6 != 0, F.col("sku") % 60).alias("age_days"))
    consigned = table(spark, d, "part").where("p_size % 11 = 0").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).otherwise(F.col("p_partkey") * 7).cast("string").alias("key"))
    return R.kept_out(listings, spark.sql(DRAFTS, part=table(spark, d, "part")), consigned, 1000.0, 30)


QUERIES = {"a26_quotes": a26_quotes, "a26_ambiguous": a26_flags, "a22_worst_repeat": a22_worst, "p8_kept_out": p8}

_P = POSTS.replace("{conversations}", "conversations")
ORACLE = {
    k: with_views(v)
    for k, v in {
        "a26_quotes": f"WITH p AS ({_P}), n AS (SELECT *, length(text) AS l, row_number() OVER (PARTITION BY thread, maker ORDER BY CASE WHEN length(text) > 90 THEN 0 ELSE 1 END, CASE WHEN length(text) > 90 THEN -i ELSE -length(text) END, i) AS r FROM p WHERE maker IS NOT NULL) SELECT thread, maker, substr(text, 1, 90) AS quote FROM n WHERE r = 1",
        "a26_ambiguous": f"""WITH p AS ({_P}), u AS (SELECT * FROM p WHERE agrees AND maker IS NULL AND EXISTS (SELECT 1 FROM p q WHERE q.thread = p.thread AND q.i < p.i AND q.maker IS NOT NULL)),
          v AS (SELECT *, (SELECT max(x.i) FROM u x WHERE x.thread = u.thread AND x.i < u.i) AS pi FROM u),
          s AS (SELECT v.thread, v.i, v.author, p.maker FROM v JOIN p ON p.thread = v.thread AND p.maker IS NOT NULL AND p.i < v.i AND p.i >= coalesce((SELECT max(y.i) FROM p y WHERE y.thread = v.thread AND y.maker IS NOT NULL AND y.i < v.pi), -1))
          SELECT thread, i, author, array_to_string(list_sort(list(DISTINCT maker)), ',') AS makers FROM s GROUP BY 1, 2, 3 HAVING count(DISTINCT maker) > 1""",
        "a22_worst_repeat": "SELECT session, kind, count(*) AS times FROM {calls} GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY times DESC, session, kind LIMIT 1",
        "p8_kept_out": """WITH o AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 = 0 AND p_size % 5 < 2), os AS (SELECT p_partkey * 7 AS id FROM part WHERE p_partkey % 3 = 0 AND p_size % 5 < 2 UNION SELECT p_partkey FROM part WHERE p_partkey % 12 = 0 AND p_size % 5 < 2), c AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE p_partkey * 7 END AS id FROM part WHERE p_size % 11 = 0),
          r AS (SELECT listing_id, CASE WHEN listing_id IN (SELECT id FROM os) OR sku IN (SELECT id FROM os) THEN 'opted out' WHEN listing_id IN (SELECT id FROM c) OR sku IN (SELECT id FROM c) THEN 'consigned' WHEN price > 1000 AND (sku % 6 = 0 OR sku % 60 < 30) THEN 'young' END AS reason FROM {remote}) SELECT * FROM r WHERE reason IS NOT NULL""",
    }.items()
}
