"""Comparable-sale queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import comps as C
from .views import bind, table, with_views

# The same rules in SQL, for DuckDB.
_MULTI = r"""(regexp_matches(lower(title), '\b(lot|lots|set|sets|bundle|bundles|collection|pair|pairs|group|grouping|joblot)\b')
  OR regexp_matches(title, '(?i)\blot of\s*\d+') OR len(list_distinct(regexp_extract_all(title, '\b((19|20)\d{2})\b'))) > 1)"""
_COHORT = "CASE WHEN condition = 'New' THEN 'new' WHEN condition = 'Used' THEN 'used' ELSE 'unknown' END"
_PLATED = r"regexp_matches(title, '(?i)\bgold[\s-]*(plate|plated|filled|fill)\b')"
_EXCL = """CASE WHEN bo_accepted THEN 'exclusions:best offer accepted' WHEN listing_type = 'Auction' AND bids_count <= 1 THEN 'exclusions:single-bid auction'
  WHEN seller_feedback_score < 50 THEN 'exclusions:seller feedback' END"""
_ANNOTATED = f"""annotated AS (SELECT *, coalesce(CASE WHEN {_MULTI} THEN 'unit_match:single' END, {_EXCL}) AS drop_reason FROM {{comps}})"""
_USED = f"""early AS (SELECT *, {_COHORT} AS cohort, CASE WHEN {_MULTI} THEN 'unit_match:single' WHEN {_PLATED} AND false THEN 'plated_not_solid' END AS e FROM {{comps}}),
  near AS (SELECT *, count(CASE WHEN e IS NULL AND cohort = 'used' THEN 1 END) OVER (PARTITION BY query) AS c FROM early),
  used AS (SELECT *, coalesce(e, CASE WHEN cohort <> 'used' AND NOT (c < 3 AND cohort = 'unknown') THEN 'condition_cohort:used' END, {_EXCL}) AS drop_reason FROM near)"""
_DIST = """dist AS (SELECT query, count(price) AS n, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3, quantile_cont(price, 0.9) AS q9, min(price) AS lo, max(price) AS hi
  FROM annotated WHERE drop_reason IS NULL AND run = 'best_match' GROUP BY query)"""


def annotated(spark, sf_dir):
    return C.annotate_comps(bind(spark, sf_dir, "comps"))


def filter_log(spark, sf_dir):
    return C.filter_log(annotated(spark, sf_dir))


def used_cohort(spark, sf_dir):
    a = C.annotate_comps(bind(spark, sf_dir, "comps"), condition="used")
    return a.groupBy("query", "drop_reason").agg(F.count("*").alias("n")).withColumn("drop_reason", F.coalesce("drop_reason", F.lit("kept")))


def distribution(spark, sf_dir):
    kept = annotated(spark, sf_dir).where("drop_reason is null and run = 'best_match'")
    return C.distribution(kept, ["query"], digits=4).select("query", "n", "min", "max", "median", "p25", "p75", "iqr")


def price_tiers(spark, sf_dir):
    return C.price_tiers(annotated(spark, sf_dir), ["query"])


def cap_at_new(spark, sf_dir):
    new = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("query")).agg(F.round(F.max("p_retailprice"), 2).alias("new_price"))
    return C.cap_at_new(price_tiers(spark, sf_dir), new, ["query"])


def charm_pattern(spark, sf_dir):
    return C.charm_pattern(bind(spark, sf_dir, "comps"), ["query"])


def merge_sources(spark, sf_dir):
    c = bind(spark, sf_dir, "comps")
    m = C.merge_sources(c.where("run = 'best_match'"), c.where("bids_count <= 4"), order=("sold_date", "price", "total_price", "bo_accepted"))
    return m.groupBy("query", "comp_source").agg(F.count("*").alias("n"), F.sum(F.col("price").cast(S.Money)).alias("total"))


def compare_sources(spark, sf_dir):
    c = bind(spark, sf_dir, "comps").where("total_price is not null").groupBy("query", "item_id").agg(F.min("price").alias("price"), F.max("total_price").alias("total_price"))
    return C.compare_sources(c, c.withColumn("price", F.col("total_price")), ["query"])


def capture_quality(spark, sf_dir):
    return C.capture_quality(bind(spark, sf_dir, "comps"), ["query"])


def seller_rollup(spark, sf_dir):
    return C.seller_rollup(bind(spark, sf_dir, "comps"))


def landscape(spark, sf_dir):
    c = bind(spark, sf_dir, "comps")
    return C.landscape(c.where("run = 'best_match'"), c.where("run = 'price_high'"))


def scalars(spark, sf_dir):
    c = bind(spark, sf_dir, "comps")
    return c.select("item_id", "title", "price", S.charm_ending(F.col("price")).alias("ending"), S.whole_dollar(F.col("price")).alias("dollars"), S.condition_cohort(F.col("condition")).alias("cohort"), S.looks_multi_item(F.col("title")).alias("multi"), S.is_plated(F.col("title")).alias("plated"), S.title_key(F.col("title")).alias("title_key")).distinct()


QUERIES = {
    "p1_annotate_filters": filter_log,
    "p2_condition_pooling": used_cohort,
    "a1_distribution": distribution,
    "a3_price_tiers": price_tiers,
    "a4_cap_at_new": cap_at_new,
    "a5_charm_pattern": charm_pattern,
    "j3_merge_sources": merge_sources,
    "j4_compare_sources": compare_sources,
    "a27_capture_quality": capture_quality,
    "a14_seller_rollup": seller_rollup,
    "j16_landscape": landscape,
    "f_comp_scalars": scalars,
}

_CENTS = "CAST(CAST(price AS DECIMAL(18,2)) * 100 AS BIGINT) % 100"
_ENDING = f"CASE {_CENTS} WHEN 0 THEN '.00' WHEN 99 THEN '.99' WHEN 97 THEN '.97' WHEN 95 THEN '.95' ELSE 'other' END"
_TIERS = f"""{_ANNOTATED}, {_DIST}, top AS (SELECT query, max(price) AS ceiling FROM annotated WHERE drop_reason IS NULL AND run = 'price_high' GROUP BY query),
  r AS (SELECT query, n, round(q1, 4) AS q1, round(q2, 4) AS q2, round(q9, 4) AS q9, round((q3 - q1) / nullif(q2, 0), 3) AS d, ceiling FROM dist LEFT JOIN top USING (query)),
  tiers AS (SELECT query, n, CASE WHEN n < 3 THEN 'thin' WHEN n >= 8 AND d <= 0.5 THEN 'good' ELSE 'partial' END AS confidence,
    CASE WHEN n >= 3 THEN floor(CAST(q1 AS DECIMAL(38,10)) + 0.5)::DOUBLE END AS conservative, CASE WHEN n >= 3 THEN floor(CAST(q2 AS DECIMAL(38,10)) + 0.5)::DOUBLE END AS recommended,
    CASE WHEN n >= 3 THEN floor(CAST(coalesce(ceiling, q9) AS DECIMAL(38,10)) + 0.5)::DOUBLE END AS push_high, CASE WHEN n >= 3 THEN coalesce(ceiling > 2.5 * q2, false) END AS needs_vetting FROM r)"""

ORACLE = {
    k: with_views(v)
    for k, v in {
        "p1_annotate_filters": f"WITH {_ANNOTATED} SELECT split_part(drop_reason, ':', 1) AS filter, count(*) AS removed FROM annotated WHERE drop_reason IS NOT NULL GROUP BY 1",
        "p2_condition_pooling": f"WITH {_USED} SELECT query, coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n FROM used GROUP BY 1, 2",
        "a1_distribution": f"""WITH {_ANNOTATED}, {_DIST} SELECT query, n, round(lo, 4) AS min, round(hi, 4) AS max, round(q2, 4) AS median, round(q1, 4) AS p25, round(q3, 4) AS p75, round(q3 - q1, 4) AS iqr FROM dist""",
        "a3_price_tiers": f"WITH {_TIERS} SELECT * FROM tiers",
        "a4_cap_at_new": f"""WITH {_TIERS}, new AS (SELECT p_name AS query, round(max(p_retailprice), 2) AS new_price FROM part GROUP BY 1), c AS (SELECT *, round(new_price * 0.75, 2) AS cap FROM tiers LEFT JOIN new USING (query))
          SELECT query, least(conservative, cap) AS conservative, least(recommended, cap) AS recommended, least(push_high, cap) AS push_high, cap, coalesce(push_high >= new_price, false) AS above_new FROM c""",
        "a5_charm_pattern": f"""WITH d AS (SELECT query, seller, {_ENDING} AS ending FROM {{comps}} WHERE price > 0), per AS (SELECT query, ending, count(*) AS c FROM d GROUP BY 1, 2),
          t AS (SELECT query, c, ending, row_number() OVER (PARTITION BY query ORDER BY c DESC, ending DESC) AS r, sum(c) OVER (PARTITION BY query) AS n FROM per), s AS (SELECT query, count(DISTINCT seller) AS ns FROM d GROUP BY 1),
          x AS (SELECT query, ending, round(c / n, 3) AS share, ns, CAST(n AS BIGINT) AS n FROM t JOIN s USING (query) WHERE r = 1),
          y AS (SELECT *, CASE WHEN n < 5 OR ns < 3 THEN 'too few competitors' WHEN share < 0.6 THEN 'no majority ending' WHEN ending = 'other' THEN 'top ending is other' END AS reason FROM x)
          SELECT query, CASE WHEN reason IS NULL THEN ending END AS pattern, share, ns AS n_sellers, n AS n_listings, reason FROM y""",
        "j3_merge_sources": """WITH c AS (SELECT * FROM {comps}), p AS (SELECT * FROM c WHERE run = 'best_match'), s AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sold_date, price, total_price NULLS FIRST, bo_accepted) AS r FROM c WHERE bids_count <= 4),
          m AS (SELECT query, 'primary' AS comp_source, price FROM p UNION ALL SELECT query, 'secondary', price FROM s WHERE r = 1 AND item_id NOT IN (SELECT item_id FROM p))
          SELECT query, comp_source, count(*) AS n, sum(CAST(price AS DECIMAL(18,2))) AS total FROM m GROUP BY 1, 2""",
        "j4_compare_sources": """WITH c AS (SELECT query, item_id, min(price) AS pa, max(total_price) AS pb FROM {comps} WHERE total_price IS NOT NULL GROUP BY 1, 2)
          SELECT query, count(*) AS matched, count(*) FILTER (abs(pa - pb) < 0.01) AS same_price, count(*) FILTER (abs(pa - pb) >= 0.01) AS differ, round(max(abs(pa - pb)), 2) AS widest FROM c GROUP BY 1""",
        "a27_capture_quality": f"""SELECT query, count(*) AS n, count(total_price) AS with_delivered, count(*) FILTER (bo_accepted) AS n_bo_accepted, count(*) FILTER (condition IS NULL) AS no_condition, count(*) FILTER ({_ENDING} <> 'other') AS n_charm FROM {{comps}} GROUP BY 1""",
        "a14_seller_rollup": """WITH k AS (SELECT seller, kind, count(*) AS c FROM {comps} GROUP BY 1, 2), r AS (SELECT seller, kind, row_number() OVER (PARTITION BY seller ORDER BY c DESC, kind) AS r FROM k),
          t AS (SELECT seller, string_agg(kind, ',' ORDER BY r) AS top_kinds FROM r WHERE r <= 3 GROUP BY 1), g AS (SELECT seller, count(*) AS n, sum(CAST(price AS DECIMAL(18,2))) AS total, round(quantile_cont(price, 0.5), 4) AS median_price, max(price) AS max_price, max(seller_feedback_score) AS best_feedback FROM {comps} GROUP BY 1)
          SELECT * FROM g JOIN t USING (seller)""",
        "j16_landscape": """WITH s AS (SELECT seller, count(*) AS n_sold, sum(CAST(price AS DECIMAL(18,2))) AS realized FROM {comps} WHERE run = 'best_match' GROUP BY 1), a AS (SELECT seller, count(*) AS n_active, sum(CAST(price AS DECIMAL(18,2))) AS ask_total FROM {comps} WHERE run = 'price_high' GROUP BY 1)
          SELECT seller, n_sold, realized, coalesce(n_active, 0) AS n_active, ask_total FROM s LEFT JOIN a USING (seller)""",
        "f_comp_scalars": f"""SELECT DISTINCT item_id, title, price, {_ENDING} AS ending, floor(CAST(price AS DECIMAL(38,10)) + 0.5)::DOUBLE AS dollars, {_COHORT} AS cohort, {_MULTI} AS multi, {_PLATED} AS plated, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM {{comps}}""",
    }.items()
}
