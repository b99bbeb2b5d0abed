"""Queries of the listing rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing_rules as L
from .views import bind, with_views


def p8(spark, d):
    hit = L.covers(F.col("price"), F.lit(950), F.when(F.col("sku") % 5 != 0, F.lit(1200)))
    return bind(spark, d, "remote").select("sku", hit.alias("covered"))


def w12(spark, d):
    return L.rerun_cap(bind(spark, d, "local"), "sku", "DRAFTED", "listing_id", 20).select("sku", "rerun")


def u4(spark, d):
    return L.duplicate_titles(bind(spark, d, "local"))


QUERIES = {"p8_coverage": p8, "w12_rerun_cap": w12, "u4_duplicate_titles": u4}

ORACLE = {
    k: with_views(v)
    for k, v in {
        "p8_coverage": "SELECT sku, (price IS NULL OR price >= 950) AND (price IS NULL OR sku % 5 = 0 OR price <= 1200) AS covered FROM {remote}",
        "w12_rerun_cap": "WITH r AS (SELECT sku, status, row_number() OVER (PARTITION BY status ORDER BY listing_id NULLS LAST, sku) AS r FROM {local}) SELECT sku, CASE WHEN status = 'DRAFTED' AND r <= 20 THEN 'yes' ELSE '' END AS rerun FROM r",
        "u4_duplicate_titles": "SELECT substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 1, 60) AS title, count(*) AS n FROM {local} WHERE status = 'PUBLISHED' GROUP BY 1 HAVING count(*) > 1",
    }.items()
}
