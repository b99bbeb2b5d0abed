"""SQL names for scalar functions that SQL users call."""

from pyspark.sql import SparkSession

#: name -> (signature, body): fixed definitions of temporary SQL functions.
SQL_FUNCTIONS = {
    "title_key": ("(t STRING) RETURNS STRING", "trim(regexp_replace(lower(t), '[^a-z0-9]+', ' '))"),
    "charm_ending": ("(p DOUBLE) RETURNS STRING", "CASE pmod(CAST(round(p * 100) AS BIGINT), 100) WHEN 0 THEN '.00' WHEN 99 THEN '.99' WHEN 97 THEN '.97' WHEN 95 THEN '.95' ELSE 'other' END"),
    "whole_dollar": ("(p DOUBLE) RETURNS DOUBLE", "CAST(floor(p + 0.5) AS DOUBLE)"),
    "report_date": ("(ts TIMESTAMP) RETURNS DATE", "to_date(from_utc_timestamp(ts, 'America/Los_Angeles'))"),
    "sell_through": ("(sold DOUBLE, live DOUBLE) RETURNS DOUBLE", "CASE WHEN sold + live > 0 THEN sold / (sold + live) END"),
}


def register_all(spark: SparkSession) -> list[str]:
    for name, (signature, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature} RETURN {body}")
    return list(SQL_FUNCTIONS)
