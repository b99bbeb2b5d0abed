"""Bindings of the given tables to the shapes that the operators take.

Each view is SQL that Spark and DuckDB both read; {name} stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "comps": """
        SELECT p.p_name AS query,
          p.p_name || ' ' || lower(p.p_type) || CASE l.l_partkey % 10 WHEN 0 THEN ' lot of 5' WHEN 1 THEN ' 14k gold filled' WHEN 2 THEN ' pair'
            WHEN 3 THEN ' 1951 1952' WHEN 4 THEN ' 7" x 6"' ELSE '' END AS title,
          CAST(floor(l.l_extendedprice / l.l_quantity * 100) AS DOUBLE) / 100 AS price,
          CASE WHEN l.l_linestatus = 'F' THEN CAST(floor((l.l_extendedprice / l.l_quantity + l.l_tax * 10) * 100) AS DOUBLE) / 100 END AS total_price,
          CASE l.l_returnflag WHEN 'A' THEN 'Used' WHEN 'R' THEN 'New' END AS condition,
          'seller' || CAST(l.l_suppkey AS VARCHAR(20)) AS seller, l.l_suppkey % 100 AS seller_feedback_score, l.l_linenumber AS bids_count,
          CASE WHEN l.l_linenumber % 2 = 0 THEN 'Auction' ELSE 'FixedPriceItem' END AS listing_type,
          l.l_discount >= 0.095 AS bo_accepted, CAST(l.l_shipdate AS DATE) AS sold_date, p.p_type AS kind,
          CASE WHEN l.l_shipdate < TIMESTAMP '1999-01-01 00:00:00' THEN 'best_match' ELSE 'price_high' END AS run,
          CAST(l.l_orderkey AS VARCHAR(20)) || '-' || CAST(l.l_linenumber AS VARCHAR(20)) || '-' || CAST(l.l_partkey AS VARCHAR(20)) || '-' || CAST(l.l_suppkey AS VARCHAR(20)) AS item_id
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "lines": """
        SELECT l_orderkey AS order_id, l_partkey AS part, l_suppkey AS supplier, l_linenumber AS line, CAST(l_shipdate AS DATE) AS sold_at,
          CAST(l_extendedprice AS DECIMAL(18,2)) AS item_price, CAST(l_tax * 100 AS DECIMAL(18,2)) AS buyer_shipping, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
          l_discount AS discount, l_returnflag AS returnflag, l_linestatus AS linestatus,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS pos
        FROM {lineitem}""",
    "sales": """
        SELECT o.o_orderkey AS order_id, o.o_custkey AS buyer, l.l_partkey AS part, l.l_suppkey AS supplier, CAST(o.o_orderdate AS DATE) AS listed_at, CAST(l.l_shipdate AS DATE) AS sold_at,
          CAST(l.l_extendedprice AS DECIMAL(18,2)) AS gross, CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS fee,
          CASE WHEN l.l_linestatus = 'F' THEN CAST(l.l_tax * 100 AS DECIMAL(18,2)) END AS postage, CAST(p.p_retailprice * l.l_quantity AS DECIMAL(18,2)) AS asked,
          p.p_type AS kind, p.p_brand AS brand, l.l_returnflag = 'R' AS promoted
        FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "local": """
        SELECT p_partkey AS sku, CASE WHEN p_size % 5 = 0 THEN 'SOLD' WHEN p_size % 3 = 0 THEN 'DRAFTED' ELSE 'PUBLISHED' END AS status, p_name AS title,
          CAST(p_retailprice AS DECIMAL(18,2)) AS price, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey * 7 END AS listing_id
        FROM {part} WHERE p_partkey % 17 <> 0""",
    "remote": """
        SELECT p_partkey AS sku, CASE WHEN p_size % 4 = 0 THEN 'UNPUBLISHED' ELSE 'PUBLISHED' END AS status, p_name AS title,
          CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(p_retailprice + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) END AS price, p_partkey * 7 AS listing_id
        FROM {part} WHERE p_partkey % 19 <> 0""",
    "stock": """
        SELECT p_partkey AS sku, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS store, p_name || CASE p_partkey % 9 WHEN 0 THEN ' 14k gold ring' WHEN 1 THEN ' sterling spoon' ELSE '' END AS title, price,
          CASE WHEN p_size % 7 <> 0 THEN DATE '1997-01-01' + CAST(p_size * 10 AS INT) END AS start, CASE WHEN p_size % 11 = 0 THEN 'Auction' ELSE 'FixedPriceItem' END AS kind, p_partkey % 97 = 0 AS named_hold,
          CASE WHEN p_partkey % 29 = 0 THEN 'hold ' || CAST(p_size AS VARCHAR(9)) END AS held, CASE WHEN p_partkey % 58 = 0 THEN DATE '1998-05-01' + CAST(p_size AS INT) END AS until,
          CASE WHEN p_size % 13 <> 0 THEN CAST(price * CAST(0.62 AS DECIMAL(4,2)) AS DECIMAL(18,2)) END AS recommended, CASE WHEN p_size % 3 = 0 THEN CAST(price * CAST(0.88 AS DECIMAL(4,2)) AS DECIMAL(18,2)) END AS conservative,
          DATE '1998-06-01' - CAST(p_partkey % 20 AS INT) AS priced_on, p_partkey % 37 <> 0 AS floors_read, CASE WHEN p_partkey % 3 = 0 THEN CAST(price * CAST(0.80 AS DECIMAL(4,2)) AS DECIMAL(18,2)) END AS decline,
          CASE WHEN p_partkey % 4 = 0 THEN CAST(price * CAST(0.86 AS DECIMAL(4,2)) AS DECIMAL(18,2)) END AS cost, CASE WHEN p_partkey % 10 = 0 THEN CAST(price * CAST(0.90 AS DECIMAL(4,2)) AS DECIMAL(18,2)) END AS consign_floor, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DECIMAL(18,4)) END AS weight
        FROM (SELECT *, CAST(floor(p_retailprice / (p_partkey % 40 + 1) * 100) / 100 AS DECIMAL(18,2)) AS price FROM {part}) p""",
    "calls": """
        SELECT event_id, ts, user_id AS session, event_type AS kind, value FROM {events}""",
}


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """sql after WITH clauses for the views it names as {view}."""
    used = [v for v in VIEWS if f"{{{v}}}" in sql]
    plain = {v: re.sub(r"\{(\w+)\}", r"\1", VIEWS[v]) for v in used}
    head = ",\n".join(f"{v}_v AS ({plain[v]})" for v in used)
    body = re.sub(r"\{(%s)\}" % "|".join(VIEWS), r"\1_v", sql).strip()
    if not head:
        return body
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
