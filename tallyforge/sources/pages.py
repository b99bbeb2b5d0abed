"""Text of web pages, and readers of ledgers and of transcripts of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags that end a line, and entities.
BREAKS = "br|/p|/div|/li|/tr|/h[1-6]"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_to_text(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags out, block ends as newlines, common entities read; null stays null."""
    t = F.regexp_replace(html, "(?is)<!--.*?-->", " ")
    t = F.regexp_replace(t, "(?is)<(script|style)[^>]*>.*?</(script|style)[^>]*>", " ")
    t = F.regexp_replace(t, f"(?is)<({BREAKS})[^>]*>", "\n")
    t = F.regexp_replace(t, "(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")
    return F.trim(t, F.lit("\n "))


def read_ledger(spark: SparkSession, path: str, schema: str, **equal: str) -> DataFrame:
    """A CSV ledger of a known schema, kept in folders store=...; equal keeps rows of these values and must name columns."""
    d = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    unknown = set(equal) - set(d.columns)
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    for name, value in equal.items():
        d = d.where(F.col(name) == value)
    return d


def read_transcripts(spark: SparkSession, path: str, schema: str, longest: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(lines, counters) of JSON lines: lines longer than `longest` and lines that do not parse are left out and counted, side chains left out."""
    raw = spark.read.text(path).withColumn("long", F.length("value") > longest)
    d = raw.withColumn("r", F.when(~F.col("long"), F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})))
    bad = ~F.col("long") & (F.col("r").isNull() | F.col("r._bad").isNotNull())
    lines = d.where(~F.col("long") & ~bad).select("r.*").drop("_bad")
    if "isSidechain" in lines.columns:
        lines = lines.where(~F.coalesce("isSidechain", F.lit(False)))
    return lines, d.agg(F.count_if("long").alias("too_long"), F.count_if(bad).alias("unreadable"))
