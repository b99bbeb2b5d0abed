"""Rules over listings: price coverage, re-run caps, titles that are live twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import title_key


def covers(price: Column, lo: Column, hi: Column) -> Column:
    """Whether a price lies in [lo, hi]; an unknown price or bound passes."""
    return F.coalesce(price >= lo, F.lit(True)) & F.coalesce(price <= hi, F.lit(True))


def rerun_cap(rows: DataFrame, key: str, status: str, order: str, n: int) -> DataFrame:
    """rows with rerun: 'yes' for the n oldest of a status by order, then key; null dates come last.

    Keys are unique. The n are found by a bounded top-n, so no task sorts a whole status.
    """
    first = rows.where(F.col("status") == status).orderBy(F.asc_nulls_last(order), key).limit(n).select(F.col(key).alias("_k"))
    marked = rows.join(first, F.col(key) == F.col("_k"), "left")
    return marked.withColumn("rerun", F.when(F.col("_k").isNotNull(), "yes").otherwise("")).drop("_k")


def duplicate_titles(listings: DataFrame, title: str = "title", width: int = 60) -> DataFrame:
    """(title, n) of titles whose first `width` characters, normalised, stand on more than one live listing."""
    live = listings.where("status = 'PUBLISHED'").groupBy(F.substring(title_key(F.col(title)), 1, width).alias("title"))
    return live.agg(F.count("*").alias("n")).where("n > 1")
