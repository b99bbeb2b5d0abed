"""Session events: active time, repeats, segments, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_time(events: DataFrame, session: str = "session", ts: str = "ts", order: str = "event_id", idle: int = 300) -> DataFrame:
    """(session, active_s, wall_s): gaps to the next event, each at most idle seconds, and first to last."""
    w = Window.partitionBy(session).orderBy(ts, order)
    t = F.unix_seconds(F.col(ts).cast("timestamp"))
    gap = F.unix_seconds(F.lead(ts).over(w).cast("timestamp")) - t
    d = events.withColumn("_gap", F.when(gap.isNotNull(), F.least(gap, F.lit(idle))))
    return d.groupBy(session).agg(F.coalesce(F.sum("_gap"), F.lit(0)).alias("active_s"), (F.max(t) - F.min(t)).alias("wall_s"))


def session_summary(events: DataFrame, session: str = "session") -> DataFrame:
    """(session, n, kinds, top_kind, total): events, distinct kinds, the most frequent kind, and the value in all."""
    g = events.groupBy(session).agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    per = events.groupBy(session, "kind").agg(F.count("*").alias("c")).groupBy(session).agg(F.max_by("kind", F.struct("c", "kind")).alias("top_kind"))
    return g.join(per, session)


def repeats(events: DataFrame, n: int = 3, session: str = "session") -> DataFrame:
    return events.groupBy(session, "kind").agg(F.count("*").alias("times")).where(F.col("times") >= n)


def segment_asks(turns: DataFrame, key: str, order: str, is_prompt: Column) -> DataFrame:
    """Turns with the number of their segment: each prompt opens one."""
    return turns.withColumn("segment", F.sum(is_prompt.cast("int")).over(Window.partitionBy(key).orderBy(order)))


def pair_calls(events: DataFrame, session: str = "session", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Events with the kind before and whether it is the same."""
    w = Window.partitionBy(session).orderBy(ts, order)
    return events.withColumn("before", F.lag("kind").over(w)).withColumn("same", F.coalesce(F.col("kind") == F.col("before"), F.lit(False)))
