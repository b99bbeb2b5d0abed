"""Asks of a session: what a prompt set off, its stage, loops, repeats and hot spots; thresholds of a score and agreement by band."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one ask that make it a long loop, times a call is repeated to be friction, seconds of an ask that count for its stage.
LOOP_TURNS, REPEATS, MOST_SECONDS = 25, 3, 3_600
HOT_SPOTS = 5


def keyword_hits(text: Column, words: list[str]) -> Column:
    """How often the words stand in text, small letters, overlaps of different words counted each."""
    low = F.lower(F.coalesce(text, F.lit("")))
    one = lambda w: ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int")
    return reduce(lambda a, b: a + b, map(one, words))


def asks(turns: DataFrame, stages: dict[str, list[str]], is_prompt: Column, key: str = "session", ts: str = "ts", order: str = "event_id", text: str = "text", tokens: str = "tokens") -> DataFrame:
    """(session, segment, turns, seconds, tokens, stage, long_loop) of every ask: a prompt and the turns up to the next one.

    What comes before the first prompt is segment 0. stage: the one whose keywords
    are hit most often in all texts of the ask, the first of equals, OTHER for none.
    Hits are summed, so no ask's text is put together.
    """
    w = Window.partitionBy(key).orderBy(ts, order)
    d = turns.withColumn("_prompt", is_prompt).withColumn("segment", F.sum(F.col("_prompt").cast("int")).over(w))
    names = list(stages)
    hits = [F.sum(keyword_hits(F.col(text), stages[n])).alias(f"_h{i}") for i, n in enumerate(names)]
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    g = d.groupBy(key, "segment").agg(F.count_if(~F.col("_prompt")).alias("turns"), (F.max(at) - F.min(at)).alias("seconds"), F.sum(tokens).alias("tokens"), *hits)
    most = F.greatest(*[F.col(f"_h{i}") for i in range(len(names))], F.lit(0))
    stage = reduce(lambda c, i: c.when(F.col(f"_h{i}") == most, F.lit(names[i])), range(len(names)), F.when(most == 0, F.lit("OTHER")))
    return g.select(key, "segment", "turns", "seconds", "tokens", stage.alias("stage"), (F.col("turns") >= LOOP_TURNS).alias("long_loop"))


def by_stage(found: DataFrame, key: str = "session") -> DataFrame:
    """(session, stage, asks, turns, seconds, tokens); an ask counts MOST_SECONDS at most."""
    return found.groupBy(key, "stage").agg(F.count("*").alias("asks"), F.sum("turns").alias("turns"), F.sum(F.least("seconds", F.lit(MOST_SECONDS))).alias("seconds"), F.sum("tokens").alias("tokens"))


def hot_spots(found: DataFrame, key: str = "session", most: int = HOT_SPOTS) -> DataFrame:
    """The asks of a session with the most turns, `most` of them, the earlier of equals first."""
    w = Window.partitionBy(key).orderBy(F.desc("turns"), "segment")
    return found.where("turns > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def friction(found: DataFrame, calls: DataFrame, key: str = "session", signature: str = "signature") -> DataFrame:
    """(session, kind, detail, times): long loops by segment, and calls of one signature REPEATS times or more."""
    loops = found.where("long_loop").select(key, F.lit("long_loop").alias("kind"), F.col("segment").cast("string").alias("detail"), F.col("turns").alias("times"))
    again = calls.where(F.col(signature).isNotNull()).groupBy(key, signature).agg(F.count("*").alias("times")).where(F.col("times") >= REPEATS)
    return loops.unionByName(again.select(key, F.lit("repeat").alias("kind"), F.col(signature).alias("detail"), "times"))


def runs(events: DataFrame, value: str, key: str = "session", ts: str = "ts", order: str = "event_id", least: int = 2) -> DataFrame:
    """(session, value, first, last, length) of runs of one value over a session's events, of `least` or more: gaps and islands."""
    w = Window.partitionBy(key).orderBy(ts, order)
    d = events.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    d = d.withColumn("_run", F.sum("_new").over(w))
    g = d.groupBy(key, "_run", value).agg(F.min(F.struct(ts, order))[order].alias("first"), F.max(F.struct(ts, order))[order].alias("last"), F.count("*").alias("length"))
    return g.where(F.col("length") >= least).drop("_run")


def _bucketed(labelled: DataFrame, score: str, label: str, edges: list[float]) -> DataFrame:
    """(bucket, n, right): rows at or over edges[bucket - 1] and under edges[bucket]; null and NaN scores are in none."""
    splits = [-float("inf"), *sorted(set(edges)), float("inf")]
    d = labelled.select(F.col(score).cast("double").alias("s"), (F.col(label) == 1).alias("right")).where("s is not null and not isnan(s)")
    b = Bucketizer(splits=splits, inputCol="s", outputCol="bucket").transform(d)  # binary search in the JVM
    return b.groupBy(F.col("bucket").cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.count_if("right").alias("right"))


def threshold_sweep(labelled: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """(threshold, kept, kept_share, right_kept, wrong_kept, agree) for each of any number of thresholds.

    Rows are counted once into the buckets between thresholds; sums from the top
    over the buckets answer all of them. Shares are of all rows with a score, agree of those kept.
    """
    edges = sorted({float(t) for t in thresholds})
    spark = labelled.sparkSession
    h = _bucketed(labelled, score, label, edges)
    at = spark.createDataFrame([(i + 1, t) for i, t in enumerate(edges)], "bucket int, threshold double")
    down = Window.orderBy(F.desc("bucket"))  # as many rows as thresholds
    s = at.join(h, "bucket", "full").select("threshold", F.sum(F.coalesce("n", F.lit(0))).over(down).alias("kept"), F.sum(F.coalesce("right", F.lit(0))).over(down).alias("right_kept"), F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy()).alias("all"))
    return s.where("threshold is not null").select("threshold", "kept", (F.col("kept") / F.nullif("all", F.lit(0))).alias("kept_share"), "right_kept", (F.col("kept") - F.col("right_kept")).alias("wrong_kept"), (F.col("right_kept") / F.nullif("kept", F.lit(0))).alias("agree"))


def agreement_by_band(labelled: DataFrame, score: str, label: str, edges: list[float]) -> DataFrame:
    """(low, high, n, agree) of the bands between neighbouring edges that hold a row; the upper edge is outside."""
    ordered = sorted({float(e) for e in edges})
    at = labelled.sparkSession.createDataFrame([(i + 1, lo, hi) for i, (lo, hi) in enumerate(zip(ordered, ordered[1:], strict=False))], "bucket int, low double, high double")
    return at.join(_bucketed(labelled, score, label, ordered), "bucket").select("low", "high", "n", (F.col("right") / F.col("n")).alias("agree"))
