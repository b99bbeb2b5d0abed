"""Quality classifier: per-document perplexity under a Kneser-Ney model of trusted text, cut at language quantiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charlm import TABLE_ROWS, count_keys, probabilities, score_documents
from .common import small_side, stored

#: Characters at the language's mean that are added to each document, so that a few words decide nothing.
PRIOR_CHARS = 50.0
#: Quantile of the trusted documents' entropies at which a language is cut, and the room above it.
QUANTILE = 0.995
ROOM = 1.05
#: A language with fewer trusted documents is cut by the quantile over all trusted documents.
LEAST_TRUSTED = 100


def _entropy(values: np.ndarray, own: np.ndarray, codes: np.ndarray, n: int) -> dict[str, np.ndarray]:
    return {"nll": np.bincount(own, values, n), "chars": np.bincount(own, minlength=n).astype(float)}


def classify(docs: DataFrame, trusted: DataFrame, table_rows: int = TABLE_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, lang, n_chars, perplexity (a character), limit, trusted, kept.

    trusted: the doc_ids (doc_id) of trusted text; a doc_id that repeats counts
    once, a null one not at all. kept: the smoothed perplexity is at most the
    limit, QUANTILE of the trusted documents of the language times ROOM. A null
    or empty text has the language's mean and is kept; a null lang is a language
    of its own. Without trusted text all is kept and limit is null. doc_ids may
    be null or repeat, other columns are not looked at.
    """
    d = docs.select("doc_id", "lang", "text")
    marks = trusted.where("doc_id is not null").select("doc_id", F.lit(True).alias("trusted")).distinct()
    d = d.join(small_side(marks), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    table = stored(count_keys(d, {"trusted": F.col("trusted")}), "counts")
    p = probabilities(table, ["c_trusted"]).select("key", (-F.log2("p_c_trusted")).alias("value"))
    s = stored(score_documents(d, p, _entropy, ["nll", "chars"], ["doc_id", "lang", "trusted"], table_rows), "entropies")
    mean = s.groupBy("lang").agg((F.sum("nll") / F.greatest(F.sum("chars"), F.lit(1.0))).alias("mean")).withColumnRenamed("lang", "_l")
    s = s.join(mean, F.col("lang").eqNullSafe(F.col("_l"))).drop("_l")
    s = s.withColumn("bits", (F.col("nll") + PRIOR_CHARS * F.col("mean")) / (F.col("chars") + PRIOR_CHARS))
    s = stored(s, "smoothed")
    known = s.where("trusted")
    per = known.groupBy("lang").agg(F.percentile_approx("bits", QUANTILE, 10000).alias("cut"), F.count("*").alias("n"))
    overall = known.agg(F.percentile_approx("bits", QUANTILE, 10000).alias("all"))
    per = per.where(F.col("n") >= LEAST_TRUSTED).select(F.col("lang").alias("_l"), "cut")
    s = s.join(F.broadcast(overall)).join(per, F.col("lang").eqNullSafe(F.col("_l")), "left")  # overall: one row
    limit = F.coalesce("cut", "all") * ROOM
    kept = (F.col("chars") == 0) | F.coalesce(F.col("bits") <= limit, F.lit(True))
    return s.select("doc_id", "lang", F.col("chars").cast("long").alias("n_chars"), F.pow(2.0, "bits").alias("perplexity"), F.pow(F.lit(2.0), limit).alias("limit"), "trusted", kept.alias("kept"))
