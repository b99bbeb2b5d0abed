"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .charlm import ORDER, TABLE_ROWS, count_keys, probabilities, score_documents
from .common import small_side, stored, text_hash

#: Orders up to this are shared by both classes and counted over all documents.
SHARED = 2
#: Share of a toxic text's words that are taken to be toxic themselves.
TOXIC_SHARE = 0.01
#: At most so many labelled rows fit the weights of the two evidences, the first by a hash of their id and text.
FIT_ROWS = 20_000
CUT = 0.7
NAMES = ["ratio", "evidence", "chars", "words"]


def _likelihoods(values: np.ndarray, own: np.ndarray, codes: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """For each text: sum of log ratios, and the evidence that some of its words are toxic, by a mixture over words."""
    gap = (codes == 32) | (codes == 10) | (codes == 9) | (codes == 13)
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (gap[1:] & ~gap[:-1])
    at = np.flatnonzero(new)
    word = np.minimum(np.add.reduceat(values, at).astype(float), 40.0) if len(at) else np.zeros(0)
    evidence = np.log1p(TOXIC_SHARE * np.expm1(word))
    return {
        "ratio": np.bincount(own, values, n),
        "evidence": np.bincount(own[at], evidence, n),
        "chars": np.bincount(own, minlength=n).astype(float),
        "words": np.bincount(own[at], minlength=n).astype(float),
    }


def held_out(doc_id: Column | str) -> Column:
    """Rows no label is learned from: crc32 of the id as text leaves 1 modulo 3, or the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def _features() -> list[Column]:
    """Evidence and log ratio per character, each held to a range in which more decides nothing."""
    n = F.greatest(F.col("chars"), F.lit(1.0))
    held = lambda c, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), c))
    return [held(F.col("evidence"), -10.0, 30.0) / 10, held(10 * F.col("ratio") / n, -5.0, 5.0) / 5]


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression, ridge 0.01, by Newton steps that are halved until the loss falls: weights and intercept.

    Fixed values if there are fewer than 20 rows or one class only.
    """
    if len(y) < 20 or y.min() == y.max():
        return np.array([6.0, 1.0, -3.0])
    a, ridge = np.column_stack([x, np.ones(len(x))]), np.array([0.01, 0.01, 0.0])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(ridge * w * w))

    w = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9), grad)
        scale = 1.0
        while scale > 1e-6 and loss(w - scale * step) > loss(w):
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-7:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, table_rows: int = TABLE_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, the evidences it comes from, and tid (a hash of the text).

    labels: doc_id, toxic (0 or 1); a doc_id with several labels is toxic if one
    says so; null ids and labels teach nothing. The class models learn from all
    labels that may be learned from. The weights of the two evidences come from
    texts the models have not seen: the labelled rows are parted in two by the
    remainder of their id's crc32, each part is scored by models of the other,
    and the weights fit both. Without both classes there are fixed weights.
    Backoff counts are over all documents. Null and empty texts have no evidence:
    the score of an empty text. doc_ids may be of any type, null or repeat; a
    score follows from the text alone. Other columns are not looked at.
    """
    d = docs.select("doc_id", "text")
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = (F.crc32(F.col("doc_id").cast("string")) % 3).alias("part")
    marks = small_side(stored(marks.where(~held_out("doc_id")).select("doc_id", "toxic", part), "marks"))
    marked = d.join(marks, "doc_id", "left")
    classes = {f"{c}{i}": (F.col("toxic") == y) & (F.col("part") == i) for c, y in (("toxic", 1), ("plain", 0)) for i in (0, 2)}
    table = count_keys(marked, classes).withColumns({f"c_{c}": F.col(f"c_{c}0") + F.col(f"c_{c}2") for c in ("toxic", "plain")})
    table = stored(table, "counts")
    shared = probabilities(table, ["c_all"], top=SHARED).select("key", F.col("p_c_all").alias("p"))
    models = ["", "0", "2"]  # of both parts, and of each alone
    p = probabilities(table, [f"c_{c}{m}" for m in models for c in ("toxic", "plain")], base=shared, above=SHARED)
    ratios = stored(p.select("key", *[(F.log(f"p_c_toxic{m}") - F.log(f"p_c_plain{m}")).alias(f"r{m}") for m in models]), "ratios")

    # The rows that fit the weights: those of the FIT_ROWS least hashes, which alone go through one task.
    known = d.join(marks, "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    last = known.select("h").orderBy("h").limit(FIT_ROWS).agg(F.max("h")).first()[0]
    known = known.where(F.col("h") <= F.lit(last).cast("long"))
    f = [c.alias(f"f{i}") for i, c in enumerate(_features())]
    fit = []
    for mine, other in ((0, "2"), (2, "0")):
        seen = score_documents(known.where(F.col("part") == mine), ratios.select("key", F.col(f"r{other}").alias("value")), _likelihoods, NAMES, ["doc_id", "toxic"], table_rows)
        fit.append(stored(seen.select(*f, "toxic"), "evidences").toPandas())
    fit = pd.concat(fit).sort_values(["f0", "f1", "toxic"])
    w = _fit(fit[["f0", "f1"]].to_numpy(float), fit["toxic"].to_numpy(float))
    z = F.lit(float(w[2]))
    for i, c in enumerate(_features()):
        z = z + float(w[i]) * c
    # Stored, so that whole texts go to Python in small batches whoever reads the result.
    s = stored(score_documents(d.withColumn("tid", text_hash()), ratios.select("key", F.col("r").alias("value")), _likelihoods, NAMES, ["doc_id", "tid"], table_rows), "likelihoods")
    s = s.withColumn("score", 1 / (1 + F.exp(-z)))
    return s.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), *NAMES, "tid")
