"""A corpus pipeline of five stages, each reading what the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from tallyforge.llm.common import free_name, row_number_of, scratch, small_side, stored, text_hash


def _names(df: DataFrame) -> list[Column]:
    """The two longs that name a row of df (doc_id, tid), as suffix_dedup has them: rows of one name have one id and one text."""
    return [row_number_of(df, F.col("tid")).alias("uid"), F.col("tid")]


def _with_names(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs and the two longs of each row, in columns whose names docs does not have."""
    u, t = free_name(docs, "uid"), free_name(docs, "tid")
    return docs.select("*", row_number_of(docs, text_hash()).alias(u), text_hash().alias(t)), u, t


def _without(docs: DataFrame, names: DataFrame) -> DataFrame:
    """docs without the rows that names (uid, tid) has."""
    d, u, t = _with_names(docs)
    gone = small_side(stored(names.select(F.col("uid").alias(free_name(d, "gone_uid")), F.col("tid").alias(free_name(d, "gone_tid"))).distinct(), "gone"))
    a, b = gone.columns
    return d.join(gone, (F.col(u) == F.col(a)) & (F.col(t) == F.col(b)), "left_anti").drop(u, t)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts toxic go, each row by its own text.

    A null or empty text has the score of no evidence and stays. An empty table
    gives an empty one.
    """
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 1").select(*_names(scored)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays: the first by doc_id, then by a hash of the text.

    Of equal rows that are first together, the one whose other columns hash least
    stays. Rows that share a doc_id but not their text are judged apart. Null and
    blank texts are in no class, so all of them stay. An empty table gives an
    empty one.
    """
    judged = jaccard_join.near_duplicates(docs)
    judged = stored(judged.select(*_names(judged), "first", "n_shingles"), "judged")
    kept = _without(docs, judged.where("not first"))
    again = stored(judged.where("first and n_shingles > 0").groupBy("uid", "tid").count().where("count > 1").select("uid", "tid"), "again")
    if again.isEmpty():
        return kept
    d, u, t = _with_names(docs)
    twice = again.select(F.col("uid").alias(free_name(d, "again_uid")), F.col("tid").alias(free_name(d, "again_tid")))
    a, b = twice.columns
    row = F.struct(*docs.columns)
    one = d.join(small_side(twice), (F.col(u) == F.col(a)) & (F.col(t) == F.col(b)), "left_semi").groupBy(u, t).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return _without(kept, again).unionByName(one.select("row.*"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay at their first place only; documents of which nothing is left go, null and blank texts stay."""
    return suffix_dedup.cut_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, each row by its own text; null and empty texts stay."""
    hits = decontaminate.contamination(docs.select(F.struct(row_number_of(docs, text_hash()).alias("uid"), text_hash().alias("tid")).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, hits.where("contaminated").select("doc_id.uid", "doc_id.tid"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences, buckets and batches of what is left; a null or empty text has no token and no sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, after all stages over the documents of sf_dir. What a stage wrote on its way is removed after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            docs = stored(result, f"stage-{name}", lasting=True)
    return docs


#: Classifiers, chosen paths and a tokenizer have no SQL; tests/llm holds run() against a plain chain of the same steps.
ORACLE_SQL = None
