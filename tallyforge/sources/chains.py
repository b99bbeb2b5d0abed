"""Change logs as files: one event on a line, in canonical JSON (keys in order, no spaces)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chains import numbered

EVENT = "seq long, key string, kind string, fields array<string>, add array<map<string,string>>, remove array<map<string,string>>, state string, prev string, hash string"


def read_chains(spark: SparkSession, path: str, suffix: str = ".events.jsonl") -> DataFrame:
    """Events of all chain files under path as operators.chains.verify takes them; chain is the file's name without suffix.

    Lines are numbered by their block and their place in it, so a large file
    may be read in parts. A line that is no event has a null hash.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.select(F.regexp_replace("file", suffix.replace(".", r"\.") + "$", "").alias("chain"), F.struct("block", F.monotonically_increasing_id().alias("i")).alias("at"), "value", F.from_json("value", EVENT).alias("e"))
    rows = lambda c: F.transform(F.coalesce(c, F.array().cast("array<map<string,string>>")), lambda r: F.to_json(r))
    d = lines.select("chain", "at", "e.seq", "e.key", "e.kind", F.coalesce("e.fields", F.array().cast("array<string>")).alias("fields"), rows(F.col("e.add")).alias("add"), rows(F.col("e.remove")).alias("remove"), "e.state", "e.prev", "e.hash", F.replace("value", F.concat(F.lit('"hash":"'), F.col("e.hash"), F.lit('",')), F.lit("")).alias("body"))
    return numbered(d).drop("at")
