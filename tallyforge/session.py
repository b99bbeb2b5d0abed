"""A session with the settings the library is written for."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tallyforge", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir, its lineage cut; where no folder is set, a local session gets one of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if base is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="tallyforge-"))
    return df.checkpoint()
