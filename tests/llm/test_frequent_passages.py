"""Suffixes of frequent prefixes are reduced inside batches before they are grouped."""

from pyspark.sql import functions as F

from tallyforge.llm import suffix_dedup
from tallyforge.llm.common import named


def test_windows_of_many_texts_become_few_rows(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{'a b c ' * (i % 3)}own{i} {passage} end{i}") for i in range(40)] + [(99, " ".join(f"x{i}" for i in range(80)))]
    docs = named(spark.createDataFrame(rows, "doc_id long, text string"))
    plans, whole = [], suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name, **more: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or whole(df, name, **more))

    def places(**options):
        found = suffix_dedup.repeated_windows(docs, **options)
        each = found.select("uid", "tid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at"), "first", "kept", "own")
        return sorted(tuple(r) for r in each.collect())

    plain = places()
    assert plain == places(hot_rows=5) == places(hot_rows=5, lookup_rows=0) and len(plain) == 40 * 11
    assert not any("posexplode" in p for name, p in plans if name == "least")
