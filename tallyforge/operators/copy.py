"""Listing copy: sentences against phrase rules, inherited notes and what contradicts them, photo counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

#: What ends a sentence.
ENDS = r"(?<=[.!?])\s+|\n+"


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ENDS), F.trim), lambda s: s != "")


def _label(s: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(s.rlike(f"(?i){pattern}"), F.lit(label)).otherwise(out)
    return out


def lint_copy(docs: DataFrame, fields: list[str], block: list[tuple[str, str]], warn: list[tuple[str, str]], exempt: list[str], end: str = "=== END") -> DataFrame:
    """(doc_id, field, level, snippet, why): sentences of docs' fields that a rule (pattern, why) meets.

    Text after `end` is not read. A sentence that an exempt pattern meets has no
    finding; else the first block rule that meets it counts, or the first warn
    rule. snippet: its first 90 characters; a field has each snippet once.
    """
    each = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.substring_index(F.col(f), end, 1).alias("t")) for f in fields])).alias("x"))
    s = each.select("doc_id", "x.field", F.explode(sentences(F.col("x.t"))).alias("s"))
    free = F.lit(False)
    for p in exempt:
        free = free | F.col("s").rlike(f"(?i){p}")
    s = s.where(~free).withColumns({"b": _label(F.col("s"), block), "w": _label(F.col("s"), warn)}).where("b is not null or w is not null")
    f = s.select("doc_id", "field", F.when(F.col("b").isNotNull(), "BLOCK").otherwise("WARN").alias("level"), F.substring("s", 1, 90).alias("snippet"), F.coalesce("b", "w").alias("why"))
    return f.groupBy("doc_id", "field", "snippet").agg(F.min(F.struct("level", "why")).alias("r")).select("doc_id", "field", "r.level", "snippet", "r.why")


@udtf(returnType=T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("sentence", T.StringType())]))
class ExplodeSentences:
    """SQL table function: the sentences of a text with their places."""

    def eval(self, text: str):
        import re

        for i, s in enumerate(x for x in (y.strip() for y in re.split(ENDS, text or "")) if x):
            yield i, s


def inherited_notes(items: DataFrame, notes: DataFrame, path: str) -> DataFrame:
    """(item, key, value): for each item and note key the value of the deepest folder of its path that has the key.

    items: item and path; notes: bucket, key, value. Prefixes are joined by equality.
    """
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    d = items.select("item", F.explode(up).alias("bucket")).join(notes, "bucket")
    return d.groupBy("item", "key").agg(F.max_by("value", F.struct(F.length("bucket"), F.col("value"))).alias("value"))


def contradictions(docs: DataFrame, context: DataFrame, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(item, rule, phrase, line): documents that use a phrase which a note above them forbids, with the first such phrase and its line.

    context: item, text of all notes above; rules: name, trigger, forbidden
    phrases. A rule's own phrases are taken out of the note before its trigger is
    looked for, so 'smoke-free' does not trigger 'smoke'.
    """
    j = docs.join(context.withColumnRenamed("text", "note"), "item")
    found = []
    for name, trigger, phrases in rules:
        left = F.lower("note")
        for p in sorted(phrases, key=len, reverse=True):
            left = F.replace(left, F.lit(p.lower()), F.lit(" "))
        lines = F.split(F.lower("text"), "\n")
        use = lambda line, phrases=phrases: F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(line, F.lower(p)))
        first = F.get(F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.get(use(x), F.lit(0)).alias("phrase"))), lambda x: x["phrase"].isNotNull()), F.lit(0))
        found.append(F.when(left.contains(trigger.lower()), F.struct(F.lit(name).alias("rule"), first["phrase"].alias("phrase"), first["line"].alias("line"))))
    d = j.select("item", F.explode(F.array_compact(F.array(*found))).alias("f")).where("f.phrase is not null")
    return d.select("item", "f.rule", "f.phrase", "f.line").distinct()


def photo_study(listings: DataFrame, photos: str = "photos") -> DataFrame:
    """One row: n, mean, median, most (the most common count, the least of equals), at_least_12, exactly_24."""
    c = F.col(photos)
    per = listings.groupBy(c.alias("c")).agg(F.count("*").alias("k"))
    mode = per.agg(F.max_by("c", F.struct("k", -F.col("c"))).alias("most"))
    return listings.agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.count_if(c >= 12).alias("at_least_12"), F.count_if(c == 24).alias("exactly_24")).join(F.broadcast(mode))
