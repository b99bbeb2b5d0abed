"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, small_side, stored

#: Shares and means are whole numbers of this unit, so sketches, limits and verdicts are the same in every run.
UNIT = 1 << 20
#: Leading binary digits of a value that its bucket keeps: a quantile is at most 1 / 128 of itself too high.
DIGITS = 8
#: A group of fewer documents takes its language's limit, a language of fewer the whole corpus's.
LEAST_GROUP = 200
#: Quantiles (in thousandths) that make a limit: LOW and MIDDLE where they differ, else HIGH.
LOW, MIDDLE, HIGH = 50, 500, 995
#: The limit lies REACH times as far above the middle as LOW lies below it.
REACH = 4
MEASURES = ["symbol_share", "dup_line_share", "repeat_share", "mean_word"]


def base_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang, source, n_lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts; null: zeros."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col("lang").alias("lang"), F.col("source").alias("source"), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id",
        "lang",
        "source",
        F.filter(F.split("t", SPACE + "+"), lambda w: w != "").alias("words"),
        F.char_length(F.regexp_replace("t", SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    d = d.withColumns({"n": F.size("words"), "h": F.transform("words", lambda w: F.xxhash64(w))})
    rest = [c for c in d.columns if c not in ("words", "h")]
    # Windows of three words in order of their hash: equal ones are neighbours.
    window = F.transform(F.slice("h", 1, F.greatest(F.col("n") - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)).alias("g"), i.alias("p")))
    d = d.select(*rest, F.sort_array(window).alias("s"))
    g = "transform(s, x -> x.g)"
    d = d.select(*rest, "s", F.expr(f"concat(array(cast(null as bigint)), {g})").alias("before"), F.expr(f"concat(slice({g}, 2, greatest(size(s) - 1, 0)), array(cast(null as bigint)))").alias("after"))
    twice = "transform(arrays_zip(s, before, after), z -> if(z.s.g <=> z.before or z.s.g <=> z.after, z.s.p, null))"
    d = d.select(*rest, F.expr(f"sort_array(filter({twice}, p -> p is not null))").alias("p"))
    # Each place covers three words, fewer if the next place is nearer.
    d = d.select(*rest, "p", F.expr("concat(slice(p, 2, greatest(size(p) - 1, 0)), array(2147483647))").alias("next"))
    covered = "aggregate(zip_with(p, next, (a, b) -> if(a is null, 0, least(3, b - a))), 0L, (x, y) -> x + y)"
    return d.select("doc_id", "lang", "source", "n_lines", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_measures(d: DataFrame) -> DataFrame:
    """d with the MEASURES, in UNITs."""
    share = lambda a, b: F.expr(f"{a} * {UNIT}L div greatest({b}, 1L)")
    return d.withColumns({"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "mean_word": share("word_chars", "n_words")})


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, measure, v, n): one quantile sketch for each measure of each pair of lang and source.

    A sketch counts values by bucket; v is a bucket's highest value, the value
    with all binary digits after the first DIGITS set. It has at most 2 ** DIGITS
    buckets for each doubling, whatever the number of documents, and sketches
    merge by adding counts, in any order and with the same result. Counts are
    added up inside tasks before the shuffle.
    """
    bucket = lambda m: F.expr(f"{m} | (shiftleft(1L, greatest(length(bin({m})) - {DIGITS}, 0)) - 1L)")
    each = measures.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(m).alias("v")) for m in MEASURES])).alias("x"))
    return each.groupBy("lang", "source", "x.measure", "x.v").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """(lang, source, limit_<measure>...): one row for each pair of lang and source; a null limit lets everything pass.

    A sketch gives the limit MIDDLE + REACH * (MIDDLE - LOW) of its quantiles:
    the lower half is what junk does not reach, and a group that spreads more
    gets more room. Where at least half of a group share one value (no repeated
    line, say), so that LOW and MIDDLE are equal, it is the quantile HIGH. Where
    that is equal too, the group has no spread and no limit of its own. Sketches
    are merged into those of languages and of the corpus; a group that is small
    or without spread takes the limit of the next level that is neither (the
    corpus at any size).
    """
    pair = sketch.withColumn("level", F.lit(0))
    lang = sketch.groupBy("lang", "measure", "v").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("source"), "measure", "v", "n", F.lit(1).alias("level"))
    corpus = sketch.groupBy("measure", "v").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "measure", "v", "n", F.lit(2).alias("level"))
    every = pair.unionByName(lang).unionByName(corpus)
    # One row for each bucket of a sketch: these windows see no documents.
    of = Window.partitionBy("level", "lang", "source", "measure")
    every = every.withColumns({"upto": F.sum("n").over(of.orderBy("v")), "total": F.sum("n").over(of)})
    at = lambda p: F.min(F.when(F.col("upto") * 1000 >= F.col("total") * p, F.col("v")))
    q = every.groupBy("level", "lang", "source", "measure").agg(F.max("total").alias("total"), at(LOW).alias("low"), at(MIDDLE).alias("middle"), at(HIGH).alias("high"))
    limit = F.when(F.col("middle") > F.col("low"), F.col("middle") + REACH * (F.col("middle") - F.col("low"))).when(F.col("high") > F.col("middle"), F.col("high"))
    q = q.withColumn("limit", F.when((F.col("total") >= least_group) | (F.col("level") == 2), limit))
    wide = lambda level, *by: q.where(F.col("level") == level).groupBy(*by).agg(*[F.max(F.when(F.col("measure") == m, F.col("limit"))).alias(f"l{level}_{m}") for m in MEASURES])
    langs, whole = wide(1, "lang").withColumnRenamed("lang", "of_lang"), wide(2)
    out = wide(0, "lang", "source").join(langs, F.col("lang").eqNullSafe(F.col("of_lang")), "left").join(F.broadcast(whole))  # one row
    return out.select("lang", "source", *[F.coalesce(f"l0_{m}", f"l1_{m}", f"l2_{m}").alias(f"limit_{m}") for m in MEASURES])


def judge(docs: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """One row for each row of docs: doc_id, lang, source, the measures, base_failed, reasons, kept.

    A document that fails no base rule is kept unless one of its measures lies
    above the adaptive limit of its language and source; reasons names those.
    Limits are made from all documents that fail no base rule. Null texts have no
    words and so fail; null langs and sources form groups of their own; doc_ids
    may be of any type, null or repeat.
    """
    d = with_measures(base_measures(docs)).withColumn("base_failed", base_failed())
    d = stored(d, "measures")
    t = stored(thresholds(stored(sketches(d.where("not base_failed")), "sketches"), least_group), "limits").withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    j = d.join(small_side(t), F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    reasons = F.array_compact(F.array(*[F.when(~F.col("base_failed") & (F.col(m) > F.col(f"limit_{m}")), F.lit(m)) for m in MEASURES]))
    return j.select(*d.columns, reasons.alias("reasons")).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
