"""What listing texts say and lack: slots of words in titles, sections of bodies, lengths that a listing must state, lots that items name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns that results depend on.
SECTION_LABEL = r"(?m)^\s*[*•\-]?\s*([A-Za-z][A-Za-z'&/ ]{2,24}?)\s*:"
LENGTH_NOUN = r"(?i)\b(necklaces?|bracelets?|bangles?|anklets?|chokers?|lariats?|chains?)\b"
CHAIN_JEWELRY = r"(?i)\b(?:gold|silver|sterling|\d{1,2}k|14k|10k|18k|925|platinum|rope|curb|cable|box|snake|figaro|herringbone|pendant|necklace|jewel(?:ry)?|vintage|costume)\b"
NOT_PHRASE = (
    r"(?i)\b(?:napkin|curtain|shower|key|piston|o|split|drawer|door|teething|onion)[- ]?rings?\b|\bring binders?\b|\bchain ?saws?\b"
    r"|\b(?:bowling|rolling|clothes|safety|cotter) pins?\b|\bpendant (?:lights?|lamps?|fixtures?)\b"
)
NOT_JEWELRY = (
    r"(?i)\b(?:pliers?|mugs?|cups?|glass(?:es|ware)?|tumblers?|steins?|bowls?|plates?|tools?|hardware|curtains?|napkins?|keys?|hooks?|dish(?:es)?|trays?"
    r"|binders?|toys?|games?)\b"
)
STRONG = r"(?i)\b(?:jewel(?:ry|lery|s)?|necklaces?|pendants?|bracelets?|bangles?|earrings?|brooch(?:es)?|cuff ?links?|lockets?|anklets?|chokers?|tiaras?|watch fobs?)\b"
WEAK = r"(?i)\b(?:rings?|chains?|pins?|charms?)\b"
LENGTH_VALUE = r"(?i)\d+(?:\.\d+)?(?:\s*/\s*\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?\s*(?:in(?:ch(?:es)?)?\b|\"|”|mm\b|cm\b)"
LENGTH_LINE = r"(?i)length|long\b|circumference|wrist|drop|inch"
SIZE_UNIT, WEIGHT_UNIT = r"(?:in(?:ch(?:es)?)?|\"|mm|cm)", r"(?:g|gr|gram|grams|dwt|oz|ozt|lb|lbs)"
NUMBER = r"\d+(?:\.\d+)?(?:\s*/\s*\d+)?"
RING_SIZE = r"(?i)(?:US\s*)?size\s*\d+(?:\.\d+)?(?:\s*1/2)?"
GUESSED = r"(?i)[~≈]|estimat|approx|unknown|\bask\b|tbd|\?|\bn/?a\b|\bor\b|\d\s*[–-]\s*\d"
#: Millimetres and grams of a unit.
MILLIMETRES = {"mm": 1.0, "cm": 10.0, "in": 25.4, "inch": 25.4, "inches": 25.4, '"': 25.4}
GRAMS = {"g": 1.0, "gr": 1.0, "gram": 1.0, "grams": 1.0, "dwt": 1.55517384, "ozt": 31.1034768, "oz": 28.349523125, "lb": 453.59237, "lbs": 453.59237}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def slots(listings: DataFrame, vocabularies: dict[str, list[str]], title: str = "title") -> DataFrame:
    """(class, n, titles, mean_slot, coverage): where the first word of each vocabulary stands in titles, counted from 0, and what share of titles has one."""
    words = F.transform(F.filter(F.split(F.trim(F.col(title)), r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(F.lower(w), r"[^a-z\-']", ""))
    d = listings.where(_text(title) != "").select(words.alias("w"))
    first = lambda names: F.array_min(F.transform(F.array(*map(F.lit, names)), lambda v: F.nullif(F.array_position("w", v), F.lit(0).cast("long")))) - 1
    found = F.array(*[F.struct(F.lit(c).alias("class"), first(v).alias("slot")) for c, v in vocabularies.items()])
    each = d.select(F.explode(found).alias("f"))
    g = each.groupBy("f.class").agg(F.count("f.slot").alias("n"), F.count("*").alias("titles"), F.avg("f.slot").alias("mean_slot"))
    return g.withColumn("coverage", F.col("n") / F.col("titles"))


def skeleton(listings: DataFrame, body: str = "body", most: int = 12) -> DataFrame:
    """(label, n, share, mean_order) of the `most` commonest section labels of bodies, by their mean order.

    A label is what stands before a colon at the start of a line; each counts once in a body,
    at its first place among the body's labels. Share is of all bodies that are not empty.
    """
    d = listings.where(_text(body) != "")
    labels = F.array_distinct(F.transform(F.regexp_extract_all(F.col(body), F.lit(SECTION_LABEL), F.lit(1)), lambda x: F.upper(F.trim(x))))
    g = d.select(F.posexplode(labels).alias("order", "label")).groupBy("label").agg(F.count("*").alias("n"), F.avg("order").alias("mean_order"))
    top = g.orderBy(F.desc("n"), "label").limit(most)
    return top.crossJoin(F.broadcast(d.agg(F.count("*").alias("all")))).select("label", "n", (F.col("n") / F.col("all")).alias("share"), "mean_order").orderBy("mean_order", "label")


def is_jewelry(category: Column) -> Column:
    """Whether a category names jewelry: a strong word, or a weak one (ring, chain, pin, charm) with no household thing beside it."""
    c = F.regexp_replace(F.coalesce(category, F.lit("")), NOT_PHRASE, " ")
    return c.rlike(STRONG) | (c.rlike(WEAK) & ~c.rlike(NOT_JEWELRY))


def measured(value: Column, unit: str) -> Column:
    """Whether value is a number with a unit and no guess; of sizes, a ring size too."""
    v = F.coalesce(value, F.lit(""))
    real = v.rlike(rf"(?i){NUMBER}\s*(?:x|×)?\s*{unit}\b|{NUMBER}\s*{unit}(?![a-z])")
    return (v != "") & ~v.rlike(GUESSED) & ((v.rlike(RING_SIZE) | real) if unit == SIZE_UNIT else real)


def quantity(value: Column, unit: str) -> Column:
    """The first number of value that has a unit, in millimetres or grams; 1/2 and 7 1/2 are read as they are meant; null without one."""
    pattern = rf"(?i)((?:\d+\s+)?\d+\s*/\s*\d+|\d+(?:\.\d+)?)\s*({unit})(?![a-z])"
    n, u = F.regexp_extract(value, pattern, 1), F.lower(F.regexp_extract(value, pattern, 2))
    whole, top, low = (F.regexp_extract(n, r"^(?:(\d+)\s+)?(\d+)\s*/\s*(\d+)$", i) for i in (1, 2, 3))
    broken = F.coalesce(F.nullif(whole, F.lit("")).cast("double"), F.lit(0.0)) + top.try_cast("double") / F.nullif(low.try_cast("double"), F.lit(0.0))
    scale = F.create_map(*[F.lit(x) for kv in (MILLIMETRES if unit == SIZE_UNIT else GRAMS).items() for x in kv])
    return F.when(u != "", F.round(F.when(top != "", broken).otherwise(n.try_cast("double")) * scale[u], 6))


def measure_problems(items: DataFrame) -> DataFrame:
    """(item, lacks) of jewelry whose size or weight is not measured; items: item, category, size, weight."""
    lacks = F.array_compact(F.array(F.when(~measured(F.col("size"), SIZE_UNIT), "size"), F.when(~measured(F.col("weight"), WEIGHT_UNIT), "weight")))
    return items.where(is_jewelry(F.col("category"))).select("item", F.explode(lacks).alias("lacks"))


def lacks_length(drafts: DataFrame) -> DataFrame:
    """(item) of necklaces, bracelets and the like that state no length; drafts: item, title, category, kind, specs (a map), body, override.

    A length stands in the title, in a specific named length or size, or in a line of the body about length.
    An override of any text lifts the rule. A bare chain needs a word of jewelry beside it.
    """
    text = F.regexp_replace(F.concat_ws(" ", _text("title"), _text("category"), _text("kind")), NOT_PHRASE, " ")
    nouns = F.transform(F.regexp_extract_all(text, F.lit(LENGTH_NOUN), F.lit(1)), lambda w: F.regexp_replace(F.lower(w), "s+$", ""))
    needs = (F.size(F.array_except(nouns, F.array(F.lit("chain")))) > 0) | (F.array_contains(nouns, "chain") & ~text.rlike(NOT_JEWELRY) & text.rlike(CHAIN_JEWELRY))
    specs = F.exists(F.coalesce(F.map_entries("specs"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: e["key"].rlike("(?i)length|size") & F.coalesce(e["value"], F.lit("")).rlike(LENGTH_VALUE))
    lines = F.exists(F.split(_text("body"), r"\n"), lambda s: s.rlike(LENGTH_LINE) & s.rlike(LENGTH_VALUE))
    return drafts.where((F.trim(_text("override")) == "") & needs & ~_text("title").rlike(LENGTH_VALUE) & ~specs & ~lines).select("item")


def lot_problems(items: DataFrame, folders: DataFrame, root: str) -> DataFrame:
    """(item, want, have, problem) of items whose lot cannot be trusted; items: item, path, drafted, lot; folders: folder, part_of, client.

    An item's lot is told by the folders above it, from the nearest: part_of names it, a client's
    folder is one, else it is the outermost. Items that are drafted, or outside root, are not checked.
    Folders join by equality with the prefixes of the path.
    """
    here = items.where(~F.coalesce("drafted", F.lit(False)) & (F.startswith("path", F.lit(root + "/")) | (F.col("path") == root)))
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    some = lambda c: F.nullif(F.trim(_text(c)), F.lit(""))
    depth = F.size(F.split("folder", "/"))
    f = folders.where((F.col("folder") == root) | F.startswith("folder", F.lit(root + "/"))).select("folder", depth.alias("depth"), F.coalesce(some("part_of"), F.when(some("client").isNotNull(), F.col("folder"))).alias("names"))
    g = here.select("item", F.explode(up).alias("folder")).join(f, "folder").groupBy("item").agg(F.max_by("names", F.when(F.col("names").isNotNull(), F.col("depth"))).alias("near"), F.min_by("folder", "depth").alias("outer"))
    j = here.join(g, "item", "left").select("item", F.coalesce("near", "outer").alias("want"), F.regexp_replace(some("lot"), "^/+|/+$", "").alias("have"))
    problem = F.when(F.col("want").isNull(), "no folder names its lot").when(F.col("have").isNull(), "no lot").when(F.col("have") != F.col("want"), "another lot")
    return j.withColumn("problem", problem).where("problem is not null")


def size_outliers(items: DataFrame, by: str, tolerance: float = 3.0) -> DataFrame:
    """(item, mm, middle) of items whose length is over `tolerance` times the middle of their kind, or under it by as much; items: item, by, size."""
    d = items.select("item", by, quantity(F.col("size"), SIZE_UNIT).alias("mm")).where("mm is not null")
    per = d.groupBy(by, "mm").agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    upto = per.withColumns({"upto": F.sum("c").over(w.orderBy("mm")), "all": F.sum("c").over(w)}).where("2 * upto >= all").groupBy(by).agg(F.min("mm").alias("middle"))
    return d.join(upto, by).where((F.col("mm") > tolerance * F.col("middle")) | (F.col("mm") * tolerance < F.col("middle"))).select("item", "mm", "middle")
