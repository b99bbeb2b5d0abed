"""Queries over listing texts made of the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing_text as T
from .views import table

# Words looked for, and texts that the parts are given.
VOCABULARIES = {"finish": ["polished", "plated", "burnished", "brushed", "anodized"], "metal": ["brass", "steel", "tin", "copper", "nickel"], "none": ["zzz"]}
TITLES = {
    "Gold necklace": True, "Sterling silver bracelets 7 in": False, "Napkin rings and a bangle": True, "Rope chain 14k": True, "Bike chain": False, "Chain saw": False, "Anklet 25cm": False, "Oak chair": False, "Choker, vintage": True, "Chain mug silver": False,
}
CATEGORIES = {"Fine Jewelry > Rings": True, "Napkin rings": False, "Pins": True, "Bowling pins": False, "Key rings, hardware": False, "Charm and dish": False, "Brooches": True, "Chairs": False}
SIZES = {"7 in": True, "about 7 in": True, "~18 mm": False, "size 7": True, "7": False, "1/2 inch": True, "20-24 in": False, "5.5cm": True, "unknown": False, "approx 3 in": False}
#: Sizes in millimetres, where one is read.
MM = {"7 in": 177.8, "about 7 in": 177.8, "~18 mm": 18.0, "1/2 inch": 12.7, "20-24 in": 609.6, "5.5cm": 55.0, "approx 3 in": 76.2}


def _pick(values, of):
    return F.element_at(F.array(*map(F.lit, values)), (of % len(values) + 1).cast("int"))


def _bodies(spark, d):
    k = F.col("p_partkey")
    lines = [F.concat(F.lit("Condition: "), "p_type"), F.concat(F.lit("  - Size : "), F.col("p_size").cast("string")), F.concat(F.lit("MAKER'S MARK: "), "p_brand"), F.lit("condition: again"), F.lit("no label here")]
    orders = [[0, 1, 2, 3], [2, 0, 4], [4], [1, 3, 2, 0], [3, 1]]
    body = F.element_at(F.array(*[F.concat_ws("\n", *[lines[i] for i in o]) for o in orders]), (k % 5 + 1).cast("int"))
    return table(spark, d, "part").select(k.alias("item"), F.concat_ws(" ", "p_name", F.initcap("p_type")).alias("title"), F.when(k % 17 != 0, body).alias("body"))


def a15_slots(spark, d):
    return T.slots(_bodies(spark, d), VOCABULARIES)


def a16_skeleton(spark, d):
    return T.skeleton(_bodies(spark, d))


def p7_lengths(spark, d):
    k = F.col("p_partkey")
    specs = F.when(k % 7 == 0, F.create_map(F.lit("Necklace length"), F.lit("18 in"))).when(k % 7 == 1, F.create_map(F.lit("colour"), F.lit("18 in")))
    drafts = table(spark, d, "part").select(k.alias("item"), _pick(list(TITLES), k).alias("title"), F.lit("x").alias("category"), F.lit(None).cast("string").alias("kind"), specs.alias("specs"), F.when(k % 11 == 0, "Fine.\nLength is 18 inches.").otherwise("It is long.\n18 in box.").alias("body"), F.when(k % 13 == 0, "told so").alias("override"))
    return T.lacks_length(drafts)


def p7_measures(spark, d):
    k = F.col("p_partkey")
    return T.measure_problems(table(spark, d, "part").select(k.alias("item"), _pick(list(CATEGORIES), k).alias("category"), _pick(list(SIZES), F.floor(k / 8)).alias("size"), F.when(k % 3 == 0, "12 g").when(k % 3 == 1, "12").alias("weight")))


def p7_sizes(spark, d):
    k = F.col("p_partkey")
    return T.size_outliers(table(spark, d, "part").select(k.alias("item"), F.col("p_brand").alias("kind"), _pick(list(SIZES), k).alias("size")), "kind")


def p7_lots(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    brand = F.concat(F.lit("inv/"), "p_brand")
    shelf = F.concat_ws("/", brand, F.col("p_size").cast("string"))
    items = p.select(k.alias("item"), F.when(k % 10 == 0, F.concat(F.lit("elsewhere/"), k.cast("string"))).otherwise(F.concat_ws("/", shelf, k.cast("string"))).alias("path"), (k % 9 == 0).alias("drafted"), F.when(k % 4 == 0, F.concat(brand, F.lit("/"))).when(k % 4 == 1, "estate").when(k % 4 == 2, shelf).alias("lot"))
    size = F.col("p_size")
    shelves = p.where(size % 3 != 0).select(shelf.alias("folder"), F.when(size % 3 == 1, "estate").alias("part_of"), F.when(size % 5 == 0, "a client").alias("client")).distinct()
    brands = p.where("p_brand not like '%1'").select(brand.alias("folder"), F.lit(None).cast("string").alias("part_of"), F.lit("").alias("client")).distinct()
    return T.lot_problems(items, shelves.unionByName(brands), "inv")


QUERIES = {"a15_slots": a15_slots, "a16_skeleton": a16_skeleton, "p7_lengths": p7_lengths, "p7_measures": p7_measures, "p7_sizes": p7_sizes, "p7_lots": p7_lots}


def _at(values, of: str) -> str:
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"[{', '.join(map(text, values))}][CAST(({of}) % {len(values)} + 1 AS INTEGER)]"


_SLOT = "SELECT '{c}' AS class, count(s) AS n, count(*) AS titles, avg(s) AS mean_slot, count(s) / count(*) AS coverage FROM (SELECT list_min(list_filter([list_position(w, v) - 1 FOR v IN [{v}]], lambda x: x >= 0)) AS s FROM t)"

ORACLE = {
    "a15_slots": "WITH t AS (SELECT list_transform(string_split(p_name || ' ' || lower(p_type), ' '), lambda x: regexp_replace(lower(x), '[^a-z\\-'']', '', 'g')) AS w FROM part) " + " UNION ALL ".join(_SLOT.format(c=c, v=", ".join(f"'{x}'" for x in v)) for c, v in VOCABULARIES.items()),
    # Labels by order of first use, as the orders of lines above have them; every body's own line counts once.
    "a16_skeleton": """WITH o(r, label, place) AS (VALUES (0, 'CONDITION', 0), (0, 'SIZE', 1), (0, 'MAKER''S MARK', 2), (1, 'MAKER''S MARK', 0), (1, 'CONDITION', 1), (3, 'SIZE', 0), (3, 'CONDITION', 1), (3, 'MAKER''S MARK', 2), (4, 'CONDITION', 0), (4, 'SIZE', 1)), p AS (SELECT p_partkey % 5 AS r FROM part WHERE p_partkey % 17 <> 0)
      SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM p) AS share, avg(place) AS mean_order FROM p JOIN o ON o.r = p.r GROUP BY 1""",
    "p7_lengths": f"SELECT p_partkey AS item FROM part WHERE {_at(list(TITLES.values()), 'p_partkey')} AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0",
    "p7_measures": f"SELECT p_partkey AS item, unnest(list_filter([CASE WHEN NOT {_at(list(SIZES.values()), 'p_partkey // 8')} THEN 'size' END, CASE WHEN p_partkey % 3 <> 0 THEN 'weight' END], lambda x: x IS NOT NULL)) AS lacks FROM part WHERE {_at(list(CATEGORIES.values()), 'p_partkey')}",
    "p7_sizes": f"WITH s AS (SELECT p_partkey AS item, p_brand AS kind, {_at([MM.get(x) for x in SIZES], 'p_partkey')}::DOUBLE AS mm FROM part), m AS (SELECT kind, quantile_disc(mm, 0.5) AS middle FROM s GROUP BY 1) SELECT item, mm, middle FROM s JOIN m USING (kind) WHERE mm > 3 * middle OR mm * 3 < middle",
    "p7_lots": """WITH i AS (SELECT p_partkey AS item, p_brand, p_size, 'inv/' || p_brand AS b, 'inv/' || p_brand || '/' || p_size AS s, CASE p_partkey % 4 WHEN 0 THEN 'inv/' || p_brand WHEN 1 THEN 'estate' WHEN 2 THEN 'inv/' || p_brand || '/' || p_size END AS have FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 9 <> 0),
      w AS (SELECT item, have, CASE WHEN p_size % 3 = 1 THEN 'estate' WHEN p_size % 3 = 2 AND p_size % 5 = 0 THEN s WHEN p_brand NOT LIKE '%1' THEN b WHEN p_size % 3 <> 0 THEN s END AS want FROM i)
      SELECT item, want, have, CASE WHEN want IS NULL THEN 'no folder names its lot' WHEN have IS NULL THEN 'no lot' ELSE 'another lot' END AS problem FROM w WHERE want IS NULL OR have IS NULL OR have <> want""",
}
