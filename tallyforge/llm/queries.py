"""Queries over the given tables, one for each operator, and the SQL that some can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, jaccard_join, license_scan, packing, perplexity, quality_rules, source_divergence, spelling_variants, suffix_dedup, token_counts, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return c.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", "n_near")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = suffix_dedup.repeats(_table(spark, sf_dir, "documents"))
    marked = lambda c, kept: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), s["first"].alias("first"), F.lit(kept).alias("kept")))
    r = r.select(F.col("uid").alias("doc_id"), F.explode(F.concat(marked("cut", False), marked("kept", True))).alias("s"))
    return r.select("doc_id", F.col("s.start").alias("start_word"), F.col("s.n").alias("n_words"), F.col("s.first").alias("first_doc_id"), F.col("s.kept").alias("kept"))


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return perplexity.classify(_table(spark, sf_dir, "documents"), trusted)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_shingles")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return s.select("doc_id", "held_out", "score", "predicted")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "reasons").alias("reasons"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(token_counts.with_token_counts(_table(spark, sf_dir, "documents"))))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(_table(spark, sf_dir, "documents"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_packing,
        op3_decontaminate,
        op4_suffix_dedup,
        op5_perplexity,
        op6_jaccard_join,
        op7_toxicity,
        op8_license_scan,
        op9_quality_rules,
        op10_token_counts,
        op11_source_divergence,
        op12_spelling_variants,
        op13_html_text,
    )
}


# SQL texts below: regular expressions there are those of the SQL engine, where (?s), \x00 and so on mean the same.

#: Targets resolved as in url_filter: whole, //host, /path, ?query or relative to the folder; ./ and ../ are left as
#: they stand, which names a node that no page has, so SQL is held against tables without them.
OP1_SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path,
  regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1, 's') AS asked FROM p),
rules(rule, own, start, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
tags AS (SELECT page_id, url, host, unnest(regexp_extract_all(html, '(<(?:link|meta)\b[^>]*>)', 1, 'i')) AS tag FROM h WHERE strpos(url, '://') > 0),
found AS (SELECT url, host, CASE WHEN regexp_matches(tag, '^<link', 'i') AND regexp_matches(tag, '\srel\s*=\s*["'']?\s*canonical\b', 'i') THEN regexp_extract(tag, '[\s"'';]href\s*=\s*["'']?([^"''>\s]+)', 1, 'i')
  WHEN regexp_matches(tag, '^<meta', 'i') AND regexp_matches(tag, '\shttp-equiv\s*=\s*["'']?\s*refresh\b', 'i') THEN regexp_extract(tag, '[\s"'';]url\s*=\s*["'']?([^"''>\s;]+)', 1, 'i') ELSE '' END AS t FROM tags),
links AS (SELECT url AS u, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN t LIKE '//%' THEN regexp_extract(url, '^([^:]*:)//', 1) || t WHEN t LIKE '/%' THEN regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || t
  WHEN t LIKE '?%' OR t LIKE '#%' THEN regexp_extract(url, '^([^:]*://[^?#]*)', 1) || t ELSE regexp_replace(regexp_extract(url, '^([^:]*://[^?#]*)', 1), '([^/:])/[^/]*$', '\1') || '/' || t END AS v FROM (SELECT url, replace(t, '&amp;', '&') AS t FROM found) WHERE t <> ''),
spelled AS (SELECT DISTINCT url, lower(split_part(url, '://', 1)) || '://' || translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1, 's'), '/+$', '')
  || regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*(\?[^#]*)', 1, 's') AS node FROM (SELECT u AS url FROM links UNION SELECT v FROM links UNION SELECT url FROM h WHERE strpos(url, '://') > 0)),
edges AS (SELECT a.node AS a, b.node AS b FROM links JOIN spelled a ON a.url = u JOIN spelled b ON b.url = v), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT DISTINCT node, node FROM spelled UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
fits AS (SELECT url, node, rule, verdict, row_number() OVER (PARTITION BY url ORDER BY length(rule) DESC) AS r FROM (SELECT s.url, s.node, translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1, 's') AS path FROM spelled s) x
  JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start)),
blocked AS (SELECT r.node, min(f.rule) AS blocked_by FROM reach r JOIN fits f ON f.node = r.other AND f.r = 1 AND f.verdict = 'block' GROUP BY 1)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN b.blocked_by IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN f.rule IS NULL THEN b.blocked_by END AS blocked_by
FROM h LEFT JOIN fits f ON f.url = h.url AND f.r = 1 LEFT JOIN spelled s ON s.url = h.url LEFT JOIN blocked b ON b.node = s.node"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)', 1), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, list_transform(regexp_extract_all(coalesce(text, ''), '([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)', 1), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM benchmark),
s AS (SELECT item, ws, least(10, len(ws)) AS w, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS a FROM i WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, ws[a : a + w - 1] AS words, w FROM s),
one AS (SELECT words, w, row_number() OVER (ORDER BY words) AS wid FROM (SELECT DISTINCT words, w FROM win)),
slot AS (SELECT wid, w, unnest(generate_series(1, w)) AS k, unnest(words) AS term FROM one),
terms AS (SELECT DISTINCT term FROM slot),
post AS (SELECT doc_id, pos, term FROM (SELECT doc_id, unnest(generate_series(1, len(ws))) AS pos, unnest(ws) AS term FROM d) SEMI JOIN terms USING (term)),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
rare AS (SELECT wid, w, k, term FROM (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY df, k) AS r, count(*) OVER (PARTITION BY wid) AS full_n FROM slot JOIN freq USING (term)) WHERE r = 1 AND full_n = w),
place AS (SELECT rare.wid, rare.w, post.doc_id, post.pos - rare.k AS d FROM rare JOIN post USING (term)),
hit AS (SELECT wid, place.w, place.doc_id, d, count(DISTINCT slot.k) AS met, count(DISTINCT CASE WHEN post.pos = d + slot.k THEN slot.k END) AS whole FROM place JOIN slot USING (wid) JOIN post ON post.doc_id = place.doc_id AND post.term = slot.term AND post.pos BETWEEN d + slot.k - 2 AND d + slot.k + 2 GROUP BY 1, 2, 3, 4),
near AS (SELECT h.doc_id, win.item, bool_or(whole = h.w) AS exact FROM hit h JOIN one USING (wid) JOIN win ON win.words = one.words WHERE met = h.w GROUP BY 1, 2),
items AS (SELECT doc_id, count(*) AS n_near, count(*) FILTER (exact) AS n_items, string_agg(item, ',' ORDER BY item) FILTER (exact) AS ids FROM near GROUP BY 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(d + 1, d + w)) AS p FROM hit WHERE whole = w) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN cover ON cover.doc_id = d.doc_id"""

OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(generate_series(0, len(ws) - 50)) AS start, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, start, sha256(array_to_string(ws[start + 1 : start + 50], ' ')) AS win FROM s),
g AS (SELECT doc_id, start, count(*) OVER (PARTITION BY win) AS n, first_value(doc_id) OVER (PARTITION BY win ORDER BY doc_id, start) AS first, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) = 1 AS kept FROM h),
r AS (SELECT doc_id, start, first, kept, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id, kept ORDER BY start) + 50 THEN 0 ELSE 1 END AS new FROM g WHERE n > 1),
x AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kept ORDER BY start) AS run FROM r)
SELECT doc_id, CAST(min(start) AS INTEGER) AS start_word, CAST(max(start) + 50 - min(start) AS INTEGER) AS n_words, min(first) AS first_doc_id, kept FROM x GROUP BY doc_id, kept, run"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i : i + 4], ' ')) AS sh FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT a, b FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
root AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY 1), degree AS (SELECT a, count(*) AS n_links FROM link GROUP BY 1)
SELECT w.doc_id, least(w.doc_id, coalesce(root.least, w.doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n.n, 0) AS n_shingles FROM w LEFT JOIN root USING (doc_id) LEFT JOIN degree ON a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

OP9_SQL = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, lang, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM b WHERE len(ws) > 2)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1),
m AS (SELECT b.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, word_chars, n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM b LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols * 1048576 // greatest(word_chars, 1) AS symbol_share, n_dup_lines * 1048576 // greatest(n_lines, 1) AS dup_line_share, n_repeat_words * 1048576 // greatest(n_words, 1) AS repeat_share, word_chars * 1048576 // greatest(n_words, 1) AS mean_word FROM m),
u AS (SELECT lang, source, unnest(['symbol_share', 'dup_line_share', 'repeat_share', 'mean_word']) AS measure, unnest([symbol_share, dup_line_share, repeat_share, mean_word]) AS x FROM v WHERE NOT base_failed),
k AS (SELECT lang, source, measure, x | ((CAST(1 AS BIGINT) << greatest(length(bin(x)) - 8, 0)) - 1) AS v FROM u),
e AS (SELECT 0 AS level, lang, source, measure, v, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 1, lang, NULL, measure, v, count(*) FROM k GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, measure, v, count(*) FROM k GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY v) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM e),
q AS (SELECT level, lang, source, measure, max(total) AS total, min(v) FILTER (upto * 1000 >= total * 50) AS low, min(v) FILTER (upto * 1000 >= total * 500) AS middle, min(v) FILTER (upto * 1000 >= total * 995) AS high FROM c GROUP BY ALL),
l AS (SELECT level, lang, source, measure, CASE WHEN total >= 200 OR level = 2 THEN CASE WHEN middle > low THEN middle + 4 * (middle - low) WHEN high > middle THEN high END END AS lim FROM q),
z AS (SELECT v.doc_id, l0.measure, coalesce(l0.lim, l1.lim, l2.lim) AS lim, CASE l0.measure WHEN 'symbol_share' THEN symbol_share WHEN 'dup_line_share' THEN dup_line_share WHEN 'repeat_share' THEN repeat_share ELSE mean_word END AS x, CASE l0.measure WHEN 'symbol_share' THEN 1 WHEN 'dup_line_share' THEN 2 WHEN 'repeat_share' THEN 3 ELSE 4 END AS o
  FROM v JOIN l l0 ON l0.level = 0 AND l0.lang IS NOT DISTINCT FROM v.lang AND l0.source IS NOT DISTINCT FROM v.source JOIN l l1 ON l1.level = 1 AND l1.lang IS NOT DISTINCT FROM v.lang AND l1.measure = l0.measure JOIN l l2 ON l2.level = 2 AND l2.measure = l0.measure WHERE NOT base_failed),
f AS (SELECT doc_id, string_agg(measure, ',' ORDER BY o) AS reasons FROM z WHERE x > lim GROUP BY 1)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.doc_id IS NULL AS kept, coalesce(reasons, '') AS reasons FROM v LEFT JOIN f USING (doc_id)"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM k GROUP BY 1),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(all_n), 0) AS all_n, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = x.lang AND c.source = x.source) AS own_n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l USING (lang) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, CAST(1 + (1000000000 * (coalesce(n, 0) + 1)::HUGEINT) // (own_n + v) AS HUGEINT) AS p, CAST(1 + (1000000000 * (total + 1)::HUGEINT) // (all_n + v) AS HUGEINT) AS q FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 200"""

#: crc32 as a fold over the bits of all bytes, lowest first; words of Latin-1 letters have one or two bytes a character.
OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
o AS (SELECT id, run, count(*) AS n FROM d WHERE length(run) >= 5 GROUP BY 1, 2),
bytes AS (SELECT *, list_transform(range(0, CAST(octet_length(encode(id || ':' || run)) AS BIGINT)), lambda i: CAST(ord(substr(hex(encode(id || ':' || run)), 2 * i + 1, 1)) AS BIGINT)) AS hi, list_transform(range(0, CAST(octet_length(encode(id || ':' || run)) AS BIGINT)), lambda i: CAST(ord(substr(hex(encode(id || ':' || run)), 2 * i + 2, 1)) AS BIGINT)) AS lo FROM o),
bits AS (SELECT id, run, n, flatten(list_transform(list_zip(hi, lo), lambda z: list_transform(range(0, 8), lambda k: (((z[1] - CASE WHEN z[1] > 57 THEN 55 ELSE 48 END) * 16 + z[2] - CASE WHEN z[2] > 57 THEN 55 ELSE 48 END) >> k) & 1))) AS bit FROM bytes),
crc AS (SELECT run, n, xor(list_reduce(bit, lambda c, b: xor(c >> 1, ((c & 1) + b) % 2 * 3988292384), 4294967295), 4294967295) AS h FROM bits),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, sum(n) AS n FROM crc GROUP BY 1),
v AS (SELECT word, CAST(n AS BIGINT) AS n FROM w WHERE length(word) >= 5 AND n >= 3),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n FROM del a JOIN del b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM del a JOIN v b ON b.word = a.rest UNION SELECT b.word, a.word, a.n FROM del a JOIN v b ON b.word = a.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near GROUP BY 1),
r AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain(word, spot) AS (SELECT word, word FROM r UNION ALL SELECT chain.word, r.form FROM chain JOIN r ON r.word = chain.spot WHERE r.form IS NOT NULL),
ends AS (SELECT chain.word, chain.spot AS root FROM chain JOIN r ON r.word = chain.spot WHERE r.form IS NULL)
SELECT r.word, form, root, n, n_near, form_n FROM r JOIN ends USING (word)"""

#: Classifiers, tokenizers and licence windows have no SQL; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op3_decontaminate": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op6_jaccard_join": OP6_SQL, "op9_quality_rules": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_spelling_variants": OP12_SQL}
