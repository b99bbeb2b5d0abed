"""URL filters: host and path rules, and block decisions carried over redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, small_side, stored
from .graph import connected_components

#: (rule, verdict): host up to the first slash, then the path's beginning.
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or without ://."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, url.substr(at + 3, F.char_length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none; of equally long ones the first in the list."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, slash, start = rule.partition("/")
        inside = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        fits = F.when(inside, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def plain_form(url: Column) -> Column:
    """One spelling of a URL: scheme and host in small letters, no fragment, no closing slash; null without ://."""
    scheme = lower_ascii(F.substring_index(url, "://", 1))
    asked = F.regexp_extract(_rest(url), r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), F.regexp_replace(path_of(url), "/+$", ""), asked))


def page_form(url: Column) -> Column:
    """The page a URL is a spelling of: plain_form without scheme, www., m., tracking parameters (fixed names) and .html."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/+$", ""), r"\.html?$", "")
    asked = F.regexp_extract(_rest(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda q: (q != "") & ~q.rlike(r"^(?:utm_[a-z]+|ref|fbclid|gclid)=")))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def resolved(target: Column, url: Column) -> Column:
    """A link's target taken against the page's url: whole, //host, /path, ?query, or relative to the page's folder; ./ and ../ are walked."""
    scheme, origin = F.regexp_extract(url, r"^([^:]*:)//", 1), F.regexp_extract(url, r"(?s)^([^:]*://[^/?#]*)", 1)
    path = path_of(url)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    asked = F.regexp_extract(target, r"(?s)([?#].*)$", 1)
    plain = F.regexp_replace(target, r"(?s)[?#].*$", "")
    steps = F.split(F.concat(F.when(plain.startswith("/"), F.lit("")).otherwise(folder), plain), "/")
    up = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    walked = F.aggregate(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.array(F.lit("")), up)
    whole = F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, target))
    return whole.when(plain == "", F.concat(origin, path, asked)).otherwise(F.concat(origin, F.array_join(walked, "/"), asked))


def link_targets(html: Column) -> Column:
    """array<string>: targets of all canonical links and all refreshes of a page, entities read, null for null."""
    unquoted = r"""(?i)[\s"';]%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def of(tag: str, attribute: str, value: str, pattern: str) -> Column:
        tags = F.regexp_extract_all(html, F.lit(f"(?i)(<{tag}\\b[^>]*>)"), F.lit(1))
        named = F.filter(tags, lambda t: t.rlike(f"(?i)\\s{attribute}\\s*=\\s*[\"']?\\s*{value}\\b"))
        return F.transform(named, lambda t: F.concat(*[F.regexp_extract(t, pattern, i) for i in (1, 2, 3)]))

    href = unquoted % "href"
    refresh = r"""(?i)[\s"';]url\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>;]+))"""
    found = F.concat(of("link", "rel", "canonical", href), of("meta", "http-equiv", "refresh", refresh))
    read = lambda t: F.replace(F.replace(F.replace(F.trim(t), F.lit("&#38;"), F.lit("&")), F.lit("&#x26;"), F.lit("&")), F.lit("&amp;"), F.lit("&"))
    return F.filter(F.transform(found, read), lambda t: t != "")


def page_edges(pages: DataFrame) -> DataFrame:
    """(u, v): URLs of pages and of what their canonical links and redirects (http-equiv refresh) lead to."""
    p = pages.where(F.instr("url", "://") > 0).select("url", F.explode(link_targets(F.col("html"))).alias("to"))
    return p.select(F.col("url").alias("u"), resolved(F.col("to"), F.col("url")).alias("v"))


def judge(
    pages: DataFrame, edges: DataFrame | None = None, rules: list[tuple[str, str]] | None = None, spelling: Callable[[Column], Column] = plain_form, redirects: DataFrame | None = None
) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, blocked_by.

    A URL that a rule fits takes the rule's verdict, so an explicit allow goes
    before whatever its aliases are. Any other URL is blocked if a URL of its
    component over edges (u, v) is blocked by a rule, and allowed otherwise;
    blocked_by is then the least such rule. Nodes are spellings, made of URLs of
    pages and of both ends of all edges alike: plain_form takes spellings of one
    address together, page_form also those of one page (schemes, www., .html and
    so on). edges may name URLs outside pages; rules judge them too. Without
    edges, those of page_edges are taken; redirects (u, v), as a crawl log has
    them, come on top of either. Null URLs and those without :// have no host,
    path, alias or rule and are allowed; page_ids may be null or repeat.
    """
    rules = RULES if rules is None else rules
    links = page_edges(pages) if edges is None else edges.select("u", "v")
    links = links if redirects is None else links.union(redirects.select("u", "v"))
    links = stored(links.select("u", "v", spelling(F.col("u")).alias("nu"), spelling(F.col("v")).alias("nv")), "links")
    # A component blocks only through members that a rule blocks: those alone are kept by node.
    fits = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    urls = pages.select("url", spelling(F.col("url")).alias("node")).union(links.select("u", "nu")).union(links.select("v", "nv"))
    blocked = urls.withColumn("fit", fits).where("fit.verdict = 'block'").groupBy("node").agg(F.min("fit.rule").alias("blocked_by"))
    roots = stored(connected_components(links.select(F.col("nu").alias("u"), F.col("nv").alias("v"))), "roots")
    alone = F.coalesce("root", "node")
    blocked = stored(blocked.join(roots, "node", "left").select(alone.alias("root"), "blocked_by").groupBy("root").agg(F.min("blocked_by").alias("blocked_by")), "blocked")
    members = roots.join(small_side(blocked), "root").select("node", "blocked_by").union(blocked.select(F.col("root").alias("node"), "blocked_by"))
    members = stored(members.groupBy("node").agg(F.min("blocked_by").alias("blocked_by")), "aliases").withColumnRenamed("node", "alias")
    p = pages.select("page_id", "url")
    host, path = F.coalesce(host_of(F.col("url")), F.lit("")), F.coalesce(path_of(F.col("url")), F.lit(""))
    # URLs without a node are spread over keys that no node has.
    node = F.coalesce(spelling(F.col("url")), F.concat(F.lit("?"), F.pmod(F.xxhash64("page_id"), F.lit(10_000)).cast("string")))
    p = p.select("page_id", host.alias("host"), path.alias("path"), node.alias("node")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    p = p.join(small_side(members), F.col("node") == F.col("alias"), "left")
    own = F.col("fit").isNull() & F.col("blocked_by").isNotNull()
    verdict = F.coalesce(F.col("fit.verdict"), F.when(own, F.lit("block")).otherwise(F.lit("allow")))
    return p.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.when(own, F.col("blocked_by")).alias("blocked_by"))
