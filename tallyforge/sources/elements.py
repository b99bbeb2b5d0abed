"""Elements of saved pages, parted by the depth of their tags: posts of threads and cards of sold listings, nested or not."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.scalars import Money
from .pages import ENTITIES

# The tags and whole comments, scripts and styles of a page, elements without an end, and the weights of members' groups (the first that fits counts).
QUOTED = r"""[^<>"']*+(?:(?:"[^"]*+"|'[^']*+')[^<>"']*+)*+>"""
SKIPPED = r"!--.*?-->|(?:script|style)\b.*?</(?:script|style)\s*>"
TAG = rf"<(?:{SKIPPED}|[a-z/!]{QUOTED}|[a-z/!][^<>]*>)"
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
GROUPS = [
    ("administrator", 4.0), ("admin", 4.0), ("global moderator", 3.5), ("moderator", 3.5), ("supporting member", 2.5), ("advanced member", 2.0),
    ("veteran member", 2.0), ("members", 1.0), ("member", 1.0), ("new member", 0.5), ("newbie", 0.4),
]


SPANS = "array<struct<name string, tag string, start int, inner int, close int, stop int, part string>>"


def _token(names: list[str] | None) -> re.Pattern:
    """Group 1 is the next tag of those names, the next of all without; with names, what stands before it is passed over in the same match."""
    flags = re.I | re.S | re.A
    if not names:
        return re.compile(f"({TAG})", flags)
    own = rf"/?(?:{'|'.join(map(re.escape, names))})(?![a-z0-9-])"
    body = rf"(?:[a-z/!]{QUOTED}|[a-z/!][^<>]*>)"
    return re.compile(rf"(?:[^<]++|<(?:{SKIPPED}|(?!{own}){body})|<(?!{own})|<(?!{body}))*+(?:(<{body})|\Z)", flags)


def _scanner(names: list[str] | None = None, like: str | None = None):
    """page -> [name, tag, start, inner, close, stop] of its elements in the order of their opening tags; see element_spans."""
    token, word, left_out = _token(names), re.compile(r"</?([a-z][a-z0-9-]*)", re.I | re.A), frozenset(["script", "style", *VOID])
    holds = like and ((lambda tag: like in tag) if re.fullmatch(r"[\w -]+", like) else re.compile(like).search)

    def spans(page: str) -> list[list]:
        found, unclosed = [], {}
        for m in token.finditer(page):
            tag = m[1]
            # Elements that are not asked for matter only inside one of their name that is.
            if not tag or (holds and not unclosed and (tag[1] == "/" or not holds(tag))):
                continue
            n = word.match(tag)
            name = n and n[1].lower()
            if not name or name in left_out:
                continue
            if tag[1] != "/":
                asked = not holds or holds(tag)
                if asked or name in unclosed:
                    unclosed.setdefault(name, []).append(len(found) if asked else -1)
                if asked:
                    found.append([name, tag, m.start(1), m.end(1), len(page), len(page)])
            elif name in unclosed:
                at = unclosed[name].pop()
                if at >= 0:
                    found[at][4:] = m.span(1)
                if not unclosed[name]:
                    del unclosed[name]
        return found

    return spans


def element_spans(html: Column, names: list[str] | None = None, like: str | None = None, parts: bool = False) -> Column:
    """SPANS of the elements of a page in the order of their opening tags, found by one scan of it; see elements.

    like: a pattern that an opening tag must hold to be given; parts: with the
    element's own html, which pages nested deeply should ask for few elements only.
    """
    scan = _scanner(names, like)
    fields = [("name", pa.string()), ("tag", pa.string()), *((c, pa.int32()) for c in ("start", "inner", "close", "stop")), ("part", pa.string())]

    @F.arrow_udf(SPANS)
    def run(pages: pa.Array) -> pa.Array:
        rows = [[] if p is None else [(*x, p[x[2] : x[5]] if parts else None) for x in scan(p)] for p in pages.to_pylist()]
        flat = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * len(fields)
        ends = [0]
        for r in rows:
            ends.append(ends[-1] + len(r))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(flat, fields, strict=True)], [n for n, _ in fields]))

    return run(html)


def elements(pages: DataFrame, keys: list[str], html: str = "html", names: list[str] | None = None, like: str | None = None) -> DataFrame:
    """(keys, name, tag, start, inner, close, stop) of the elements of pages; keys name a page, names limits the elements, like is a pattern their opening tags hold.

    tag is the opening tag; start, inner, close and stop are the characters before
    it, up to its content, up to its closing tag and up to its end. A closing tag
    ends the last element of its name that is open, so elements may lie in others
    of their name. One that is never closed reaches to the end of the page; void
    elements, comments, scripts and styles are none, a stray closing tag closes
    nothing. Null pages have no elements. A page is scanned where it stands, none is shuffled.
    """
    d = pages.select(*keys, F.explode(element_spans(F.col(html), names, like)).alias("s"))
    return d.select(*keys, *[f"s.{c}" for c in ("name", "tag", "start", "inner", "close", "stop")])


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of an opening tag, null if it has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(tag.rlike(pattern), F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))


def has_class(tag: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attribute(tag, "class"), r"\s+"), name), F.lit(False))


def inner_text(html: Column, joint: str = " ") -> Column:
    """Text without comments, scripts, styles and tags, its pieces joined by joint, white space squeezed, entities read."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>", joint)
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"""(?s)<[a-zA-Z/!](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>""", joint)
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, " +", " "), F.lit(" \n"))


def _slice(html: Column, start: Column, stop: Column) -> Column:
    return F.substring(html, start + 1, stop - start)


def _parts(pages: DataFrame, keys: list[str], html: str, name: str, like: str, wanted, part: str) -> DataFrame:
    """(keys, i, part): the html of the elements of that name whose span is wanted, in page order, i from 0."""
    found = F.filter(element_spans(F.col(html), [name], like, parts=True), wanted)
    return pages.select(*keys, F.posexplode(F.transform(found, lambda s: s["part"])).alias("i", part))


def thread_posts(pages: DataFrame, thread: str = "thread", html: str = "html") -> DataFrame:
    """(thread, i, author, group, posts, rep, text): posts of saved thread pages in order; post 0 asks.

    A post is an article with an id and a class that contains ipsComment; a post
    quoted inside another is one too, and its text belongs to both. Author, group
    and number of posts come from the post's aside: the first text of class
    ipsType_break (else of a profile link, else '?'), the first list item that
    names a group (else null), the largest item that is a number ('1.2k' is
    1,200; else 0). rep is the group's weight (1 without) times log10(posts + 10).
    Text is what stands in its content, '' if it has none. Threads are unique;
    null pages have no posts.
    """
    c = F.col("tag")
    posts = _parts(pages, [thread], html, "article", "ipsComment", lambda s: attribute(s["tag"], "id").isNotNull() & F.coalesce(attribute(s["tag"], "class").contains("ipsComment"), F.lit(False)), "post")
    keys = [thread, "i"]
    content = (attribute(c, "data-role") == "commentContent") | ((F.col("name") == "div") & attribute(c, "class").contains("cPost_contentWrap"))
    kind = (
        F.when(F.coalesce(content, F.lit(False)), "text")
        .when(F.col("name") == "li", "item")
        .when(F.coalesce(attribute(c, "class").contains("ipsType_break"), F.lit(False)), "name")
        .when((F.col("name") == "a") & attribute(c, "href").contains("/profile/"), "profile")
        .when(F.col("name") == "aside", "aside")
    )
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("stop"))).over(before) > F.col("start"), F.lit(False))
    d = elements(posts, keys, "post").withColumn("kind", kind).where("kind is not null").withColumn("in_aside", inside("aside")).withColumn("in_text", inside("text"))
    d = d.where(F.when(F.col("kind") == "text", ~F.col("in_text")).otherwise((F.col("kind") != "aside") & F.col("in_aside")))
    spans = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "inner", "close"))).alias("spans"))
    texts = F.transform(F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)), lambda s: F.struct(s["kind"].alias("kind"), _slice(F.col("post"), s["inner"], s["close"]).alias("html")))
    d = posts.join(spans, keys, "left").withColumn("texts", texts)
    of = lambda k: F.transform(F.filter("texts", lambda s: s["kind"] == k), lambda s: inner_text(s["html"]))
    first = lambda k: F.get(F.filter(F.transform(F.filter("texts", lambda s: s["kind"] == k), lambda s: inner_text(F.regexp_extract(s["html"], r"(?s)\A(?:\s*<[^>]*>)*\s*([^<]*)", 1))), lambda s: s != ""), F.lit(0))
    known = "|".join(dict.fromkeys(n for n, _ in GROUPS))
    number = lambda s: F.when(s.endswith("k"), (F.regexp_replace(s, "[,k]", "").try_cast("double") * 1000).cast("long")).otherwise(F.coalesce(F.replace(s, F.lit(","), F.lit("")).try_cast("long"), F.lit(0)))
    numbers = F.transform(F.filter(of("item"), lambda s: s.rlike(r"\A[\d,]+\.?\d*k?\z")), number)
    group = F.get(F.filter(of("item"), lambda s: F.lower(s).rlike(known)), F.lit(0))
    d = d.select(*keys, F.coalesce(first("name"), first("profile"), F.lit("?")).alias("author"), group.alias("group"), F.coalesce(F.array_max(numbers), F.lit(0)).alias("posts"), F.trim(F.array_join(of("text"), " ")).alias("text"))
    weight = F.lit(1.0)
    for name, w in reversed(GROUPS):
        weight = F.when(F.lower("group").contains(name), w).otherwise(weight)
    return d.select(*keys, "author", "group", "posts", F.round(weight * F.log10(F.col("posts") + 10), 3).alias("rep"), "text")


def _card_reader(short: bool = True):
    """page -> [(i, item_id, title, price, lines)] of its cards that have an item number, a title and a price; title and price as html.

    short: a page without comments, scripts and styles in which each '<' begins a whole tag is split at its tags once; others, and all without, are read by their elements.
    """
    cards, fields, flags = _scanner(["li"], "s-card"), _scanner(like="s-card__"), re.I | re.S | re.A
    named = re.compile(r"""\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", flags)
    link, number = re.compile(r"""<a\b[^>]*\bhref\s*=\s*["']([^"']*/itm/[^"']*)""", flags), re.compile(r"/itm/(\d{9,})", re.A)
    space, word, tag_end = re.compile(r"\s+", re.A), re.compile(r"</?([a-z][a-z0-9-]*)", re.I | re.A), re.compile(f"<[a-zA-Z/!]{QUOTED}", re.S)
    skipped, whole = re.compile(f"<(?:{SKIPPED})", flags), re.compile(f"(<[a-z/!]{QUOTED})", flags)

    def classes(tag: str) -> list[str]:
        m = named.search(tag)
        return space.split(m[1] or m[2] or m[3] or "") if m else []

    def item(card: str) -> str | None:
        m = link.search(card)
        m = m and number.search(m[1])
        return m and m[1]

    def lines(text: str) -> list[str]:
        if "&" in text:
            for entity, char in ENTITIES:
                text = text.replace(entity, char)
        return [x for line in (re.sub("  +", " ", text) if "  " in text else text).split("\n") if (x := line.strip(" "))]

    def by_elements(page: str, small: str) -> Iterator[tuple]:
        loose, i = small.find("matching fewer words"), -1
        for _, tag, start, _, _, stop in cards(page):
            if "s-card" not in classes(tag) or 0 <= loose < start:
                continue
            i, card = i + 1, page[start:stop]
            of = item(card)
            if not of:
                continue
            found = [(classes(x[1]), card[x[3] : x[4]]) for x in fields(card)]
            title = next((html for c, html in found if "s-card__title" in c), None)
            price = next((html for c, html in found if "s-card__price" in c and "s-card__title" not in c), None)
            if title is not None and price is not None:
                yield i, of, title, price, lines(tag_end.sub("\n", space.sub(" ", skipped.sub("\n", card))))  # as inner_text reads it

    def name(tag: str) -> str | None:
        n = word.match(tag)
        return n and n[1].lower()

    def by_tags(page: str, small: str, parts: list[str]) -> Iterator[tuple]:
        # Tag k is parts[2 * k + 1], the text behind it the next part; an element is [its tag, the part behind its last one].
        found, unclosed, last = [], [], len(parts)
        for k in range(1, last, 2):
            tag = parts[k]
            if tag[1] in "lL" or tag[2] in "lL":
                if name(tag) != "li":
                    continue
                if tag[1] != "/":
                    asked = "s-card" in tag
                    if asked or unclosed:
                        unclosed.append(len(found) if asked else -1)
                    if asked:
                        found.append([k, last])
                elif unclosed and (at := unclosed.pop()) >= 0:
                    found[at][1] = k + 1
        loose, i = small.find("matching fewer words"), -1
        starts = list(itertools.accumulate(map(len, parts), initial=0)) if loose >= 0 else None
        blank = any(c in page for c in "\t\n\r\f\v")
        for k, end in found:
            if "s-card" not in classes(parts[k]) or (starts and loose < starts[k]):
                continue
            i += 1
            of = item("".join(parts[k:end]))
            if not of:
                continue
            title = price = None
            for j in range(k, end, 2):
                tag = parts[j]
                if "s-card__" not in tag or tag[1] == "/" or not (n := name(tag)) or n in VOID:
                    continue
                c = classes(tag)
                is_title, is_price = title is None and "s-card__title" in c, price is None and "s-card__price" in c and "s-card__title" not in c
                if is_title or is_price:
                    depth, to = 1, j
                    while depth and (to := to + 2) < end:
                        if name(parts[to]) == n:
                            depth += -1 if parts[to][1] == "/" else 1
                    html = "".join(parts[j + 1 : min(to, end)])
                    title, price = html if is_title else title, html if is_price else price
                if title is not None and price is not None:
                    break
            if title is not None and price is not None:
                texts = parts[k + 1 : end : 2]
                yield i, of, title, price, lines("\n".join([space.sub(" ", t) for t in texts] if blank else texts))

    def read(page: str) -> Iterator[tuple]:
        small = page.lower()
        if short and not any(x in small for x in ("<!--", "<script", "<style")):
            parts = whole.split(page)
            if page.count("<") == len(parts) // 2:
                return by_tags(page, small, parts)
        return by_elements(page, small)

    return read


def sold_cards(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, i, item_id, title, sold_price, sold_date, shipping_cost, listing_type, bids_count, bo_accepted, seller, seller_pct, seller_score) of sold-listing pages.

    A card is a list item of class s-card, whatever items lie inside it; i is its
    place on the page. Cards without an item number of nine digits or more are
    decoys and go, as do those without a title or a price and those behind the
    text 'matching fewer words', which are loose matches. Titles leave out
    hidden parts. A seller stands in one piece of text with its share of
    positive ratings or in the piece before it. Pages are unique.
    """
    keys, read = [page, "i"], _card_reader()
    out = [StructField(page, pages.schema[page].dataType), StructField("i", IntegerType()), *(StructField(c, StringType()) for c in ("item_id", "title", "price")), StructField("lines", ArrayType(StringType()))]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(at, *r) for at, p in enumerate(batch.column(1).to_pylist()) if p is not None for r in read(p)]
            of, *columns = zip(*rows, strict=True) if rows else [()] * len(out)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *map(pa.array, columns, kinds)], names=[f.name for f in out])

    hidden = r"""(?is)<([a-z0-9]+)\b[^>]*(?:class\s*=\s*"[^"]*\bclipped\b|aria-hidden\s*=\s*"true")[^>]*>.*?</\1\s*>"""
    money = lambda s: F.replace(F.regexp_extract(s, r"\$([\d,]+(?:\.\d{1,2})?)", 1), F.lit(","), F.lit("")).try_cast(Money)
    title = F.trim(F.regexp_replace(inner_text(F.regexp_replace("title", hidden, " ")), "Opens in a new window or tab$", ""))
    # In an array of one, so that what filters ask for is not worked out again below them.
    card = F.struct("item_id", title.alias("title"), money(inner_text(F.col("price"))).alias("sold_price"), "lines")
    d = pages.select(page, html).mapInArrow(parse, StructType(out)).select(*keys, F.explode(F.array(card)).alias("x")).select(*keys, "x.*")
    d = d.where("item_id <> '' and title <> '' and sold_price is not null").withColumn("w", F.array_join("lines", "\n"))
    w = F.col("w")
    bids = F.when(w.contains("bid"), F.regexp_extract("w", r"(\d+)\s+bids?\b", 1)).try_cast("long")
    offer = w.rlike("(?i)Best offer accepted")
    rating = r"\A(?:([A-Za-z0-9_.*-]+)\s+)?([\d.]+)%\s+positive\s+\(([\d.,]+)([KM]?)\)"
    at = F.array_position(F.transform("lines", lambda s: s.rlike(rating)), True).cast("int")
    d = d.withColumn("at", at).withColumn("rated", F.get("lines", F.col("at") - 1)).withColumn("above", F.get("lines", F.col("at") - 2))
    r = lambda i: F.regexp_extract("rated", rating, i)
    score = F.replace(r(3), F.lit(","), F.lit("")).try_cast("decimal(18,3)") * F.when(r(4) == "K", 1000).when(r(4) == "M", 1_000_000).otherwise(1)
    kind = F.when(bids.isNotNull(), "Auction").when(offer, "Best Offer").when(w.contains("or Best Offer"), "Buy It Now or Best Offer").when(w.contains("Buy It Now"), "Buy It Now")
    ship = F.coalesce(money(F.regexp_extract("w", r"(?i)\+\s*(\$[\d,.]+)\s+delivery", 1)), F.when(w.rlike("(?i)Free delivery"), F.lit(0).cast(Money)))
    return d.select(
        *keys, "item_id", "title", "sold_price", F.try_to_timestamp(F.regexp_replace(F.regexp_extract("w", r"Sold\s+([A-Z][a-z]{2}\s+\d{1,2},\s+\d{4})", 1), r"\s+", " "), F.lit("MMM d, yyyy")).cast("date").alias("sold_date"), ship.alias("shipping_cost"), kind.alias("listing_type"), bids.alias("bids_count"), offer.alias("bo_accepted"),
        F.coalesce(F.nullif(r(1), F.lit("")), F.when(F.col("above").rlike(r"\A[A-Za-z0-9_.*-]+\z"), F.col("above"))).alias("seller"), r(2).try_cast("double").alias("seller_pct"), F.round(score).cast("long").alias("seller_score"),
    )
