"""Elements of pages against the parser of the standard library, and hand cases of posts and cards."""

import datetime
import random
from decimal import Decimal as D
from html.parser import HTMLParser

from tallyforge import plans
from tallyforge.sources import elements as E


class Spans(HTMLParser):
    """(name, start, stop) of each element of a well-formed page of one line."""

    def __init__(self, html):
        super().__init__()
        self.html, self.open, self.found = html, [], []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        if tag not in (*E.VOID, "script", "style"):
            self.open.append((tag, self.getpos()[1]))

    def handle_endtag(self, tag):
        if tag not in ("script", "style"):
            name, start = self.open.pop()
            assert name == tag
            self.found.append((name, start, self.html.index(">", self.getpos()[1]) + 1))


def tree(r, depth):
    out = []
    for _ in range(r.randint(0, 4)):
        k = r.random()
        if k < 0.5 and depth:
            name = r.choice(["div", "ARTICLE", "li", "span", "h2"])
            out.append(f"<{name}{r.choice(['', ' id=a', ' class=\"x > y\"', ' data-q=\'</div>\' hidden'])}>{tree(r, depth - 1)}</{name.lower()}{r.choice(['', ' '])}>")
        else:
            out.append(r.choice(["text &amp; more", "<br>", "<img src='a>b'>", "<!-- <div> -->", "<script>if (a<b) '<div>'</script>", "ä€", " 1 < 2 "]))
    return "".join(out)


def test_elements_match_the_standard_parser(spark):
    r = random.Random(3)
    pages = {i: tree(r, 6) for i in range(300)}
    got = {i: [] for i in pages}
    for x in E.elements(spark.createDataFrame(list(pages.items()), "p int, html string"), ["p"]).collect():
        got[x.p].append((x.name, x.start, x.stop))
        assert pages[x.p][x.start : x.inner] == x.tag and pages[x.p][x.close : x.stop].startswith("</")
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(Spans(h).found) for i, h in pages.items()}
    assert sum(map(len, got.values())) > 500


def test_broken_pages(spark):
    pages = [(0, None), (1, ""), (2, "</div><div>a</div>"), (3, "<div>a<div>b</div>"), (4, "<div " + "x" * 200_000), (5, "<p>" * 3), (6, "<li>" + "<b title='a\">b</b>")]
    got = {}
    for x in E.elements(spark.createDataFrame(pages, "p int, html string"), ["p"]).collect():
        got.setdefault(x.p, []).append((x.name, x.start, x.stop))
    assert 0 not in got and 1 not in got and got[2] == [("div", 6, 18)] and sorted(got[3]) == [("div", 0, 18), ("div", 6, 18)] and 4 not in got and len(got[5]) == 3


POST = '<article id="{0}" class="a ipsComment"><aside><ul><li>12 posts</li>{1}</ul></aside><div class="cPost_contentWrap">{2}</div></article>'


def test_thread_posts_nested(spark):
    inner = POST.format(2, "<li><b>Global</b> Moderator</li><li>1.5k</li><li>1,499</li>", "<p>inner<br>text</p>")
    html = '<article class="ipsComment">no id</article>' + POST.format(1, '<li class=n><a href="/profile/7"><i></i> Ann </a></li>', f"outer <div data-role='commentContent'>deep</div>{inner} end") + '<article id="3" class="ipsComment"></article>'
    d = spark.createDataFrame([("t", html), ("none", None), ("plain", "<p>x</p>")], "thread string, html string")
    rows = {r.i: r for r in E.thread_posts(d).collect()}
    assert set(rows) == {0, 1, 2} and {r.thread for r in rows.values()} == {"t"}
    assert (rows[0].author, rows[0].text) == ("Ann", "outer deep 12 posts Global Moderator 1.5k 1,499 inner text end") and rows[0].posts == 1500
    assert (rows[1].author, rows[1].group, rows[1].posts, rows[1].rep, rows[1].text) == ("?", "Global Moderator", 1500, 11.126, "inner text")
    assert (rows[2].author, rows[2].group, rows[2].posts, rows[2].rep, rows[2].text) == ("?", None, 0, 1.0, "")


def card(n, title="A lamp", price="$1,204.50", rest=""):
    return f'<li class="s-card"><ul><li>x</li></ul><a class=k href="https://shop.example/itm/{n}?a"></a><div class="s-card__title">{title}<span aria-hidden="true">hidden</span></div><b class="s-card__price">{price}</b>{rest}</li>'


def test_sold_cards(spark):
    html = card("123456789", rest="<i>Sold  Mar 3, 2024</i><i>+$4.50 delivery</i><p>or Best Offer</p><p>a.b*c 99.9% positive (6.5K)</p>") + card("12345678") + card("222222222", title="") + card("333333333", price="soon")
    html += '<li class="s-cardx">' + card("444444444", "B &amp; C", "$5", "<p>shop_1</p><p>100% positive (1,905)</p><i>Free delivery</i><i>12 bids</i><i>Best offer accepted</i>") + "</li>" + "<p>Results Matching Fewer Words</p>" + card("555555555")
    d = spark.createDataFrame([(1, html), (2, None), (3, "<ul></ul>")], "page_id int, html string")
    rows = [tuple(r) for r in E.sold_cards(d).orderBy("i").collect()]
    assert rows == [(1, 0, "123456789", "A lamp", D("1204.50"), datetime.date(2024, 3, 3), D("4.50"), "Buy It Now or Best Offer", None, False, "a.b*c", 99.9, 6500), (1, 4, "444444444", "B & C", D("5.00"), None, D("0.00"), "Auction", 12, True, "shop_1", 100.0, 1905)]


def test_pages_are_scanned_where_they_stand(spark):
    d = spark.createDataFrame([(1, card("123456789"))], "page_id int, html string")
    for found in (E.sold_cards(d), E.elements(d, ["page_id"])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_elements_asked_for_by_their_tag(spark):
    page = "<p><p class=k>a<p>b</p>c</p></p></li><li><li class=k>x<li>y</li></li><i class=k>"
    d = spark.createDataFrame([(1, page)], "p int, html string")
    tags = lambda like: sorted((x.name, x.start, x.inner, x.close, x.stop) for x in E.elements(d, ["p"], like=like).collect() if "class=k" in x.tag)
    assert tags("class=k") == tags(None) and len(tags(None)) == 3


def test_cards_are_read_in_one_step_either_way(spark):
    r, whole = random.Random(6), card("123456789", "A &amp; B", "$7", "<p>a  b</p>\n<i>3 bids</i>")
    bits = [whole, '<li class="s-card">', "<li>", "</li>", "</LI >", '<a href="/itm/123456789">', '<i class="s-card__title">t', "<b class=s-card__price>$5", "</i>", "</b>", "<img class=s-card__title>", "<p title='a>b'>", " x \t y ", "&nbsp;", "matching fewer words"]
    short, long = E._card_reader(), E._card_reader(short=False)
    for n in range(3000):
        odd = ["<!-- <li> -->", "<script>", "</script>", "<", ">", '"'] if n % 4 == 0 else []
        page = "".join(r.choice(bits + odd) for _ in range(r.randint(1, 25)))
        assert list(short(page)) == list(long(page))
    plan = E.sold_cards(spark.createDataFrame([(1, whole)], "page_id int, html string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_cards_of_order_lines_take_one_shuffle(spark, tmp_path):
    day = datetime.datetime(2001, 1, 2)
    rows = [(1, 2, 4, 7.25, 1.0, 0.0, 0.0, day, 2), (1, 3, 5, 8.5, 1.0, 0.0, 0.0, day, 1), (2, 5, 4, 9.0, 1.0, 0.0, 0.0, day, 1)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp_ntz, l_linenumber int")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    d = plans.QUERIES["s12_sold_cards"](spark, str(tmp_path))
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = sorted((r.page_id, r.title, str(r.sold_price), r.listing_type, r.seller) for r in d.collect())
    assert got == [(1, "Part & 2", "7.25", "Best Offer", "s4"), (1, "Part & 3", "8.50", "Buy It Now or Best Offer", "s5")]
