"""Hand cases of the markdown queue, duplicates, audits, notes, readers, fuzzy titles and copy rules."""

import datetime
import difflib
import random

import pytest
from pyspark.sql import functions as F

from tallyforge import plans
from tallyforge.functions import scalars as S
from tallyforge.functions.titles import gestalt_ratio
from tallyforge.operators import audit, buckets, copy, fuzzy_titles, matching, money
from tallyforge.sources import runs


def test_scalar_cases(spark):
    d = spark.createDataFrame([("  Bin_007 ", "\\inventory\\x/", "The Old Brass Lamps 2 glass photos", "zz240649.JPG IMG_0042 ABCDEF1234")], "b string, f string, t string, p string")
    r = d.select(S.norm_bin(F.col("b")).alias("b"), S.norm_folder(F.col("f")).alias("f"), S.tokens(F.col("t")).alias("t"), S.frames(F.col("p")).alias("p"), S.norm_bin(F.lit("000")).alias("z"), S.norm_folder(F.lit("a/b")).alias("g"), S.norm_bin(F.lit(None).cast("string")).alias("n")).first()
    assert (r.b, r.f, r.t, r.p, r.z, r.g, r.n) == ("7", "inventory/x", ["brass", "lamp", "glass"], ["ZZ240649", "IMG_0042"], "0", "inventory/a/b", "")


def test_pairs_and_lots(spark):
    pair = {"Matching Cup and Saucer": True, "2 pcs Marble Bookends": True, "Lot Pair of Spurs": True, "One Earring, Single": False, "5 pairs cufflinks": False, "Cuff Links & Tray": False, "Salt & Pepper": True, "A very long title of a thing that goes on until it is cut at earri": True}
    several = {"Twelve Plates lot": True, "Cards 40 pieces": True, "1999 cards": False, "Lamp 12\" x 10\"": False, "Catalog 1990, Model 1995": False, "Maps 1990 and 1901": True, "Tennis game set": False}
    for cases, rule in ((pair, S.looks_pair_unit), (several, S.looks_multi_item)):
        got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", rule(F.col("t")).alias("x")).collect()
        assert {r.t: r.x for r in got} == cases


def test_cents_are_shared_exactly(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 10**7), r.randint(1, 10**6), r.randint(1, 10**7)) for _ in range(300)] + [(1, 1, 2), (3, 1, 2), (5, 1, 2), (10**9, 10**9, 10**9)]
    d = spark.createDataFrame(rows, "a long, b long, c long")
    got = d.select("a", "b", "c", (S.share_in_cents((F.col("a").cast("decimal(18,2)") / 100).cast("decimal(18,2)"), F.col("b"), F.col("c")) * 100).cast("long").alias("x")).collect()
    for x in got:
        q, rest = divmod(x.a * x.b, x.c)
        assert x.x == q + (2 * rest > x.c or (2 * rest == x.c and q % 2))
    lines = spark.createDataFrame([(1, "10.00", "0.00", "1.00", "0", None, False), (1, "20.00", "0.00", "1.00", "0", None, False)], "order_id int, item_price string, buyer_shipping string, fee_total string, refunded string, due string, cancelled boolean")
    lines = lines.select("order_id", "cancelled", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("item_price", "buyer_shipping", "fee_total", "refunded", "due")])
    assert sorted(str(x.ebay_fee) for x in money.flatten_orders(lines)[0].collect()) == ["0.33", "0.67"]


def test_relisted_row_outranks_sold(spark):
    cols = "sku string, status string, price double, listing_id string"
    a = spark.createDataFrame([("x", "SOLD", 5.0, "1"), ("y", "SOLD", 5.0, "1"), ("z", "DRAFTED", 5.0, None), ("w", "PUBLISHED", 5.0, "3"), ("v", "SOLD", 5.0, "4")], cols)
    b = spark.createDataFrame([("x", "PUBLISHED", 5.004, "2"), ("y", "UNPUBLISHED", 5.01, "1"), ("q", "PUBLISHED", 1.0, "9")], cols)
    got = sorted((r.kind, r.key, r.field or "") for r in matching.reconcile(a, b, "sku", ["status", "price", "listing_id"]).collect())
    assert got == [("drift", "x", "listing_id"), ("drift", "x", "status"), ("drift", "y", "price"), ("missing", "q", ""), ("never_listed", "z", ""), ("orphan", "v", ""), ("protected", "y", "status"), ("unbacked", "w", "")]


def test_trees_of_any_depth(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(41)], "id int, parent int, name string")
    got = {r.id: r.path for r in matching.flatten_tree(nodes).collect()}
    assert got == {i: " > ".join(f"n{j}" for j in range(i + 1)) for i in range(41)}
    with pytest.raises(ValueError, match="2 of 3 nodes"):
        matching.flatten_tree(spark.createDataFrame([(1, None, "a"), (2, 3, "b"), (3, 2, "c")], "id int, parent int, name string"))


def test_duplicate_decisions(spark):
    rows = spark.createDataFrame([("r1", "Brass oil lamp", "3", "ZZ1001", "a", None, ["ZZ1001"]), ("r2", "Brass candle stand", "Bin 003", "ZZ1002 ZZ1003", "b", None, []), ("r3", "Clock", "", "ZZ1003", "c", "L1", ["ZZ1003"])], "row string, description string, bin string, photos string, folder string, lot_id string, filed array<string>")
    cands = [("same folder", "Chair", "", None, "inventory/a/", None), ("lot folder", "Chair", "", None, "c", None), ("own frame", "Chair", "", "zz1001", None, None), ("shared frame", "Chair", "", "ZZ1003", None, None), ("words", "oil lamp of brass", "03", None, None, None), ("hint", "Chair", "bin 3", None, None, "r1"), ("two", "Chair", "", "ZZ1001", "b", None), ("nothing", "the old set", "", None, None, None)]
    c = spark.createDataFrame(cands, "cand string, description string, bin string, photos string, folder string, hint string")
    got = {r.cand: (r.action, r.best) for r in audit.decide_duplicates(c, rows).collect()}
    assert got == {"same folder": ("attach", "r1"), "lot folder": ("new", None), "own frame": ("attach", "r1"), "shared frame": ("new", None), "words": ("possible", "r1"), "hint": ("possible", "r1"), "two": ("possible", "r1"), "nothing": ("new", None)}


def test_fuzzy_titles(spark):
    r = random.Random(2)
    words = ["brass", "lamp", "oil", "vintage", "clock", "wall", "oak", "table", "chair", "glass"]
    drafts = [("s", f"d{i}", float(i), " ".join(r.sample(words, 4))) for i in range(30)] + [("t", "e0", 1.0, "brass lamp oil")]
    sales = [(i, "s", " ".join(r.sample(words, 4)) + r.choice(["", " x"])) for i in range(40)]
    got = {x.sale: (x.ref, x.matched_by) for x in fuzzy_titles.fuzzy_tier(spark.createDataFrame(sales, "sale int, store string, title string"), spark.createDataFrame(drafts, "store string, ref string, ask double, title string")).collect()}
    for i, _, t in sales:
        best = sorted(((difflib.SequenceMatcher(None, t, d).ratio(), ref) for s, ref, _, d in drafts if s == "s"), key=lambda x: (-x[0], x[1]))[:2]
        if best[0][0] < 0.75:
            assert i not in got
        else:
            tied = best[0][0] - best[1][0] < 0.02
            assert got[i] == (None if tied else best[0][1], f"{'ambiguous' if tied else 'title'}~{best[0][0]:.2f}")
    one = spark.createDataFrame([("abcd", "bcde"), ("", ""), ("x", "yyyyyyyy")], "a string, b string").select(gestalt_ratio("a", "b").alias("r")).collect()
    assert [x.r for x in one] == [0.75, 1.0, 0.0]


def test_notes_and_tiers(spark):
    t = "prose\nkind: thing\nKIND: Event\nspend: about $1,250.50 or so\nspend: 3\nspend_unit: dozen\nacquired:\nacquired: fair\n"
    d = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(buckets.parse_notes(F.col("t")).alias("n")).select("n.*").collect()
    assert [(x.kind, x.spend and str(x.spend), x.spend_unit, x.acquired) for x in d] == [("event", "1250.50", "lot", "fair"), (None, None, "lot", None), (None, None, "lot", None)]
    note = "Conservative (thin): $40\nRecommended price is $9\n**Recommended**: $55.50\nPush-high $1,070\n=== END\nConservative: $1"
    r = spark.createDataFrame([(note,)], "t string").select(runs.extract_tiers(F.col("t")).alias("x")).select("x.*").first()
    assert [str(x) for x in r] == ["40.00", "55.50", "1070.00"]


def test_comp_runs(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"run_id": "a", "exact_match": {"condition_cohort": "used"},\n "comps": [{"title": "x", "sold_price": 5, "total_price": 7.5, "condition": "New"}, {"title": "n"}, {"title": "y", "sold_price": 4.25}]}')
    got = [(x.title, x.price, x.fell_back, x.is_row0, x.cohort) for x in runs.read_comp_runs(spark, str(tmp_path), "price_high", "total").collect()]
    assert sorted(got) == [("x", 7.5, False, True, "new"), ("y", 4.25, True, False, "used")]


def test_ad_reports(spark, tmp_path):
    (tmp_path / "a.csv").write_text('My report\n\nCampaign ID,Title,Total impressions,Impressions,Ad fees,Other\n7,"Lamp, oil","1,200",9,$3.50,x\n')
    (tmp_path / "b.tsv").write_text("Campaign ID\tListing ID\tSales\n8\t55\tUSD 28.00\n")
    got = sorted((x.campaign_id, x.title, x.listing_id, x.impressions, x.ad_fees, x.sales) for x in runs.read_ad_report(spark, str(tmp_path)).collect())
    assert got == [("7", "Lamp, oil", None, 1200.0, 3.5, 0.0), ("8", None, "55", 0.0, 0.0, 28.0)]


def test_rows_of_vendors_headers_and_threads(spark):
    raw = spark.createDataFrame([('{"itemId":"v1|123456789012|0","title":"a","price":{"value":"5.00"},"shippingOptions":[{"shippingCost":{"value":"1.50"}}],"seller":{"username":"s"}}',), ('{"itemId":"v1|223456789012|0","price":{"value":"5.00"}}',)], "json string")
    assert [(x.item_id, x.delivered and str(x.delivered)) for x in runs.normalize_active(raw).collect()] == [("123456789012", "6.50"), ("223456789012", None)]
    doc = spark.createDataFrame([("---\nsku: A1\nmeta:\n  price: '12'\n---\nsku: no\n",), ("no head",)], "value string")
    assert [(x.sku, x.price) for x in runs.scan_headers(doc, ["sku", "price"]).collect()] == [("A1", "12"), (None, None)]
    page = spark.createDataFrame([(1, "<article data-author='bo'>One<br>two</article><p>x</p><article>Three</article>")], "thread int, html string")
    assert [(x.i, x.author, x.text) for x in runs.parse_threads(page).collect()] == [(0, "bo", "One\ntwo"), (1, None, "Three")]


def test_copy_rules(spark):
    docs = spark.createDataFrame([(1, "Nice lamp. Best ever! Best ever!\nsmoke-free home\n=== END\nBest ever."), (2, None)], "doc_id int, body string")
    got = sorted((x.doc_id, x.level, x.snippet, x.why) for x in copy.lint_copy(docs, ["body"], [("best ever", "boast")], [("nice", "weak"), ("smoke", "smell")], ["smoke-free"]).collect())
    assert got == [(1, "BLOCK", "Best ever!", "boast"), (1, "WARN", "Nice lamp.", "weak")]
    spark.udtf.register("explode_sentences", copy.ExplodeSentences)
    assert [tuple(r) for r in spark.sql("SELECT * FROM explode_sentences('One. Two!\nThree')").collect()] == [(0, "One."), (1, "Two!"), (2, "Three")]
    notes = spark.createDataFrame([("a", "smell", "smoke"), ("a/b", "smell", "none"), ("a", "owner", "x")], "bucket string, key string, value string")
    items = spark.createDataFrame([(1, "a/b/c"), (2, "a")], "item int, p string")
    assert sorted((x.item, x.key, x.value) for x in copy.inherited_notes(items, notes, "p").collect()) == [(1, "owner", "x"), (1, "smell", "none"), (2, "owner", "x"), (2, "smell", "smoke")]
    rules = [("smoke", "smoke", ["smoke-free", "no smoke"])]
    docs = spark.createDataFrame([(1, "a\nfrom a Smoke-Free home"), (2, "from a smoke-free home"), (3, "fine")], "item int, text string")
    context = spark.createDataFrame([(1, "they smoke a lot"), (2, "a smoke-free home"), (3, "smoke")], "item int, text string")
    assert [tuple(x) for x in copy.contradictions(docs, context, rules).select("item", "rule", "phrase", "line").collect()] == [(1, "smoke", "smoke-free", 2)]


def test_events_and_states(spark):
    day = datetime.date(2020, 1, 1)
    owned = matching.owned_by(spark.createDataFrame([(1, "a", "s1", "l1"), (2, "b", "s2", "l2"), (3, None, None, None)], "id int, store string, sku string, listing_id string"), spark.createDataFrame([("x", "a", None, None), ("y", None, "s1", None), ("y", None, None, "l2")], "owner string, store string, sku string, listing_id string"))
    assert sorted(map(tuple, owned.collect())) == [(1, "x"), (1, "y"), (2, "y")]
    fees = spark.createDataFrame([("NON_SALE_CHARGE", "o1", None, None, "Promoted ad", None, "3.00", ["a", "b"]), ("SHIPPING_LABEL", "", "o2", None, None, None, "4.00", ["a"]), ("TRANSFER", "o3", None, None, None, None, "1.00", ["a"])], "transaction_type string, order_id string, ref_order_id string, fee_type string, memo string, booking string, amount string, skus array<string>").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = sorted((x.kind, x.order_id, x.sku, str(abs(x.amount))) for x in money.split_transactions(fees).collect())
    assert got == [("AD", "o1", "a", "1.50"), ("AD", "o1", "b", "1.50"), ("POSTAGE", "o2", "a", "4.00")] and day


def test_comp_runs_hold_no_run_whole(spark):
    plan = plans.QUERIES["s1_comp_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
