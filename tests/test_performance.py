"""Hand cases of sales reports, price evidence, sold rows and accepted offers."""

import json
from decimal import Decimal as D

from tallyforge.operators import comps, performance
from tallyforge.operators.price_evidence import price_evidence_issues
from tallyforge.sources.runs import normalize_sold

SALES = "gross decimal(18,2), fee decimal(18,2), net decimal(18,2), asked decimal(18,2), listed_at date, sold_at date, matched boolean, kind string"


def sale(spark, rows):
    d = spark.createDataFrame([(*[None if x is None else D(x) for x in r[:4]], *r[4:]) for r in rows], SALES.replace(" date", " string"))
    return d.withColumn("listed_at", d.listed_at.cast("date")).withColumn("sold_at", d.sold_at.cast("date"))


def test_performance_sections_and_flags(spark):
    rows = [("20", "3", "17", "20", "2024-01-01", "2024-01-03", True, "toys")] * 4 + [("60", "9", "51", "100", "2024-01-09", "2024-01-03", False, "lamps")] * 5
    rows += [("0", "0", "0", "50", None, "2024-01-05", None, None), (None, None, None, None, None, None, True, "toys")]
    report = performance.performance(sale(spark, rows), [25, 75, 200])
    r = {(x.section, x.label): x for x in report.collect()}
    top = r["all", None]
    assert (top.n, top.gross, top.fee_bp, top.with_ask, top.full_ask, top.aged, top.fast, top.fast_full) == (11, D("380.00"), 1500, 9, 4, 4, 4, 4)
    assert r["kind", "lamps"].mid_ask_bp == 6000 and r["kind", "other"].n == 1 and ("fee_band", None) not in r
    assert r["matched", "false"].share_bp == 300 * 10000 // 380 and {k for k in r if k[0] == "ask_band"} == {("ask_band", "25"), ("ask_band", "200")}
    flags = {(x.flag, x.label) for x in performance.performance_flags(report).collect()}
    assert flags == {("fees", None), ("raise", "toys"), ("soft", "lamps"), ("never_full", "200")}
    assert performance.performance(sale(spark, []), [25]).count() == 0


def test_store_facts(spark):
    rows = [("10", "9", "1", "2", "10", "2024-01-02", "inventory\\Clocks\\wall\\a", True), ("10", "9", None, "2", "20", "2024-02-02", "Clocks/wall", None), ("10", "8", "1", "1", None, "2024-02-03", None, False)]
    names = ["gross", "net", "ad_fee", "postage", "asked"]
    d = spark.createDataFrame([(*[None if x is None else D(x) for x in r[:5]], *r[5:]) for r in rows], ", ".join(f"{n} decimal(18,2)" for n in names) + ", sold_at string, folder string, promoted boolean")
    r = {(x.section, x.label): x for x in performance.store_facts(d.withColumn("sold_at", d.sold_at.cast("date"))).collect()}
    assert set(r) == {("all", None), ("month", "2024-01"), ("month", "2024-02"), ("collection", "Clocks/wall"), ("collection", "untracked"), ("promoted", "true"), ("promoted", "false")}
    assert r["all", None].net_after is None and r["all", None].ad_fees == 2 and r["all", None].ask_bp == 7500 and r["all", None].tracked == 2
    assert r["month", "2024-01"].net_after == 6 and r["collection", "untracked"].net_after == 6
    through = performance.sell_through(d, spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "listing_id string")).first()
    assert (through.sold, through.live, through.sold_bp) == (3, 2, 6000)


def test_price_evidence(spark):
    ran, thin = "Log\r\nB · Browser : RAN 4 pages\r\n   n_kept=3\r\n", "B · Browser: THIN\n"
    one = "ONE-OFF: historian Lenz, 1920s · judgment $40 · push-high $90\n"
    cases = {  # sku: (listing, note, saved, format, best offer, price, issues)
        "listed": ("123456789", None, False, None, None, None, []), "none": (" ", None, True, None, True, "9", ["no_note"]), "own": (None, "x\n OPERATOR PRICE: $4", False, None, True, "4", []), "own_blank": (None, "OPERATOR PRICE:", False, None, True, "4", ["no_pull_line"]),
        "ran": (None, ran, True, None, False, "4", []), "unproven": (None, ran, None, None, False, "4", ["no_sold_rows"]), "proven": (None, ran, False, None, False, "4", []), "asks": (None, ran, False, None, False, "4", ["no_sold_rows"]),
        "other_block": (None, "B · Browser : RAN\n C · Chrome : n_kept = 0\n", True, None, False, "4", []), "zero": (None, "B · Browser : RAN\n  n_kept = 0\n", True, None, False, "4", ["no_one_off"]), "ten": (None, "B · Browser : RAN n_kept = 05", True, None, False, "4", []),
        "thin": (None, thin + one, None, None, True, "90", []), "low": (None, thin + one, None, "FIXED_PRICE", False, "89.99", ["no_best_offer", "below_push_high"]), "unpriced": (None, thin + one, None, None, True, None, ["below_push_high"]), "auction": (None, thin + one, None, "auction", False, "1", []),
        "nobody": (None, thin + "ONE-OFF: historian · push-high $9", None, "AUCTION", True, "9", ["no_historian"]), "no_push": (None, thin + "ONE-OFF: Historian Lenz", None, None, True, "9", ["no_push_high"]), "skipped": (None, "B · Browser : SKIPPED", True, None, True, "9", ["not_pulled"]), "blank": (None, "B · Browser :", True, None, True, "9", ["not_pulled"]),
    }
    d = spark.createDataFrame([(k, *v[:5], None if v[5] is None else D(v[5])) for k, v in cases.items()], "sku string, listing_id string, note string, saved boolean, format string, best_offer boolean, price decimal(18,2)")
    c = spark.createDataFrame([("proven", " b ", "https://x.example/1", "Auction", None), ("proven", "C", "https://x.example/1", None, None), ("asks", "B", "https://x.example/2", "Active", None), ("asks", "B", " ", None, None), ("asks", "A", "https://x.example/2", None, None), ("asks", "C", "u", None, "ASKING")], "sku string, stage string, url string, listing_type string, note string")
    assert {r.sku: r.issues for r in price_evidence_issues(d, c).collect()} == {k: v[6] for k, v in cases.items()}


def test_sold_rows(spark):
    rows = [{"price": 5, "title": "a", "item_id": 123456789012, "shipping_cost": 0, "format": "auction", "last_sold": "2024-03-01T10:00:00Z", "best_offer": None}, {"price": "7.25", "title": "b", "shipping_cost": None, "best_offer": True, "format": "FIXED_PRICE"}, {"price": "x", "title": "c"}, {"price": 3, "title": ""}, {"title": "d"}, {"price": 1, "title": "e", "shipping_cost": 2.5, "format": "other"}]
    got = {r.title: r for r in normalize_sold(spark.createDataFrame([(json.dumps(r),) for r in rows], "json string")).collect()}
    assert set(got) == {"a", "b", "e"} and got["a"].item_id == "123456789012" and str(got["a"].sold_date) == "2024-03-01"
    assert [(got[t].total_price, got[t].shipping_type, got[t].listing_type, got[t].bo_accepted) for t in "abe"] == [(D("5.00"), "free", "Auction", False), (None, None, "Best Offer", True), (D("3.50"), None, None, False)]


def test_accepted_offers_apart(spark):
    a = spark.createDataFrame([("q", "1", 10.0, False), ("q", "2", 10.0, True), ("q", "3", 10.0, True), ("q", "4", None, None), ("q", None, 1.0, False), ("q", "5", 3.0, False)], "query string, item_id string, price double, bo_accepted boolean")
    b = spark.createDataFrame([("q", "1", 10.004, False), ("q", "2", 8.0, True), ("q", "3", 10.0, None), ("q", "4", 2.0, False), ("q", None, 1.0, False)], "query string, item_id string, price double, bo_accepted boolean")
    assert [tuple(r) for r in comps.compare_offers(a, b, ["query"]).collect()] == [("q", 4, 1, 1, 2, 1, 1)]
