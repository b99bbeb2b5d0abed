"""Quotes and ambiguous agreement against a plain tally, opt-outs by hand."""

import random

from pyspark.sql import functions as F

from tallyforge.operators import replies as R

POST = "thread int, i int, author string, maker string, agrees boolean, text string"


def test_replies_match_a_plain_tally(spark):
    r = random.Random(8)
    rows = [(t, i, r.choice("uv"), r.choice([None, None, "A", "B", "C"]), r.random() < 0.5, r.choice(["", "yes", "x" * r.randint(80, 100), "y" * r.randint(1, 40), "z" * 90])) for t in range(60) for i in range(r.randint(0, 14))]
    quote, flags = {}, {}
    for t in range(60):
        lead, since = None, []
        for _, i, author, maker, agrees, text in (x for x in rows if x[0] == t):
            if maker:
                if len(text) > len(quote.setdefault((t, maker), "")):
                    quote[t, maker] = text[:90]
                lead = maker
                since.append(maker)
            elif agrees and lead:
                if len(set(since)) > 1:
                    flags[t, i] = (author, sorted(set(since)))
                since = [lead]
    d = spark.createDataFrame(rows, POST)
    assert {(x.thread, x.maker): x.quote for x in R.quotes(d).collect()} == quote
    assert {(x.thread, x.i): (x.author, x.makers) for x in R.ambiguous_agreements(d).collect()} == flags and flags
    assert R.ambiguous_agreements(d.limit(0)).count() == 0


def test_kept_out(spark):
    texts = {"1": "---\ntitle: x\nPromoted: 'Off'  # mine\n---\n", "2": "---\r\npromoted: none\r\n---\r\n", "3": "---\npromoted: 5\n---\npromoted: false", "4": None, "5": "promoted: false"}
    drafts = spark.createDataFrame([(k, "None" if k == "2" else f"s{k}", v) for k, v in texts.items()], "listing_id string, sku string, text string")
    assert {r.key for r in R.opted_out(drafts).collect()} == {"1", "s1", "2"}
    live = spark.createDataFrame([("1", "a", 5.0, 1), ("9", "s1", 5.0, 1), ("8", "c", 5.0, 1), ("7", None, 100.0, 9), ("6", "d", 100.01, 9), ("5", "e", 100.01, 10), ("4", "f", 500.0, None), ("3", "g", None, None), (None, None, 1.0, 1)], "listing_id string, sku string, price double, age_days int")
    consigned = spark.createDataFrame([("c",), ("c",), (None,), ("1",)], "key string")
    got = {r.listing_id: r.reason for r in R.kept_out(live, drafts, consigned, 100.0, 10).collect()}
    assert got == {"1": "opted out", "9": "opted out", "8": "consigned", "6": "young", "4": "young"}
    assert live.where(R.price_is_young(F.col("price"), F.col("age_days"), None, 10)).count() == 0
