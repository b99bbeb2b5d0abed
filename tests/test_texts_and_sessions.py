"""Edge cases of listing texts, asks, economics and price changes."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import asks, economics, listing_text, matching


def test_quantities_in_one_unit(spark):
    rows = {'7 1/2 in': 190.5, "3/4\"": 19.05, "2.5 cm": 25.0, "12mm wide": 12.0, "7 inches, 3 mm": 177.8, "7": None, "": None, None: None, "5 grams": None, "1/0 in": None}
    d = spark.createDataFrame([(k,) for k in rows], "v string")
    got = {r.v: r.q for r in d.select("v", listing_text.quantity(F.col("v"), listing_text.SIZE_UNIT).alias("q")).collect()}
    assert {k: v and round(v, 3) for k, v in got.items()} == rows
    assert d.where("v = '5 grams'").select(listing_text.quantity(F.col("v"), listing_text.WEIGHT_UNIT)).first()[0] == 5.0


def test_empty_texts(spark):
    d = spark.createDataFrame([(None, None), ("", "")], "title string, body string")
    assert listing_text.slots(d, {"a": ["x"]}).collect() == [] == listing_text.skeleton(d).collect()


def test_asks_before_the_first_prompt_and_ties_of_stages(spark):
    at = datetime.datetime(2020, 1, 1)
    rows = [("s", at, 1, "buy look", 1), ("s", at, 2, None, 2), ("s", at, 3, "prompt look look", None), ("t", at, 4, "prompt nothing", 4)]
    d = spark.createDataFrame(rows, "session string, ts timestamp, event_id long, text string, tokens long")
    got = asks.asks(d, {"BUY": ["buy"], "LOOK": ["look"]}, F.coalesce(F.col("text").startswith("prompt"), F.lit(False)))
    assert sorted(map(tuple, got.select("session", "segment", "turns", "tokens", "stage").collect())) == [("s", 0, 2, 3, "BUY"), ("s", 1, 0, None, "LOOK"), ("t", 1, 0, 4, "OTHER")]


def test_sweep_of_edges_nulls_and_no_rows(spark):
    d = spark.createDataFrame([(1.0, 1), (2.0, 0), (2.0, 1), (float("nan"), 1), (None, 0)], "s double, y int")
    got = {r.threshold: (r.kept, r.right_kept, r.wrong_kept) for r in asks.threshold_sweep(d, "s", "y", [3, 2, 1, 1.5, 2]).collect()}
    assert got == {1.0: (3, 2, 1), 1.5: (2, 1, 1), 2.0: (2, 1, 1), 3.0: (0, 0, 0)}
    assert {r.threshold: (r.kept, r.agree) for r in asks.threshold_sweep(d.limit(0), "s", "y", [1]).collect()} == {1.0: (0, None)}


def test_a_result_takes_the_last_call_of_its_id(spark):
    at = lambda s: datetime.datetime(2020, 1, 1, 0, 0, s)
    rows = [(1, "a", "call", "x", 0), (2, "a", "call", "y", 5), (3, "a", "result", None, 9), (4, "a", "result", None, 12), (5, None, "result", None, 13), (6, "b", "result", None, 14)]
    d = spark.createDataFrame([("s", at(t), i, c, k, n, False) for i, c, k, n, t in rows], "session string, ts timestamp, event_id long, call_id string, type string, name string, background boolean")
    assert [(r["name"], r["seconds"]) for r in economics.paired_calls(d).collect()] == [("y", 4.0)]


def test_waits_over_hours(spark):
    at = lambda h, m=0: datetime.datetime(2020, 1, 1, h, m)
    schema = "session string, {} started timestamp, ended timestamp"
    gates = spark.createDataFrame([("s", at(0, 30), at(3, 30)), ("s", at(5), at(6))], schema.format(""))
    turns = spark.createDataFrame([("s", 1, at(1), at(4)), ("s", 2, at(3, 30), at(5)), ("s", 3, at(0), at(9)), ("t", 4, at(0), at(9))], schema.format("turn int,"))
    assert {r.turn: r.waited for r in economics.waits(gates, turns).collect()} == {1: 9000.0, 3: 14400.0}


def test_rates_of_the_longest_prefix(spark):
    calls = spark.createDataFrame([("m-5-5-x",), ("m-5",), ("other",), (None,), ("",)], "model string")
    rates = spark.createDataFrame([("m-5", 5.0, 25.0, None), ("m-5-5", 4.0, 20.0, 0.05)], "prefix string, rate_in double, rate_out double, read double")
    got = {r.model: (r.rate_in, r.rate_out, round(r.rate_read, 3)) for r in economics.with_rates(calls, rates, (3.0, 15.0)).collect()}
    assert got == {"m-5-5-x": (4.0, 20.0, 0.2), "m-5": (5.0, 25.0, 0.5), "other": (3.0, 15.0, 0.3), None: (3.0, 15.0, 0.3), "": (3.0, 15.0, 0.3)}


@pytest.mark.parametrize("store,want", [("a", ("2020-01-03", "later")), ("b", ("2020-01-05", "log")), ("", ("2020-01-05", "log"))])
def test_changes_by_sku_item_and_store(spark, store, want):
    day = lambda n: datetime.date(2020, 1, n)
    log = [("s", None, "a", day(3), 1, "first"), (None, "i", "", day(3), 2, "later"), ("s", "", "b", day(5), 3, ""), ("", "", "a", day(9), 4, "x"), ("s", None, None, None, 5, "x")]
    d = matching.listing_changes(spark.createDataFrame([(1, "s", "i", store, day(2)), (2, "", "", store, day(7)), (3, "s", None, store, day(8))], "listing int, sku string, item_id string, store string, start date"), spark.createDataFrame(log, "sku string, item_id string, store string, date date, pos int, source string"))
    got = {r.listing: (str(r["last"]), r.source) for r in d.collect()}
    assert got == {1: want, 2: ("2020-01-07", "listed"), 3: ("2020-01-08", "listed")}
