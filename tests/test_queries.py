"""Every query with SQL against DuckDB on the small tables, and hand cases of the scalar rules."""

import datetime
import decimal
import itertools
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge import plans
from tallyforge.functions import scalars as S
from tallyforge.functions.sql import register_all
from tallyforge.operators import matching, money, sessions

DATA = "/root/testdata/sf0.001"


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v.normalize() + 0) if isinstance(v, decimal.Decimal) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        p = f"{DATA}/{f}"
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = plans.QUERIES[name](spark, DATA)
    cur = db.execute(plans.ORACLE[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(cell(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(cell(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_titles(spark):
    multi = {"Lot of 9 Stamps": True, "Tin Toys 12x": True, "Frame 8\" x 5\" oak": False, "Chess Game Set": False, "1930's Radio No 2041": False, "Almanac 1921 1922": True}
    pair = {"Pearl Hoops": True, "Bracelet and Earrings": False, "Pair of Iron Firedogs": True, "4 Pairs Sets Hoops": False, "Single Cufflink": False, "Teapot": False}
    for cases, rule in ((multi, S.looks_multi_item), (pair, S.looks_pair_unit)):
        got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", rule(F.col("t")).alias("x")).collect()
        assert {r.t: r.x for r in got} == cases


def test_prices(spark):
    d = spark.createDataFrame([(34.99, "100.00", "60.00"), (34.40, "61.00", "60.00")], "p double, cur string, rec string")
    r = d.select(S.whole_dollar(F.col("p")).alias("w"), S.charm_ending(F.col("p")).alias("e"), S.cut_price(F.col("cur").cast(S.Money), F.col("rec").cast(S.Money)).alias("cut")).collect()
    assert [(x.w, x.e, x.cut) for x in r] == [(35.0, ".99", decimal.Decimal("86.00")), (34.0, "other", None)]


def test_allocation_adds_up(spark):
    d = spark.createDataFrame([(1, i, "10.00", w) for i, w in enumerate((1, 1, 1))] + [(2, 0, "0.05", 0), (2, 1, "0.05", 0), (3, 0, None, 5)], "o int, pos int, total string, w int")
    rows = money.allocate(d, ["o"], "total", "w", "share", ["pos"]).collect()
    assert sorted((r.o, r.pos, str(r.share)) for r in rows) == [(1, 0, "3.33"), (1, 1, "3.33"), (1, 2, "3.34"), (2, 0, "0.02"), (2, 1, "0.03"), (3, 0, "None")]


def test_sql_names(spark):
    register_all(spark)
    assert spark.sql("SELECT title_key('A--b!') AS k, charm_ending(9.99D) AS e").first() == ("a b", ".99")


def test_overlaps_and_last_changes_take_all_rows(spark, tmp_path):
    r = random.Random(4)
    day = datetime.datetime(2001, 1, 1)
    events = [(i, r.randint(1, 5), day + datetime.timedelta(seconds=r.randint(0, 6 * 3600))) for i in range(60)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    near = datetime.timedelta(minutes=20)
    want = {(a[0], b[0]) for a, b in itertools.combinations(events, 2) if a[1] != b[1] and abs(a[2] - b[2]) < near}
    got = [tuple(x) for x in plans.QUERIES["j10_overlaps_all"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(a % 5 or b % 5 for a, b in want)

    spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 1)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 1, day), (1, 3, day + datetime.timedelta(days=9)), (2, 2, day), (4, 5, day)]
    spark.createDataFrame(lines, "l_partkey long, l_linenumber int, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {x.sku: (str(x["last"]), x.source) for x in plans.QUERIES["j8_last_change_all"](spark, str(tmp_path)).collect()}
    assert got == {1: ("2001-01-10", "log"), 2: ("2001-01-01", "log"), 3: ("None", None), 4: ("2001-01-01", "log")}


def test_deep_trees_are_not_cut(spark):
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d")], "id int, parent int, name string")
    assert {r.id: r.path for r in matching.flatten_tree(nodes).collect()} == {1: "a", 2: "a > b", 3: "a > b > c", 4: "a > b > c > d"}


def test_overlaps_of_all_lengths_meet_by_sweep(spark, monkeypatch):
    monkeypatch.setattr(matching, "PAIRS", 7)
    r = random.Random(8)
    day = datetime.datetime(2001, 1, 1)
    after = lambda s: day + datetime.timedelta(seconds=s)
    spans = [(i, r.choice("xyz"), s, s + r.choice([0, 60, 1200, 9000])) for i in range(80) for s in [60 * r.randint(0, 300)]]
    d = spark.createDataFrame([(i, by, after(s), after(e)) for i, by, s, e in spans] + [(900, None, day, after(99)), (None, "x", day, after(99))], "id long, by string, start timestamp, close timestamp")
    found = matching.overlaps(d, "by")
    got = [tuple(x) for x in found.collect()]
    want = {(a[0], b[0]) for a, b in itertools.combinations(spans, 2) if a[1] != b[1] and a[2] < b[3] and b[2] < a[3]}
    assert len(got) == len(set(got)) and set(got) == want and "Join" not in found._jdf.queryExecution().executedPlan().toString()
