"""Steps whose work or memory must not grow faster than their input."""

import datetime
import hashlib
import itertools
import random
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.functions.scalars import share_in_cents
from tallyforge.operators import matching
from tallyforge.operators.chains import GENESIS
from tallyforge.plans import chains
from tallyforge.sources.runs import normalize_sold


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hashes_follow_one_another_over_batches():
    t = pa.table({"chain": list("aaabb"), "front": list("12345"), "back": list("vwxyz")})
    got = pa.Table.from_batches(list(chains._hashed(iter(t.to_batches(max_chunksize=2))))).to_pylist()
    before, last = GENESIS, None
    for r in got:
        before = before if r["chain"] == last else GENESIS
        assert r["prev"] == before
        before, last = hashlib.sha256((r["front"] + before + r["back"]).encode()).hexdigest(), r["chain"]
        assert r["hash"] == before


def test_shares_of_large_orders_are_exact_and_go_by_doubles(spark):
    rows = [(Decimal(t), Decimal(p), Decimal(w)) for t, p, w in (("91000.13", "104999.99", "700000.01"), ("0.01", "1.00", "2.00"), ("0.03", "1.00", "2.00"), ("40000000.05", "300000.00", "900000.00"), ("900000000000.01", "7.77", "12345678901.23"))]
    d = spark.createDataFrame(rows, "t decimal(18,2), p decimal(18,2), w decimal(18,2)").select("t", "p", "w", share_in_cents(F.col("t"), F.col("p"), F.col("w")).alias("s"))
    assert all(r["s"] == (r["t"] * r["p"] / r["w"]).quantize(Decimal("0.01"), "ROUND_HALF_EVEN") for r in d.collect())
    assert "round(" not in optimized(d).lower()


def test_sold_rows_are_parsed_once(spark):
    raw = spark.createDataFrame([('{"price":"5.00","title":"a"}',), ('{"price":"x","title":"a"}',), ("no json",), (None,)], "json string")
    d = normalize_sold(raw)
    assert [(r["title"], r["sold_price"]) for r in d.collect()] == [("a", Decimal("5.00"))]
    assert optimized(d).count("from_json") == 1


def test_overlaps_hold_open_windows_only(monkeypatch):
    r = random.Random(3)
    rows = sorted((r.randint(0, 7000) * 1_000_000, r.randint(0, 90) * 1_000_000, i, r.randint(1, 3)) for i in range(400))
    spans = [(i, by, s, n, s // 3_600_000_000) for s, n, i, by in rows] + [(i, by, s, n, 1) for s, n, i, by in rows if s < 3_600_000_000 <= s + n]
    t = pa.table(dict(zip(("id", "by", "start", "length", "h"), map(list, zip(*sorted(spans, key=lambda x: (x[4], x[2])), strict=True)), strict=True)))
    sizes, pairs = [], matching._later_pairs
    monkeypatch.setattr(matching, "PAIRS", 7)
    monkeypatch.setattr(matching, "_later_pairs", lambda d, first: sizes.append(d.num_rows) or pairs(d, first))
    got = [(x["a"], x["b"]) for b in matching._sweep(iter(t.to_batches(max_chunksize=20)), 3600) for x in b.to_pylist()]
    want = {(min(a[2], b[2]), max(a[2], b[2])) for a, b in itertools.combinations(rows, 2) if a[3] != b[3] and a[0] < b[0] + b[1] and b[0] < a[0] + a[1]}
    assert len(got) == len(set(got)) and set(got) == want and max(sizes) < 60


def test_overlaps_shuffle_starts_and_lengths_once(spark):
    day = datetime.datetime(2001, 1, 1)
    d = spark.range(2160).select(F.col("id"), (F.col("id") % 5).alias("by"), (F.lit(day) + F.make_dt_interval(mins=F.col("id") * 20)).alias("start"))
    found = matching.overlaps(d.withColumn("close", F.col("start") + F.expr("interval 20 minutes")), "by")
    assert found.count() == 0
    dealt = found._jdf.queryExecution().optimizedPlan()
    while "Repartition" not in dealt.nodeName():
        dealt = dealt.children().head()
    fields = [dealt.output().apply(i).name() for i in range(dealt.output().size())]
    shuffled = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, dealt.children().head()).count()
    assert fields == ["id", "by", "start", "length", "h"] and shuffled < 2160 * 1.2
