"""Streams give what their batch twins give, over events split into files; readers over small files."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import selection as K
from tallyforge.sources import pages
from tallyforge.streaming import streams as X

SCHEMA = "event_id long, ts timestamp, session long, kind string, value double"


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """Events in files in order of time, and one late far-off event that closes all windows."""
    folder = str(tmp_path_factory.mktemp("events"))
    e = spark.range(400).select(F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 200 + F.when(F.col("id") % 7 == 0, 150).otherwise(0))).alias("ts"), (F.col("id") % 3).alias("session"), F.when(F.col("id") % 2 == 0, "call").otherwise("result").alias("kind"), (F.col("id") % 50).cast("double").alias("value"))
    e.where("event_id < 200").coalesce(1).write.mode("append").parquet(folder)
    e.where("event_id >= 200").coalesce(1).write.mode("append").parquet(folder)
    return folder


def streamed(spark, folder, make, tmp_path, mode="append"):
    """Rows of a stream over the files, one file a batch."""
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    q = make(s).writeStream.format("memory").queryName("got").outputMode(mode).option("checkpointLocation", out).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table("got").collect()


@pytest.fixture(scope="module")
def closed(spark, split):
    """The folder with an event ninety days on, in its last file."""
    spark.sql("SELECT 999999L AS event_id, timestamp_seconds(1707900000) AS ts, 9L AS session, 'end' AS kind, 0D AS value").coalesce(1).write.mode("append").parquet(split)
    return split


def batch(spark, folder):
    return spark.read.schema(SCHEMA).parquet(folder)


def test_once(spark, closed, tmp_path):
    got = streamed(spark, closed, lambda s: X.once(s, "event_id"), tmp_path)
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in X.once(batch(spark, closed), "event_id").collect())


def test_activity(spark, closed, tmp_path):
    got = streamed(spark, closed, X.activity, tmp_path)
    want = X.activity(batch(spark, closed)).where("session <> 9").collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_daily(spark, closed, tmp_path):
    value = F.col("value").cast("decimal(18,2)")
    got = streamed(spark, closed, lambda s: X.daily(s, value), tmp_path)
    got = X.add_up(spark.createDataFrame(got, "day date, n long, total decimal(28,2)")).collect()
    want = X.add_up(X.daily(batch(spark, closed).where("session <> 9"), value)).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_sliding(spark, closed, tmp_path):
    make = lambda s: X.sliding_rate(s, F.col("value") > 10, "6 hours", "1 hour")
    got = streamed(spark, closed, make, tmp_path)
    want = make(batch(spark, closed).where("session <> 9")).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_pairs(spark, closed, tmp_path):
    make = lambda s: X.pair_results(s.where("kind = 'call'"), s.where("kind = 'result'"), "session", "20 minutes")
    got = streamed(spark, closed, make, tmp_path)
    want = make(batch(spark, closed)).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_price_levels(spark, closed, tmp_path):
    got = streamed(spark, closed, lambda s: X.price_levels(s, "session", "value"), tmp_path, "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, X.price_levels(batch(spark, closed), "session", "value").collect()))


def test_show_holds(spark, closed, tmp_path):
    windows = spark.sql("SELECT 'a' AS show, timestamp_seconds(1700020000) AS start, timestamp_seconds(1700030000) AS close UNION ALL SELECT 'b', timestamp_seconds(1700025000), timestamp_seconds(1700050000)")
    make = lambda s: X.show_holds(s.select(F.col("event_id").alias("order_id"), "ts"), windows, "1 hour")
    want = make(batch(spark, closed)).collect()
    assert {r.show for r in want} == {"a", "b"} and sorted(map(tuple, streamed(spark, closed, make, tmp_path))) == sorted(map(tuple, want))


def test_lifecycle(spark, closed, tmp_path):
    status = F.element_at(F.array(*map(F.lit, ["DRAFTED", "PUBLISHED", "SYNCED", "ENDED"])), (F.col("value") % 4 + 1).cast("int"))
    make = lambda s: X.lifecycle(s.select(F.col("session").alias("sku"), F.col("event_id").alias("pos"), status.alias("status")))
    want = {r.sku: (r.status, r.breaks) for r in make(batch(spark, closed)).collect()}
    got = {}
    for r in streamed(spark, closed, make, tmp_path, "update"):
        got[r.sku] = max(got.get(r.sku, (r.breaks, "")), (r.breaks, r.status))
    assert {k: (s, b) for k, (b, s) in got.items()} == want


def test_upsert_sink(spark, tmp_path):
    folder = str(tmp_path / "table")
    write = X.upsert_to(folder, ["k"], optional=("b",))
    rows = lambda *r: spark.createDataFrame(r, "k int, ts int, a string, b string")
    write(rows((1, 1, "x", "p"), (1, 2, "y", "q"), (2, 1, "z", None)), 0)
    for _ in range(2):  # a repeated batch changes nothing
        write(rows((1, 3, "w", None), (3, 1, "n", "o")), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/batch=1").collect())) == [(1, 3, "w", "q"), (2, 1, "z", None), (3, 1, "n", "o")]


def test_readers(spark, tmp_path):
    ledger = tmp_path / "ledger" / "store=a"
    ledger.mkdir(parents=True)
    (ledger / "x.csv").write_text("sku,price\ns1,2.50\ns2,\n")
    d = pages.read_ledger(spark, str(tmp_path / "ledger"), "sku string, price decimal(18,2), store string", sku="s1")
    assert [(r.sku, str(r.price), r.store) for r in d.collect()] == [("s1", "2.50", "a")]
    with pytest.raises(ValueError):
        pages.read_ledger(spark, str(tmp_path / "ledger"), "sku string, price decimal(18,2)", nosuch="1")
    lines = tmp_path / "t.jsonl"
    lines.write_text('{"type":"user","isSidechain":false}\n{"type":"user","isSidechain":true}\nnot json\n{"type":"' + "x" * 200 + '"}\n')
    rows, counters = pages.read_transcripts(spark, str(lines), "type string, isSidechain boolean", longest=100)
    assert [r.type for r in rows.collect()] == ["user"]
    assert tuple(counters.first()) == (1, 1)


def test_html(spark):
    page = "<html><style>b{}</style><!-- no --><p>One &amp; two</p><script>x<y</script><div>three<br>four</div>"
    d = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(pages.html_to_text(F.col("h")).alias("t"))
    assert [r.t for r in d.collect()] == ["One & two\nthree\nfour", None, ""]


def test_status_fold(spark):
    seq = {1: ["DRAFTED", "PUBLISHED", "SYNCED"], 2: ["PUBLISHED", "ENDED", "SYNCED"], 3: ["SYNCED", "DRAFTED"], 4: ["DRAFTED"], 5: ["PUBLISHED", "ENDED", "DRAFTED"]}
    e = spark.createDataFrame([(k, i, i, s) for k, v in seq.items() for i, s in enumerate(v)], "sku int, pos int, ts int, status string")
    assert {r.sku: r.status for r in K.advance_status(e).collect()} == {1: "PUBLISHED", 2: "SYNCED", 3: "SYNCED", 4: "DRAFTED", 5: "ENDED"}
