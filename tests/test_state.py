"""Streams with typed state against their batch twins: split files, restarts, events out of order, repeats, timers."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import chains
from tallyforge.sources.chains import read_chains
from tallyforge.streaming import state
from test_chains import STEPS, R, log, setter


@pytest.fixture(scope="module", autouse=True)
def typed(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_typed_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def streamed(spark, make, schema, parts, tmp_path):
    """Rows that a stream gives, started anew for each part of its input."""
    src = tmp_path / "in"
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(src))
        # With timers by the clock, availableNow would wait for the next one for ever.
        q = make(spark.readStream.schema(schema).parquet(str(src))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(once=True)
        rows = []
        q.foreachBatch(lambda d, n, rows=rows: rows.extend(d.collect())).start().awaitTermination(120)
        yield i, rows


def test_chains_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    logs = {
        "good": log("good", STEPS), "seq": log("seq", STEPS, setter(2, seq=7)), "key": log("key", STEPS, setter(1, key="other")), "twice": log("twice", STEPS, setter(3, kind="genesis")),
        "absent": log("absent", [*STEPS[:2], ([], [R[0], R[0]])]), "state": log("state", STEPS, setter(3, state="0" * 64)), "cut": log("cut", STEPS)[:1] + log("cut", STEPS)[2:],
    }
    edited = log("edited", STEPS)
    logs["edited"] = [*edited[:2], edited[2].replace("x3", "x9"), edited[3]]
    folder = tmp_path / "logs"
    folder.mkdir()
    for name, lines in logs.items():
        (folder / f"{name}.jsonl").write_text("\n".join(lines))
    events = read_chains(spark, str(folder), ".jsonl").cache()
    # The third events arrive first of all, then the rest in two parts, the second one again in the last.
    parts = [events.where("line = 3"), events.where("line <= 2"), events.where("line in (2, 4)")]
    last = {}
    for _, rows in streamed(spark, state.check_chains, events.schema, parts, tmp_path):
        last |= {r["chain"]: (r["events"], r["line"], r["reason"]) for r in rows}
    assert last == {r["chain"]: (r["events"], r["line"], r["reason"]) for r in chains.verify(events).collect()}


def test_missing_events_break_a_chain_in_time(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for name in ("gap", "full"):
        (folder / f"{name}.jsonl").write_text("\n".join(log(name, STEPS)))
    events = read_chains(spark, str(folder), ".jsonl").cache()
    parts = [events.where("chain = 'full' or line <> 2"), events.where("chain = 'other'"), events.where("chain = 'full'")]
    last = {}
    for _, rows in streamed(spark, lambda s: state.check_chains(s, patience_ms=1), events.schema, parts, tmp_path):
        last |= {r["chain"]: (r["events"], r["line"], r["reason"]) for r in rows}
    assert last == {"gap": (1, 2, "missing"), "full": (4, None, None)}


def test_listings_take_events_in_their_order(spark, tmp_path):
    r = random.Random(3)
    rows = []
    for sku in "abcde":
        for pos in range(8):
            status = r.choice(["DRAFTED", "SYNCED", "PUBLISHED", "ENDED", "SHIPPED", ""])
            rows.append((sku, pos, f"t{pos}", status, *(r.choice(["", f"{f}{pos}"]) for f in state.FIELDS)))
    want = {}
    for row in rows:
        e = dict(zip(["sku", "pos", "ts", "status", *state.FIELDS], row, strict=True))
        want[e["sku"]] = state.step(want.get(e["sku"]), e)
    schema = "sku string, pos long, ts string, status string, " + ", ".join(f"{f} string" for f in state.FIELDS)
    r.shuffle(rows)
    parts = [spark.createDataFrame(rows[i::3] + rows[:2], schema) for i in range(3)]
    last = {}
    for _, out in streamed(spark, state.listings, parts[0].schema, parts, tmp_path):
        last |= {x["sku"]: x for x in out}
    assert {k: {c: v[c] for c in state.LISTING} for k, v in last.items()} == {k: v for k, v in want.items() if v}
    assert all(v["next"] == 8 and v["waiting"] == 0 for v in last.values())


def test_digest_is_that_of_the_batch(spark):
    rows = {'{"a":"é\\"x"}': 2, '{"a":"z"}': 1}
    d = spark.createDataFrame([("c", k, n) for k, n in rows.items()], "chain string, row string, n long")
    assert chains.state_digest(d, spark.range(1).select(F.lit("c").alias("chain"), F.array(F.lit("a")).alias("fields"))).first()["state"] == state.digest(["a"], rows)
