"""Change logs read from files: every kind of break, the replayed table, drift, digests by shards."""

import hashlib
import json

from pyspark.sql import functions as F

from tallyforge.operators import chains
from tallyforge.sources.chains import read_chains


def canon(x):
    return json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def log(key, steps, change=None):
    """Lines of a chain of (add, remove) steps; change(i, event) alters an event before it is hashed."""
    fields, table, prev, out = ["a", "ü"], [], "0" * 64, []
    for i, (add, remove) in enumerate(steps):
        for r in remove:
            if r in table:
                table.remove(r)
        table += add
        rows = sorted(canon(r) for r in table)
        e = {"v": 1, "seq": i, "ts": "t", "key": key, "kind": "update" if i else "genesis", "fields": fields, "add": add, "remove": remove, "state": sha(canon({"fields": fields, "rows": rows})), "prev": prev}
        if change:
            change(i, e)
        e["hash"] = prev = sha(canon(e))
        out.append(canon(e))
    return out


R = [{"a": f"x{i}", "ü": "ß \"q\" / \\"} for i in range(5)]
STEPS = [([R[0], R[0]], []), ([R[1]], [R[0]]), ([R[2], R[3]], [R[0], R[1]]), ([R[4]], [])]


def setter(at, **values):
    return lambda i, e: e.update(values) if i == at else None


def test_every_break_is_named(spark, tmp_path):
    whole = log("good", STEPS)
    cut = log("deleted", STEPS)
    edited = log("edited", STEPS)
    edited[2] = edited[2].replace("x3", "x9")
    swapped = log("swapped", STEPS)
    swapped[1], swapped[2] = swapped[2], swapped[1]
    logs = {
        "good": whole, "deleted": cut[:1] + cut[2:], "edited": edited, "swapped": swapped, "garbage": log("garbage", STEPS)[:2] + ["{not json"], "seq": log("seq", STEPS, setter(2, seq=7)), "key": log("key", STEPS, setter(1, key="other")),
        "twice": log("twice", STEPS, setter(3, kind="genesis")), "late": log("late", STEPS, setter(0, kind="update")), "absent": log("absent", [*STEPS[:2], ([], [R[0], R[0]])]), "own": log("own", [([R[0]], [R[0]])]), "state": log("state", STEPS, setter(3, state="0" * 64)),
        "emptied": log("emptied", [([R[0]], []), ([], [R[0]])]),
    }
    for name, lines in logs.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    events = read_chains(spark, str(tmp_path), ".jsonl")
    rows = [("good", canon(r)) for r in (R[2], R[4], R[3])] + [("emptied", canon(R[0])), ("seq", canon(R[0]))]
    tables = spark.createDataFrame(rows, "chain string, row string").withColumn("fields", F.array(F.lit("a"), F.lit("ü")))
    got = {r["chain"]: r for r in chains.verify(events, tables).collect()}
    want = {"good": None, "emptied": None, "deleted": (2, "prev"), "edited": (3, "edited"), "swapped": (2, "prev"), "garbage": (3, "not an event"), "seq": (3, "seq"), "key": (2, "key"), "twice": (4, "genesis"), "late": (1, "genesis"), "absent": (3, "removes"), "own": (1, "removes"), "state": (4, "state")}
    assert {k: r["reason"] and (r["line"], r["reason"]) for k, r in got.items()} == want
    assert (got["good"]["events"], got["good"]["rows"], got["good"]["head"], got["good"]["drift"]) == (4, 3, json.loads(whole[-1])["hash"], False)
    assert (got["emptied"]["rows"], got["emptied"]["drift"]) == (0, True)
    assert (got["seq"]["events"], got["seq"]["rows"], got["seq"]["drift"]) == (2, None, None)
    assert {k: r["events"] for k, r in got.items()} == {k: len(logs[k]) if w is None else w[0] - 1 for k, w in want.items()}


def test_digests_by_shards_tell_the_same(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 2), ("b", "y", 1), ("c", "x", 1), ("c", "y", 2)], "chain string, row string, n long")
    fields = spark.createDataFrame([("a", ["f"]), ("b", ["f"]), ("c", ["f"]), ("d", ["f"])], "chain string, fields array<string>")
    for shards in (1, 8):
        got = {r["chain"]: r["state"] for r in chains.state_digest(rows, fields, shards).collect()}
        assert got["a"] == got["b"] and len({got["a"], got["c"], got["d"]}) == 3
