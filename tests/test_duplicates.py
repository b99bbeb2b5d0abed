"""Duplicate decisions against all pairs, and the pairs that likely_pairs makes."""

import math
import random

import pytest

from tallyforge.operators import audit

WORDS = [f"w{chr(97 + i)}x" for i in range(20)]


def sets(seed, n):
    r = random.Random(seed)
    return [sorted({"common", *r.sample(WORDS, r.randint(1, 9))} if r.random() < 0.9 else r.sample(WORDS, r.randint(0, 3))) for _ in range(n)]


@pytest.mark.parametrize("least", [0.1, 0.245, 0.345, 0.8, 1.0])
def test_no_likely_pair_is_lost(spark, least):
    a, b = sets(1, 60), sets(2, 90)
    got = {tuple(r) for r in audit.likely_pairs(spark.createDataFrame(list(enumerate(a)), "cand int, t array<string>"), spark.createDataFrame(list(enumerate(b)), "row int, t2 array<string>"), least).collect()}
    cosine = lambda x, y: len(set(x) & set(y)) / math.sqrt(len(x) * len(y)) if x and y else 0
    assert {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if cosine(x, y) >= least} <= got
    assert all(set(a[i]) & set(b[j]) for i, j in got)


def test_a_word_of_all_rows_pairs_nothing_by_itself(spark):
    many = [(i, ["common", *(f"own{i}{c}" for c in "abcdef")]) for i in range(300)]
    got = audit.likely_pairs(spark.createDataFrame(many, "cand int, t array<string>"), spark.createDataFrame(many, "row int, t2 array<string>"), 0.345)
    assert got.count() == 300


def test_decisions_are_those_of_all_pairs(spark):
    r = random.Random(9)
    text = lambda ws: " ".join(ws)
    rows = [(i, text(ws), f"Bin {r.randint(1, 4)}" if r.random() < 0.7 else None, f"ZZ{1000 + r.randint(0, 60)}", r.choice(["a", "b", "c", None]), r.choice([None, "L"]), [f"ZZ{1000 + r.randint(0, 60)}"]) for i, ws in enumerate(sets(3, 80))]
    cands = [(i, text(ws), f"bin-0{r.randint(1, 4)}" if r.random() < 0.7 else "", None, None, r.randint(0, 99) if r.random() < 0.4 else None) for i, ws in enumerate(sets(4, 60))]
    got = {x["cand"]: (x["action"], x["n_hard"], x["n_soft"], x["best"], x["score"]) for x in audit.decide_duplicates(spark.createDataFrame(cands, "cand int, description string, bin string, photos string, folder string, hint int"), spark.createDataFrame(rows, "row int, description string, bin string, photos string, folder string, lot_id string, filed array<string>")).collect()}
    number = lambda b: "".join(c for c in b or "" if c.isdigit()).lstrip("0")
    for i, words, own, _, _, hint in cands:
        soft = []
        for j, other, bin_, *_ in rows:
            x, y = set(words.split()), set(other.split())
            s = (len(x & y) / math.sqrt(len(x) * len(y)) if x and y else 0) + (0.1 if number(own) and number(own) == number(bin_) else 0) + (0.25 if hint == j else 0)
            s = math.floor(min(1.0, s) * 100 + 0.5) / 100
            if s >= 0.35:
                soft.append((-s, j))
        want = ("possible", 0, len(soft), min(soft)[1], -min(soft)[0]) if soft else ("new", 0, 0, None, None)
        assert got[i] == want


def test_equal_descriptions_are_scored_once(spark, monkeypatch):
    met, whole = [], audit.likely_pairs

    def counted(left, right, *more, **options):
        met.append((left.count(), right.count()))
        return whole(left, right, *more, **options)

    monkeypatch.setattr(audit, "likely_pairs", counted)
    rows = spark.range(300).selectExpr("id as row", "'carved brass lamp' as description", "'bin 1' as bin", "null as photos", "null as folder", "null as lot_id", "array('x') as filed")
    cands = spark.range(200).selectExpr("id as cand", "'brass lamp' as description", "'bin ' || id % 2 as bin", "cast(null as string) as photos", "cast(null as string) as folder", "case when id = 7 then 9L end as hint")
    got = {tuple(x) for x in audit.decide_duplicates(cands, rows.withColumns({c: rows[c].cast("string") for c in ("photos", "folder", "lot_id")})).select("best", "n_hard", "n_soft").collect()}
    assert got == {(0, 0, 300), (9, 0, 300)} and max(a * b for a, b in met) <= 2
