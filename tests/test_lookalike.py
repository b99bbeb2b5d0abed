"""Look-alikes against all pairs: images of items and queries, copies, hot buckets, recall, mixed models."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.operators import lookalike


def brute(index, queries, k, own):
    out = []
    for q in {q for q, _ in queries}:
        best = {}
        for item, v in index:
            if v is None or (own and item == q):
                continue
            for q2, w in queries:
                if q2 == q and w is not None and len(w) == len(v):
                    best[item] = max(best.get(item, -9), round(float(np.dot(v, w)), 12))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, item, i + 1) for i, (item, _) in enumerate(ranked)]
    return sorted(out)


def frames(spark, index, queries):
    as_list = lambda rows: [(i, None if v is None else [float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame(as_list(index), "item long, embedding array<double>"), spark.createDataFrame(as_list(queries), "query_id long, embedding array<double>")


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(2)
    index = [(i // 3, r.standard_normal(8)) for i in range(240)]
    index += [(100 + i, index[0][1]) for i in range(40)] + [(900, None), (901, r.standard_normal(4)), (902, [])]
    return index, [(i // 2, r.standard_normal(8)) for i in range(40)] + [(7, index[0][1]), (50, r.standard_normal(4)), (51, None)]


@pytest.mark.parametrize("parts,blocks,scores", [(50_000, 10_000, 8_000_000), (37, 6, 100)])
@pytest.mark.parametrize("own", [False, True])
def test_exact_is_all_pairs(spark, monkeypatch, vectors, parts, blocks, scores, own):
    for name, value in (("PART_ROWS", parts), ("BLOCK_ROWS", blocks), ("SCORES", scores)):
        monkeypatch.setattr(lookalike, name, value)
    got = lookalike.nearest(*frames(spark, *vectors), 6, own)
    assert sorted((r["query_id"], r["item"], r["place"]) for r in got.collect()) == brute(*vectors, 6, own)


def test_index_finds_nearly_all_and_scores_exactly(spark, monkeypatch):
    r = np.random.default_rng(4)
    centres = r.standard_normal((40, 24))
    index = [(i, c + 0.2 * r.standard_normal(24)) for i, c in enumerate(np.repeat(centres, 25, axis=0))]
    index += [(2000 + i, index[0][1]) for i in range(300)]  # one vector a quarter of all
    queries = [(i, v) for i, v in index if i % 20 == 0]
    v, q = frames(spark, index, queries)
    exact = lookalike.nearest(v, q, 5, own=True)
    monkeypatch.setattr(lookalike, "PART_ROWS", 60)  # the hot bucket in several tasks
    found = lookalike.nearest_indexed(v, q, 5, own=True)
    assert lookalike.recall(found, exact).first()["recall"] >= 0.95
    whole = {(x["query_id"], x["item"]): x["score"] for x in exact.collect()}
    assert all(whole[k] == x["score"] for x in found.collect() if (k := (x["query_id"], x["item"])) in whole)


def test_empty_sides_and_mixed_models(spark, vectors):
    v, q = frames(spark, *vectors)
    assert lookalike.nearest(v.limit(0), q, 3).collect() == lookalike.nearest(v, q.limit(0), 3).collect() == []
    a, b = (spark.createDataFrame([(1, m)], "item int, model string") for m in "xy")
    lookalike.refuse_mixed(a, a)
    with pytest.raises(ValueError, match="more than one model"):
        lookalike.refuse_mixed(a, b)


def test_scores_are_held_once(monkeypatch):
    monkeypatch.setattr(lookalike, "SCORES", 4_000_000)
    r = np.random.default_rng(5)
    vectors = lambda n: pa.array(list(r.standard_normal((n, 4))), pa.list_(pa.float64()))
    left = pa.table({"item": np.arange(20_000) // 10, "embedding": vectors(20_000)})
    right = pa.table({"query_id": np.arange(200) // 10, "embedding": vectors(200)})
    tracemalloc.start()
    lookalike._best(5, False)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 8 * lookalike.SCORES


def test_index_of_unrelated_vectors_reaches_its_recall(spark):
    r = np.random.default_rng(6)
    index = [(i, v / np.linalg.norm(v)) for i, v in enumerate(r.standard_normal((6000, 256)))]
    v, q = frames(spark, index, [(i, v) for i, v in index if i % 60 == 0])
    exact = lookalike.nearest(v, q, 5, own=True)
    assert lookalike.recall(lookalike.nearest_indexed(v, q, 5, own=True, tables=4), exact).first()["recall"] >= 0.9
