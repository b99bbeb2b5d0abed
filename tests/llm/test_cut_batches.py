"""Cuts are made in batches of few texts: the caller's plan has no Python over whole texts."""

import pytest

from tallyforge.llm import suffix_dedup


@pytest.mark.parametrize("limit", [suffix_dedup.BROADCAST_SPANS, 0])
def test_cuts_are_made_in_small_batches(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_SPANS", limit)
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own{i}  {passage} end{i}", i % 3, -1, "x") for i in range(20)]
    rows += [rows[5], (5, f"other {passage}", 1, -1, "y"), (30, passage, 0, 0, None), (31, None, 0, 9, None), (32, " \n", 0, 9, None), (33, "a short one", 1, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut int, n_chars int, span_uid string").coalesce(1)
    names, whole = [], suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name, **more: names.append(name) or whole(df, name, **more))
    out = suffix_dedup.cut_repeats(docs)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert names.count("cut") == 1
    assert out.schema == docs.schema
    cut = lambda i, t: "other " if t.startswith("other") else f"own{i}   end{i}" if i else t
    want = [(i, cut(i, t), c, len(cut(i, t)), x) for i, t, c, _, x in rows if i < 20]
    want += [(31, None, 0, None, None), (32, " \n", 0, 2, None), (33, "a short one", 1, 11, "z")]
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))
