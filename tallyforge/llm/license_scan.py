"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, gram_hashes, mix, text_slices, tidy

SHINGLE = 5
CONTAINMENT = 0.8
#: Chance at least with which a window that holds a template is retrieved.
GUARANTEE = 0.999
#: Words of the templates that one pass over the texts looks for; a longer list is looked for in several passes of one stage.
PASS_WORDS = 200_000

#: Names and texts of public licence notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-terms": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "isc-terms": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights": "All rights reserved. No part of this publication may be reproduced without prior written permission.",
}


def worst_similarity(words: int, step: int, containment: float = CONTAINMENT, k: int = SHINGLE) -> float:
    """Least Jaccard similarity of a template of so many words, contained to that share, and the nearest window of as many words."""
    n = max(1, words - k + 1)
    shared = max(1.0, math.ceil(containment * n - 1e-9) - math.ceil(step / 2))
    return shared / (2 * n - shared)


def bands_for(similarity: float, guarantee: float = GUARANTEE) -> int:
    """Bands of one row after which a window of that similarity is missed with a chance of at most 1 - guarantee."""
    return 1 if similarity >= 1 else max(1, math.ceil(math.log(1 - guarantee) / math.log(1 - similarity)))


def _prepared(templates: dict[str, str], containment: float) -> list[tuple[str, int, int, np.ndarray, np.ndarray]]:
    """(name, window words, step, sorted shingles, band seeds) of each template that has words."""
    out = []
    for name, text in sorted(templates.items()):
        for _, _, h, offsets, _, _ in text_slices(pa.array([text]), fold=True):
            n = int(offsets[1])
            if n:
                step = max(1, n // 8)
                seeds = mix(np.arange(1, bands_for(worst_similarity(n, step, containment)) + 1, dtype=np.uint64))
                out.append((name, n, step, np.unique(gram_hashes(h, min(n, SHINGLE))), seeds))
    return out


def _scan(h: np.ndarray, name_of: list, shared: dict[int, np.ndarray], containment: float) -> list[tuple[str, float, int, int]]:
    """Hits of one text: (template, best containment, windows, first word)."""
    hits = []
    grams = {k: gram_hashes(h, k) for k in shared}
    near = {k: np.flatnonzero(np.isin(g, shared[k])) for k, g in grams.items()}
    for name, n, step, template, seeds in name_of:
        k = min(n, SHINGLE)
        # A window meets the template in a band only by a shared shingle, so windows without one are not looked at.
        g, at = grams[k], near[k]
        at = at[np.isin(g[at], template)]
        if not len(at):
            continue
        span = n - k + 1
        last = max(0, len(g) - span)
        lo, hi = np.maximum(0, at - span + 1), np.minimum(at, last)
        marks = np.zeros(last + 2, np.int64)
        np.add.at(marks, np.minimum(lo, last), 1)
        np.add.at(marks, hi + 1, -1)
        inside = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        windows = inside[(inside % step == 0) | (inside == last)]
        wanted = [mix(template ^ s).min() for s in seeds]
        best, first, count, end = 0.0, -1, 0, -1
        for w in windows:
            part = g[w : w + span]
            if any(mix(part ^ s).min() == m for s, m in zip(seeds, wanted, strict=True)):
                # A template may lie up to a step beside its nearest window.
                places = range(max(0, int(w) - step), min(last, int(w) + step) + 1)
                exact = [len(np.intersect1d(g[p : p + span], template)) / len(template) for p in places]
                p = places[int(np.argmax(exact))]
                best = max(best, *exact)
                if max(exact) >= containment and p > end:
                    count += 1
                    first, end = p if first < 0 else first, p + n - 1
        if best >= containment:
            hits.append((name, best, count, int(first)))
    return hits


def _passes(templates: dict[str, str], words: int) -> list[dict[str, str]]:
    """templates in parts of at most so many words, a longer one by itself."""
    parts: list[dict[str, str]] = []
    size = words + 1
    for name, text in sorted(templates.items()):
        n = len(text.split())
        if size + n > words:
            parts.append({})
            size = 0
        parts[-1][name] = text
        size += n
    return parts


def _finder(templates: dict[str, str], containment: float):
    """A task over (id, text, licenses so far) that adds the hits of these templates."""
    ready = _prepared(templates, containment)
    shared = {k: np.unique(np.concatenate([t for _, n, _, t, _ in ready if min(n, SHINGLE) == k])) for k in {min(n, SHINGLE) for _, n, _, _, _ in ready}}
    item = pa.struct([("license", pa.string()), ("containment", pa.float64()), ("n_windows", pa.int64()), ("first_word", pa.int64())])
    seen = {k: np.zeros(1 << 16, bool) for k in shared}
    for k, s in shared.items():
        seen[k][(s >> U64(48)).astype(np.int64)] = True

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, offsets, _, _ in text_slices(b.column(1), fold=True):
                rows = b.column(2).slice(lo, hi - lo).to_pylist()
                may = np.zeros(hi - lo, bool)
                for k in shared:
                    g = gram_hashes(h, k)
                    at = np.flatnonzero(seen[k][(g >> U64(48)).astype(np.int64)])
                    at = at[np.isin(g[at], shared[k])]
                    may[np.searchsorted(offsets, at, "right") - 1] = True
                for i in np.flatnonzero(may):
                    found = _scan(h[offsets[i] : offsets[i + 1]], ready, shared, containment)
                    rows[i] = rows[i] + [{"license": a, "containment": c, "n_windows": n, "first_word": f} for a, c, n, f in found]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:2], pa.array(rows, pa.list_(item))], names=b.schema.names)

    return find


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, pass_words: int = PASS_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, licenses (array of name, containment, n_windows, first_word), licensed.

    Words are what stands between ASCII white space, A-Z lower-cased, shingles
    have five of them (all words of a shorter template). Each template is looked
    for in windows of as many words, an eighth of them apart; bands of one
    MinHash each, so many that a window which holds the template at the wanted
    containment is retrieved with a chance of GUARANTEE. A retrieved template is
    a hit if one window near there has that share of its shingles exactly.
    containment is the best found, first_word the word at which the first hit
    begins. Any number of templates is taken: tasks get pass_words words of them
    at a time, and the parts follow one another over each batch of texts. Null
    and empty texts have none; ids may be of any type, null or repeat; other
    columns are not read.
    """
    fields = [("license", T.StringType()), ("containment", T.DoubleType()), ("n_windows", T.LongType()), ("first_word", T.LongType())]
    kind = T.ArrayType(T.StructType([T.StructField(*f) for f in fields]))
    d = docs.select("doc_id", "text", F.array().cast(kind).alias("licenses"))
    schema = T.StructType([*docs.select("doc_id", "text").schema.fields, T.StructField("licenses", kind)])
    for part in _passes(TEMPLATES if templates is None else templates, pass_words):
        d = d.mapInArrow(tidy(_finder(part, containment)), schema)
    return d.select("doc_id", "licenses", (F.size("licenses") > 0).alias("licensed"))
