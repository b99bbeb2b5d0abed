"""Interpolated modified Kneser-Ney models over characters: counts, sharded joins, scoring.

Words of an open vocabulary make word n-grams nearly all new, so the models
are over characters. An n-gram of up to ORDER characters is packed exactly
into one long, 12 bits a character (code points from 4096 on share the upper
codes), so suffixes and contexts are bit operations on the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy

ORDER = 5
BITS = 12
#: Characters handled at once inside a task.
SLICE = 1 << 18
#: Entries of a scoring table (12 bytes each) up to which tasks get all of it; beyond, chunks join it in shards.
TABLE_ROWS = 6_000_000
#: Text in one chunk of the sharded way.
CHUNK_BYTES = 32 << 20


def mask(n: int) -> int:
    return (1 << (BITS * n)) - 1


def codes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(cp < 4096, cp, 2048 + (cp * 2654435761 >> 7) % 2048)


def key_slices(texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, doc numbers, character codes) of slices that together hold every character of every text once.

    Before a text stand ORDER - 1 characters of code 0. Texts longer than a
    slice go on in the next with their context.
    """
    parts: list[np.ndarray] = []
    owners: list[int] = []
    size = 0
    pad = np.zeros(ORDER - 1, np.int64)

    def flush():
        own = np.repeat(np.array(owners, np.int64), [len(p) for p in parts])
        real = np.concatenate([np.arange(len(p)) >= ORDER - 1 for p in parts])
        c = np.concatenate(parts)
        keys = c.copy()
        for j in range(1, ORDER):
            keys[j:] |= c[:-j] << (BITS * j)
        return keys[real], own[real], c[real]

    for d, text in enumerate(texts):
        if not text:
            continue
        c = np.concatenate([pad, codes(text)])
        at = 0
        while at < len(c) - (ORDER - 1):
            part = c[at : at + SLICE]
            parts.append(part)
            owners.append(d)
            size += len(part)
            at += len(part) - (ORDER - 1)
            if size >= SLICE:
                yield flush()
                parts, owners, size = [], [], 0
    if parts:
        yield flush()


def _merged(found: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(found).groupby("key", sort=False).sum().reset_index()


def count_keys(docs: DataFrame, classes: dict[str, Column], text_col: str = "text") -> DataFrame:
    """(key, c_all, c_<class>...): n-grams of ORDER characters of all documents, counted over all and over each class.

    classes: name -> boolean Column. Each task adds up its own keys before the shuffle.
    """
    names = list(classes)
    schema = "key long, c_all long" + "".join(f", c_{n} long" for n in names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pd.DataFrame] = []
        held = 0

        def out(d: pd.DataFrame) -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(d[["key", "c_all", *[f"c_{n}" for n in names]]], preserve_index=False)

        for b in batches:
            flags = [np.asarray(b.column(i + 1).fill_null(False).to_numpy(zero_copy_only=False), bool) for i in range(len(names))]
            for keys, own, _ in key_slices(x.as_py() for x in b.column(0)):
                code, uniques = pd.factorize(keys)
                d = {"key": uniques, "c_all": np.bincount(code, minlength=len(uniques))}
                for n, f in zip(names, flags, strict=True):
                    d[f"c_{n}"] = np.bincount(code[f[own]], minlength=len(uniques))
                found.append(pd.DataFrame(d))
                held += len(uniques)
                if held > 200_000:
                    found = [_merged(found)]
                    held = len(found[0])
                    if held > 120_000:
                        yield out(found[0])
                        found, held = [], 0
        if found:
            yield out(_merged(found))

    rows = docs.select(F.col(text_col).alias("text"), *[c.alias(n) for n, c in classes.items()]).mapInArrow(tidy(count), schema)
    return rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in ["c_all", *[f"c_{n}" for n in names]]])


def _discounts(grams: DataFrame, names: list[str]) -> list[tuple[float, float, float]]:
    """For each column of counts the discounts of modified Kneser-Ney for counts 1, 2, 3 and more, from the numbers of n-grams met once to four times."""
    q = grams.agg(*[F.count_if(F.col(c) == i).alias(f"{c}_{i}") for c in names for i in (1, 2, 3, 4)]).first()

    def d(i: int, y: float, a: float, b: float) -> float:
        return min(max(i - (i + 1) * y * b / a, 0.1), i - 0.05) if a and b else min(0.5 * i, 1.5)

    out = []
    for c in names:
        n1, n2, n3, n4 = (float(q[f"{c}_{i}"]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        out.append((d(1, y, n1, n2), d(2, y, n2, n3), d(3, y, n3, n4)))
    return out


def probabilities(table: DataFrame, names: list[str], top: int = ORDER, base: DataFrame | None = None, above: int = 0) -> DataFrame:
    """(key, p_<name>...): for each model the probability of the last of `top` characters given those before, for every suffix that table has.

    table: (key, counts) of ORDER-grams, a column of counts for each model in
    `names`. The highest order uses counts, each lower one the numbers of
    distinct left neighbours that the model has. Orders above `above` are the
    models' own; `base` (key of `above` characters, p) is where all of them back
    off to, the uniform distribution where above is 0. Every order is one join of
    the asked n-grams with counts and context sums, sharded by key, for all models
    together.
    """
    grams = {ORDER: table.select("key", *names)}
    for n in range(ORDER - 1, above, -1):
        left = [F.count_if(F.col(c) > 0).alias(c) for c in names]
        grams[n] = stored(grams[n + 1].groupBy((F.col("key").bitwiseAND(F.lit(mask(n)))).alias("key")).agg(*left), f"grams{n}")
    if base is None:
        base = table.sparkSession.createDataFrame([(0, 1.0 / 4096)], "key long, p double")
    p = base.select("key", *[F.col("p").alias(f"p_{c}") for c in names])
    for n in range(above + 1, top + 1):
        cuts = dict(zip(names, _discounts(grams[n], names), strict=True))
        sums = []
        for c, (d1, d2, d3) in cuts.items():
            kept = [F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2), F.count_if(F.col(c) > 2)]
            sums += [F.sum(c).alias(f"tot_{c}"), (d1 * kept[0] + d2 * kept[1] + d3 * kept[2]).alias(f"left_{c}")]
        ctx = grams[n].groupBy(F.shiftright("key", BITS).alias("ctx")).agg(*sums)
        # grams[n] has every suffix of n characters that table has, so it is what is asked.
        x = grams[n].withColumns({"ctx": F.shiftright("key", BITS), "suf": F.col("key").bitwiseAND(F.lit(mask(n - 1)))})
        x = x.join(ctx, "ctx").join(p.withColumnRenamed("key", "suf"), "suf")
        out = []
        for c, (d1, d2, d3) in cuts.items():
            own = F.greatest(F.col(c) - F.when(F.col(c) == 1, d1).when(F.col(c) == 2, d2).otherwise(d3), F.lit(0.0))
            met = F.col(f"tot_{c}") > 0  # a context that the model never met: the lower order as it is
            out.append(F.when(met, (own + F.col(f"left_{c}") * F.col(f"p_{c}")) / F.col(f"tot_{c}")).otherwise(F.col(f"p_{c}")).alias(f"p_{c}"))
        p = stored(x.select("key", *out), f"p{n}")
    return p


class Lookup:
    """key -> value by open addressing in numpy; keys that are missing give 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            mine = self.keys[slot] == keys[left]
            self.values[slot[mine]] = values[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        out = np.where((at := self.keys[slot]) == keys, self.values[slot], np.float32(0))
        todo = np.flatnonzero((at != keys) & (at != -1))
        while len(todo):
            s = slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            at = self.keys[s]
            out[todo] = np.where(at == keys[todo], self.values[s], out[todo])
            todo = todo[(at != keys[todo]) & (at != -1)]
        return out


Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray, int], dict[str, np.ndarray]]


def score_texts(texts: list[str | None], table: Lookup, scorer: Scorer, names: list[str]) -> dict[str, np.ndarray]:
    out = {n: np.zeros(len(texts)) for n in names}
    for keys, own, chars in key_slices(iter(texts)):
        for n, v in scorer(table.get(keys), own, chars, len(texts)).items():
            out[n] += v
    return out


def score_documents(docs: DataFrame, table: DataFrame, scorer: Scorer, names: list[str], keep: list[str], table_rows: int = TABLE_ROWS) -> DataFrame:
    """The keep columns of docs and the scorer's sums for each text: scorer(values, doc numbers, codes, n) -> sums.

    table: (key, value). Up to table_rows entries it is sent to all tasks. A
    larger one stays in shards: documents form chunks of bounded size, each
    chunk's distinct keys join the table, and its documents meet just the
    values they need.
    """
    schema = docs.select(*keep).schema
    for n in names:
        schema = schema.add(n, "double")

    def result(columns: list[pa.Array], texts: list[str | None], lookup: Lookup) -> pa.RecordBatch:
        sums = score_texts(texts, lookup, scorer, names)
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(sums[n]) for n in names]], names=[*keep, *names])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    if table.count() <= table_rows:
        t = table.select("key", F.col("value").cast("float")).toArrow()
        sent = docs.sparkSession.sparkContext.broadcast((t["key"].to_numpy(), t["value"].to_numpy()))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup = Lookup(*sent.value)
            for b in batches:
                yield result(b.columns[:-1], b.column(b.num_columns - 1).to_pylist(), lookup)

        return rows.mapInArrow(tidy(score), schema)

    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    chunks = 1 + size // CHUNK_BYTES
    rows = stored(rows.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks))), "chunks")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk = b.column(0).to_numpy()
            for keys, own, _ in key_slices(x.as_py() for x in b.column(1)):
                both = pd.DataFrame({"chunk": chunk[own], "key": keys}).drop_duplicates()
                yield pa.RecordBatch.from_pandas(both, preserve_index=False)

    asked = rows.select("chunk", "_text").mapInArrow(tidy(keys_of), "chunk long, key long").distinct()
    values = asked.join(table, "key").select("chunk", "key", F.col("value").cast("float").alias("value"))

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        lookup = Lookup(right["key"].to_numpy(), right["value"].to_numpy())
        columns = [left[c].combine_chunks() for c in keep]
        return pa.Table.from_batches([result(columns, left["_text"].to_pylist(), lookup)])

    return rows.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(together, schema)
