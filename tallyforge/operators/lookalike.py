"""Vector look-alikes: best items of an index for each query, exact in blocks or from random-hyperplane buckets.

Both ways deal vectors and queries to keys; a task multiplies the two sides of a
key as matrices and keeps the best k items of each query, so no pair of vectors becomes
a row. Only the best of each key are merged by query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors and query vectors that meet in one task, at most.
PART_ROWS, BLOCK_ROWS = 25_000, 10_000
#: Scores held at once in a task.
SCORES = 2_000_000
#: Buckets: hyperplane sets, vectors of a bucket aimed at, and buckets looked into in each set.
TABLES, BUCKET_ROWS, PROBES = 16, 50, 24
#: Queries from which the hyperplanes of a set are fitted, at most, and the share of their exact items that must be found.
FIT_QUERIES, FIT_RECALL = 200, 0.95


def refuse_mixed(*frames: DataFrame, model: str = "model") -> None:
    """Raises unless all vectors of all frames come from one model; scores of different models mean nothing."""
    both = frames[0].select(model)
    for f in frames[1:]:
        both = both.unionByName(f.select(model))
    found = [r[0] for r in both.distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"vectors of more than one model: {', '.join(sorted(map(str, found)))}")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def _starts(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))


def _best(k: int, own: bool) -> Callable:
    """The task of one key: (query_id, item, score) of the best k items of each query, ties to the least item."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("item"), right.sort_by("query_id")
        out: list[tuple] = [[], [], []]
        if left.num_rows and right.num_rows:
            items, queries = left["item"].combine_chunks(), right["query_id"].combine_chunks()
            v, q = _matrix(left["embedding"]), _matrix(right["embedding"])
            code = lambda a: np.asarray(a.dictionary_encode().indices)
            rows, cols = _starts(code(items)), _starts(code(queries))
            item_of, query_of = items.take(pa.array(rows)), queries.take(pa.array(cols)).to_pylist()
            place = {x: i for i, x in enumerate(item_of.to_pylist())} if own else {}
            bounds = np.append(cols, len(q))
            step = max(1, SCORES // max(1, len(v)))
            at = 0
            while at < len(cols):
                end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + step, "right")) - 1)
                s = v @ q[bounds[at] : bounds[end]].T
                np.round(s, 12, out=s)  # copies of a vector score alike
                s = np.maximum.reduceat(s, rows, axis=0)  # best image of an item
                s = np.maximum.reduceat(s, bounds[at:end] - bounds[at], axis=1).T  # best image of a query
                for i, score in enumerate(s, at):
                    if query_of[i] in place:
                        score[place[query_of[i]]] = -np.inf
                    n = min(k, len(score))
                    least = np.partition(score, len(score) - n)[len(score) - n]
                    more = np.flatnonzero(score > least)
                    hit = np.concatenate([more, np.flatnonzero(score == least)[: n - len(more)]])
                    hit = hit[score[hit] > -np.inf]
                    out[0] += [query_of[i]] * len(hit)
                    out[1] += hit.tolist()
                    out[2] += score[hit].tolist()
                at = end
            return pa.table({"query_id": pa.array(out[0], queries.type), "item": item_of.take(pa.array(out[1], pa.int64())), "score": pa.array(out[2], pa.float64())})
        return pa.table({"query_id": right["query_id"].slice(0, 0), "item": left["item"].slice(0, 0), "score": pa.array([], pa.float64())})

    return run


def _merged(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int, own: bool) -> DataFrame:
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item {vectors.schema['item'].dataType.simpleString()}, score double"
    task = _best(k, own)
    found = vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(lambda left, right: task(left, right), schema)
    found = found.groupBy("query_id", "item").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _shaped(df: DataFrame, name: str) -> DataFrame:
    """(name, embedding, dim) of the rows that have a vector without nulls; vectors of different lengths never meet."""
    return df.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())).select(name, "embedding", F.size("embedding").alias("dim"))


def nearest(index: DataFrame, queries: DataFrame, k: int, own: bool = False) -> DataFrame:
    """(query_id, item, score, place): the k items with the largest inner product, exact.

    index: item, embedding; queries: query_id, embedding. An item or a query may
    have several vectors (images): its score is the best of them. own: items
    whose id is the query's are left out. Any number of either side: blocks of
    BLOCK_ROWS query vectors each meet parts of PART_ROWS vectors once.
    """
    v, q = _shaped(index, "item"), _shaped(queries, "query_id")
    parts, blocks = (-(-max(df.count(), 1) // n) for df, n in ((v, PART_ROWS), (q, BLOCK_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumns({"part": F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"), "block": every(blocks)})
    q = q.withColumns({"block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "part": every(parts)})
    return _merged(v, q, ["dim", "part", "block"], k, own)


def _nearest_codes(x: np.ndarray, table: int, bits: int, probes: int) -> np.ndarray:
    """For each vector the codes of the buckets of a set that lie nearest to it, its own first."""
    dim = x.shape[1]
    planes = np.random.default_rng([dim, table]).standard_normal((dim, bits))
    side = x @ planes
    code = (side > 0) @ (1 << np.arange(bits))
    # Flips of no, one or two sides by how near the vector is to their planes.
    flips = [0] + [1 << i for i in range(bits)] + [1 << i | 1 << j for i in range(bits) for j in range(i)]
    near = np.abs(side)
    cost = np.column_stack([np.zeros(len(x)), near] + [near[:, [i]] + near[:, [j]] for i in range(bits) for j in range(i)])
    return code[:, None] ^ np.array(flips)[np.argsort(cost, axis=1, kind="stable")[:, :probes]]


def _fitted_bits(v: DataFrame, q: DataFrame, k: int, own: bool, bits: int, tables: int, probes: int) -> int | None:
    """The most hyperplanes up to `bits` with which at most FIT_QUERIES queries find FIT_RECALL of their exact items, None if no number does.

    The sample is the queries of least hash; each is compared with every vector. At most k items of each come to the driver.
    """
    ids = q.select("query_id").distinct().orderBy(F.xxhash64("query_id"), "query_id").limit(FIT_QUERIES).collect()
    some = q.where(F.col("query_id").isin([r[0] for r in ids]))
    exact = nearest(v, some, k, own).select("query_id", "item")
    near = F.row_number().over(Window.partitionBy("query_id", "item").orderBy(F.desc("score")))
    score = F.aggregate(F.zip_with("a", "b", lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = exact.join(v.select("item", "dim", F.col("embedding").alias("a")), "item").join(some.select("query_id", "dim", F.col("embedding").alias("b")), ["query_id", "dim"])
    pairs = pairs.withColumn("score", score).withColumn("n", near).where("n = 1").select("dim", "a", "b").collect()  # the images that are nearest
    if not pairs:
        return bits
    sides = {}
    for r in pairs:
        sides.setdefault(r["dim"], []).append((r["a"], r["b"]))
    for b in range(bits, 3, -1):
        met = 0
        for rows in sides.values():
            x, y = (np.array([r[i] for r in rows], np.float64) for i in (0, 1))
            met += np.any([(_nearest_codes(x, t, b, 1) == _nearest_codes(y, t, b, probes)).any(axis=1) for t in range(tables)], axis=0).sum()
        if met >= FIT_RECALL * len(pairs):
            return b
    return None


def _codes(df: DataFrame, name: str, bits: int, tables: int, probes: int) -> DataFrame:
    """(name, embedding, dim, table, code): the buckets of each vector, the `probes` that lie nearest to it in each set of hyperplanes."""

    def run(batches):
        for b in batches:
            codes, rows, nos = [], [], []
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _matrix(pa.chunked_array([b.column("embedding").take(pa.array(at))]))
                for t in range(tables):
                    best = _nearest_codes(x, t, bits, probes)
                    codes.append(best.ravel())
                    rows.append(np.repeat(at, best.shape[1]))
                    nos.append(np.full(best.size, t, np.int32))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(np.concatenate(nos)), pa.array(np.concatenate(codes).astype(np.int64))], names=[name, "embedding", "dim", "table", "code"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("table", T.IntegerType()), T.StructField("code", T.LongType())]))


def nearest_indexed(index: DataFrame, queries: DataFrame, k: int, own: bool = False, bits: int | None = None, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """As nearest, from the items that share a bucket with a query in one of `tables` sets of random hyperplanes; scores are exact.

    Every vector is in one bucket of each set, a query looks into `probes`. bits:
    hyperplanes of a set; if None, so many that a bucket has about BUCKET_ROWS vectors, or fewer,
    until a sample of the queries finds FIT_RECALL of its exact items; where no number does, the exact way is taken. Buckets
    of more than PART_ROWS vectors are dealt to several tasks. What share of the
    exact result is found depends on the data; recall() measures it.
    """
    v, q = _shaped(index, "item"), _shaped(queries, "query_id")
    if bits is None:
        most = min(30, max(4, math.ceil(math.log2(max(v.count(), 1) / BUCKET_ROWS + 1))))
        bits = _fitted_bits(v, q, k, own, most, tables, probes)
        if bits is None:
            return nearest(index, queries, k, own)
    v, q = _codes(v, "item", bits, tables, 1), _codes(q, "query_id", bits, tables, probes)
    keys = ["dim", "table", "code"]
    size = v.groupBy(*keys).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    v = v.join(size, keys, "left").withColumn("part", F.pmod(F.xxhash64("item"), parts).cast("int")).drop("parts")
    q = q.join(size, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return _merged(v, q, [*keys, "part"], k, own)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: wanted, met, recall of (query_id, item) rows against the exact ones."""
    j = exact.select("query_id", "item").join(found.select("query_id", "item", F.lit(True).alias("met")), ["query_id", "item"], "left")
    return j.agg(F.count("*").alias("wanted"), F.count_if("met").alias("met")).withColumn("recall", F.col("met") / F.nullif("wanted", F.lit(0)))


def price_signal(found: DataFrame, prices: DataFrame) -> DataFrame:
    """(query_id, n, lo, middle, hi) of the prices of the items found; prices: item, price. middle: the upper one of an even number."""
    j = found.join(prices.where("price is not null"), "item")
    s = F.array_sort(F.collect_list("price"))  # at most k of a query
    return j.groupBy("query_id").agg(F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"), s.alias("s")).select("query_id", "n", "lo", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("middle"), "hi")
