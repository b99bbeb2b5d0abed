"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens, small buckets compared in full, then the pairs that no bucket holds by their rarest shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, U64, gram_hashes, group_bounds, list_column, mix, row_number_of, small_side, stored, text_hash, text_slices, tidy, whole_groups
from .graph import connected_components

#: Words in a shingle, and the least similarity of a link.
SHINGLE = 5
SIMILARITY = 0.8
#: Chance at least with which paths find each linked pair. The others are found by their rarest shingles.
RECALL = 0.999
#: Tokens each set follows out of a bucket. Two sets of the least similarity share 1.6 of 2 on average, so their paths
#: meet at any depth with a chance that does not fall to zero.
BRANCHES = 2
#: Bucket size up to which a bucket is compared without another split, and splits for which tokens are sampled at once.
SMALL = 64
LEVELS = 3
#: A bucket of which a token keeps this share together is as alike as it gets: it is compared in blocks.
DENSE = 0.7
#: Shingles in one block of such a bucket; its blocks are compared pair by pair.
BLOCK_SHINGLES = 1_000_000
BLOCK_SETS = 1024
#: Rows sampled to tell common shingles from rare ones, and the most shingles held as common. They only order the
#: shingles of a set, and every order finds all pairs.
ORDER_ROWS = 20_000
ORDER_SHINGLES = 1 << 18


def runs_for(recall: float, similarity: float, branches: int = BRANCHES) -> int:
    """Runs after which a pair of that similarity is missed by all with a chance of at most 1 - recall, however deep buckets are split.

    A pair's common paths are a branching process: each goes on in a binomial
    number of `branches` at that similarity. lost is the chance that it dies out.
    """
    lost = 0.0
    for _ in range(1000):
        lost = (1 - similarity + similarity * lost) ** branches
    if lost > 0.999:
        raise ValueError(f"paths of similarity {similarity} die out with {branches} branches")
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def shingle_sets(values: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document; one shorter than k words is one shingle."""
    every = gram_hashes(values, k)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield gram_hashes(values[a:b], int(b - a))
        else:
            yield every[:0]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _set_names(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two hashes that name a set of shingles."""
    if not len(s):
        return U64(0), U64(0)
    return mix(s.sum(dtype=U64) + U64(len(s))), np.bitwise_xor.reduce(mix(s + U64(1)))


def _samples(sets: list[np.ndarray], seeds: np.ndarray) -> pa.ListArray:
    """For each set one token for each seed: the least of its shingles as that seed mixes them."""
    n, mins = len(seeds), []
    for s in sets:
        if not len(s):
            mins.append(np.zeros(n, U64))
        elif len(s) < 4096:
            mins.append(mix(s[:, None] ^ seeds).min(axis=0))
        else:
            mins.append(np.array([mix(s ^ x).min() for x in seeds], U64))
    flat = _signed(np.concatenate(mins)) if mins else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n), pa.int32()), pa.array(flat))


def _seeds(first: int, n: int) -> np.ndarray:
    return mix(np.arange(1 + first, 1 + first + n, dtype=np.uint64))


def _common(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than one text of a sample has, in order, and the number of those texts."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, h, offsets, _, _ in text_slices(b.column(0), fold=True):
                with np.errstate(over="ignore"):
                    found = list(shingle_sets(h, offsets, k))
                yield pa.RecordBatch.from_arrays([_shingle_lists(found).values], names=["shingle"])

    some = docs.select("text").sample(min(1.0, ORDER_ROWS / max(1, docs.count())), seed=1).dropDuplicates()
    often = some.mapInArrow(tidy(every), "shingle long").groupBy("shingle").count().where("count > 1")
    t = stored(often.orderBy(F.desc("count")).limit(ORDER_SHINGLES), "common").toArrow()
    shingle, count = np.asarray(t["shingle"]).view(U64), np.asarray(t["count"])
    order = np.argsort(shingle)
    return shingle[order], count[order]


def _rarest(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The rarest shingles of a set, so many that it shares one with the rarest of every set at that similarity.

    Two such sets have similarity * n shingles in common at least, n the size of
    either. The rarest of these, in an order that holds for all sets, has so few
    of either set before it.
    """
    if not len(s):
        return s
    few, (shingle, count) = len(s) - math.ceil(similarity * len(s) - 1e-6) + 1, common
    if not len(shingle):
        return s[:few]
    at = np.minimum(np.searchsorted(shingle, s), len(shingle) - 1)
    often = np.where(shingle[at] == s, count[at], 0)
    return s[np.argsort(often, kind="stable")[:few]] if often.any() else s[:few]


def _parity(s: np.ndarray) -> np.ndarray:
    """A bit for each place that hashes fall on, set where an odd number do; at least as many bits as shingles, a power of two of words."""
    bits = 64
    while bits < len(s):
        bits *= 2
    odd = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)


def _sketch(docs: DataFrame, k: int, tokens: int, common: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """(doc_id, tid, k1, k2, n, mins, rare, bits) of each row: a hash of its text, its set's two names and size, the first `tokens` sampled tokens, its rarest shingles and parities."""
    seeds = _seeds(0, tokens)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, offsets, _, _ in text_slices(b.column(2), fold=True):
                with np.errstate(over="ignore"):
                    found = list(shingle_sets(h, offsets, k))
                    both = _signed(np.array([_set_names(s) for s in found], U64)).reshape(-1, 2)
                    mins = _samples(found, seeds)
                rare, bits = _shingle_lists([_rarest(s, common, similarity) for s in found]), _shingle_lists([_parity(s) for s in found])
                part = b.slice(lo, hi - lo)
                size = pa.array([len(s) for s in found], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), size, mins, rare, bits], names=["doc_id", "tid", "k1", "k2", "n", "mins", "rare", "bits"])

    long = F.lit(0).cast("long")
    schema = docs.select("doc_id", long.alias("tid"), long.alias("k1"), long.alias("k2"), F.lit(0).alias("n"), *[F.array(long).alias(c) for c in ("mins", "rare", "bits")]).schema
    return docs.select("doc_id", text_hash().alias("tid"), "text").mapInArrow(tidy(sets), schema)


def _contents(docs: DataFrame, wanted: DataFrame, k: int, what: str, make) -> DataFrame:
    """(rep, what) of the sets of wanted (rep, uid, tid, k1, k2), made from the text of the row that stands for each. Rows that repeat give a set again."""
    u = row_number_of(docs, text_hash()).alias("uid")
    texts = docs.select(u, text_hash().alias("tid"), "text").join(small_side(wanted), ["uid", "tid"]).select("rep", "k1", "k2", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            rep, k1, k2 = (b.column(i).to_numpy() for i in range(3))
            for lo, _, h, offsets, _, _ in text_slices(b.column(3), fold=True):
                found, at = [], []
                with np.errstate(over="ignore"):
                    for i, s in enumerate(shingle_sets(h, offsets, k), lo):
                        name = _signed(np.array(_set_names(s), U64))
                        if rep[i] not in done and name[0] == k1[i] and name[1] == k2[i]:
                            done.add(rep[i])
                            found.append(s)
                            at.append(i)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), make(found)], names=["rep", what])

    return texts.mapInArrow(tidy(sets), f"rep long, {what} array<long>")


def _shingle_lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *[len(s) for s in found]]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(_signed(np.concatenate([np.zeros(0, U64), *found]))))


def _leaves(classes: DataFrame, docs: DataFrame, k: int, runs: int, small: int, dense: float) -> DataFrame:
    """(path, rep, bsets, bshingles): the buckets each set ends in, where it is not alone.

    A bucket of more than `small` sets is split again, as often as it takes,
    each set following BRANCHES sampled tokens; one of whose sets a token keeps
    the share `dense` or more together ends as it is. So every split leaves at most
    that share of a bucket, and splitting ends.
    """
    token = lambda level, b: F.get("mins", (F.lit(level * runs) + F.col("run")) * BRANCHES + b)
    ahead = [f"t{i}_{b}" for i in range(LEVELS) for b in range(BRANCHES)]
    cur = classes.select("rep", "n", "mins", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    cur = cur.select("rep", "n", "run", F.xxhash64("run").alias("path"), F.lit(0).cast("long").alias("bsets"), F.lit(0).cast("long").alias("bshingles"), *[token(i, b).alias(f"t{i}_{b}") for i in range(LEVELS) for b in range(BRANCHES)])
    done, level = [], 0
    while True:
        now = level % LEVELS
        if level and not now:  # tokens for the next splits, of the sets that are still in large buckets
            wanted = classes.select("rep", "uid", "tid", "k1", "k2").join(small_side(stored(cur.select("rep").distinct(), "deep")), "rep", "left_semi")
            seeds = _seeds(level * runs * BRANCHES, LEVELS * runs * BRANCHES)
            mins = _contents(docs, stored(wanted, "deeper"), k, "mins", lambda found, seeds=seeds: _samples(found, seeds)).dropDuplicates(["rep"])
            cur = cur.drop(*ahead).join(mins, "rep").select("rep", "n", "run", "path", "bsets", "bshingles", *[token(i, b).alias(f"t{i}_{b}") for i in range(LEVELS) for b in range(BRANCHES)])
            cur = stored(cur, f"tokens{level}")
        paths = F.array_distinct(F.array(*[F.xxhash64("parent", F.lit(level), f"t{now}_{b}") for b in range(BRANCHES)]))
        child = cur.drop("bshingles").withColumnsRenamed({"path": "parent", "bsets": "psets"}).withColumn("path", F.explode(paths))
        child = child.drop(*[f"t{now}_{b}" for b in range(BRANCHES)])
        size = child.groupBy("path", "parent", "psets").agg(F.count("*").alias("bsets"), F.sum("n").alias("bshingles")).where("bsets > 1")
        size = stored(size, f"sizes{level}")
        if level:
            alike = stored(size.where(F.col("bsets") >= dense * F.col("psets")).select("parent").distinct(), f"alike{level}")
            done.append(cur.join(small_side(alike), F.col("path") == F.col("parent"), "left_semi").select("path", "rep", "bsets", "bshingles"))
            size = size.join(small_side(alike), "parent", "left_anti")
        cur = stored(child.drop("parent", "psets").join(size.select("path", "bsets", "bshingles"), "path"), f"split{level}")
        done.append(cur.where(F.col("bsets") <= small).select("path", "rep", "bsets", "bshingles"))
        cur = cur.where(F.col("bsets") > small)
        level += 1
        if cur.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _first_met(values: np.ndarray, offsets: np.ndarray, path: int | None = None) -> np.ndarray:
    """Pairs of the sets with these paths (offsets: where each set's begin) that share no path less than this one, or none at all: there they have met."""
    m = len(offsets) - 1
    own, ids = np.repeat(np.arange(m), np.diff(offsets)), values[offsets[0] : offsets[-1]]
    if path is not None:
        own, ids = own[ids < path], ids[ids < path]
    fresh = np.ones((m, m), bool)
    if len(ids):
        _, which, often = np.unique(ids, return_inverse=True, return_counts=True)
        again = often[which] > 1
        if again.any():
            _, column = np.unique(which[again], return_inverse=True)
            for lo in range(0, int(column.max()) + 1, 4096):
                part = (column >= lo) & (column < lo + 4096)
                x = np.zeros((m, min(4096, int(column.max()) + 1 - lo)), np.float32)
                x[own[again][part], column[part] - lo] = 1
                fresh &= (x @ x.T) == 0
    np.fill_diagonal(fresh, False)
    return fresh


def _near(size: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of sets whose sizes allow a link."""
    size = size.astype(float)
    return np.minimum.outer(size, size) >= similarity * np.maximum.outer(size, size) - 1e-9


def _needed(members: DataFrame, similarity: float) -> DataFrame:
    """Members of small buckets that meet some other set there for the first time, at a size that allows a link."""

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["path"]):
            bounds, path, n = group_bounds(t, ["path"]), np.asarray(t["path"]), np.asarray(t["n"])
            paths, at = list_column(t["paths"])
            paths, keep = paths.view(np.int64), np.zeros(t.num_rows, bool)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                keep[a:b] = (_near(n[a:b], similarity) & _first_met(paths, at[a : b + 1], path[a])).any(axis=0)
            yield from t.filter(pa.array(keep)).to_batches()

    return members.repartition("path").sortWithinPartitions("path").mapInArrow(tidy(fresh), members.schema)


def _paired_blocks(members: DataFrame) -> DataFrame:
    """members with bi, bj and side: every pair of `blocks` blocks of a bucket is one group; a set goes to the pairs its block is in."""
    many = members.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)")))
    return many.withColumns({"bi": F.least("own", "o"), "bj": F.greatest("own", "o"), "side": F.when(F.col("own") <= F.col("o"), 0).otherwise(1)}).drop("own", "o")


def _apart(words: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair (i, j) of sets with these parities a number of shingles, at least, that only one of the two has."""
    width = np.array([len(w) for w in words])
    least, out = np.minimum(width[i], width[j]), np.zeros(len(i), np.int64)
    for w in np.unique(least):
        which = np.flatnonzero(least == w)
        members, at = np.unique(np.concatenate([i[which], j[which]]), return_inverse=True)
        x, y = np.split(at.reshape(-1), 2)
        folded = np.stack([np.bitwise_xor.reduce(words[m].reshape(-1, w), axis=0) for m in members])
        step = max(1, (1 << 20) // int(w))
        for lo in range(0, len(which), step):
            out[which[lo : lo + step]] = np.bitwise_count(folded[x[lo : lo + step]] ^ folded[y[lo : lo + step]]).sum(axis=1, dtype=np.int64)
    return out


def _unmet(classes: DataFrame, paths: DataFrame, similarity: float) -> DataFrame:
    """(path, rep) of the pairs of sets that may be linked and that no bucket holds, each pair as a bucket of its own.

    Linked sets share one of their rarest shingles. Shingles with the same sets
    make one group. In it, pairs are left of fitting sizes, without a common
    bucket, whose parities differ in no more bits than linked sets in shingles.
    As paths find nearly all that is similar, few are left.
    """
    those = Window.partitionBy("shingle")
    shared = classes.select("rep", "n", F.explode("rare").alias("shingle"))
    shared = shared.select("rep", F.count("*").over(those).alias("sets"), F.sum("n").over(those).alias("shingles"), F.bit_xor(F.xxhash64("rep")).over(those).alias("names")).where("sets > 1")
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / (64 * BLOCK_SHINGLES))).cast("int")
    groups = stored(shared.select(F.xxhash64("names", "sets").alias("path"), "rep", blocks.alias("blocks")).distinct(), "groups")
    members = _paired_blocks(groups).drop("blocks").join(classes.select("rep", "n", "bits"), "rep").join(paths, "rep", "left")
    members = members.withColumn("paths", F.coalesce("paths", F.array().cast("array<long>")))
    keys = ["path", "bi", "bj"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            rep, n, bi, bj, side = (np.asarray(t[c]) for c in ("rep", "n", "bi", "bj", "side"))
            (paths, at), (bits, cuts) = list_column(t["paths"]), list_column(t["bits"])
            bounds, out = group_bounds(t, keys), []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                allowed = np.triu(_near(n[a:b], similarity), 1)
                if bi[a] != bj[a]:
                    allowed &= side[a:b, None] != side[None, a:b]
                if not allowed.any():
                    continue
                i, j = np.nonzero(allowed & _first_met(paths, at[a : b + 1]))
                if len(i):
                    most = (1 - similarity) / (1 + similarity) * (n[a:b][i].astype(float) + n[a:b][j])
                    left = _apart([bits[cuts[r] : cuts[r + 1]] for r in range(a, b)], i, j) <= most + 1e-6
                    out.append(np.sort(np.column_stack([rep[a:b][i[left]], rep[a:b][j[left]]]), axis=1))
            if out:
                x = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, i].copy()) for i in range(2)], names=["a", "b"])

    left = members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(pairs), "a long, b long").distinct()
    return left.select(F.xxhash64("a", "b").alias("path"), F.explode(F.array("a", "b")).alias("rep"))


def _compare(size: np.ndarray, sets: list[np.ndarray], allowed: np.ndarray, similarity: float) -> np.ndarray:
    """Boolean matrix of the allowed pairs whose Jaccard similarity is enough."""
    m = len(sets)
    owner, values = np.repeat(np.arange(m), [len(s) for s in sets]), np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1])
    which = np.cumsum(new) - 1
    often = np.bincount(which)
    both = np.zeros((m, m), np.float32)
    # Shingles of many sets as columns of a dense matrix, those of few one by one.
    dense = np.flatnonzero(often > (1 if m <= 256 else 32))
    column = np.full(len(often), -1)
    column[dense] = np.arange(len(dense))
    at = column[which]
    step = max(256, (1 << 24) // m)
    for lo in range(0, len(dense), step):
        inside = (at >= lo) & (at < lo + step)
        x = np.zeros((m, min(step, len(dense) - lo)), np.float32)
        x[owner[inside], at[inside] - lo] = 1
        both += x @ x.T
    starts = np.flatnonzero(new)
    for g in np.flatnonzero((often > 1) & (column < 0)):
        o = owner[starts[g] : starts[g] + often[g]]
        both[np.ix_(o, o)] += 1
    total = size[:, None] + size[None, :] - both
    return allowed & (both >= similarity * total - 1e-9)


def _least_reached(linked: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """For each set the least rep that links lead to over any number of sets. The least direct neighbour would part chains."""
    order = np.argsort(rep, kind="stable")
    x, least = linked[np.ix_(order, order)], np.arange(len(rep))
    while True:
        now = np.minimum(least, np.where(x, least[None, :], len(rep)).min(axis=1))
        now = now[now]
        if (now == least).all():
            break
        least = now
    out = np.empty_like(rep)
    out[order] = rep[order][least]
    return out


def links(
    docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, small: int = SMALL, dense: float = DENSE
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, found): every row of docs, the classes of equal sets, and what the join found for each class.

    sets: doc_id, tid, k1, k2, n; classes: rep, k1, k2, n, copies, least (the
    first row of the class by doc_id, then tid); found: rep, root, links. rep
    stands for all rows with one set of shingles, root is the least rep linked to
    it over any number of links, links counts rows of other classes at
    `similarity` or more.

    In each run every set follows BRANCHES sampled tokens out of each bucket
    until its bucket has at most `small` sets, or is as alike as it gets. The
    number of runs follows from the recall wanted. A pair counts in the first
    bucket that both are in. Links are added up inside tasks and never leave
    them as pairs: only counts and one edge for each set to the least set that
    links in the bucket lead to, which keep components whole. Pairs that no bucket holds are
    looked for by their rarest shingles and compared too, so no link is left
    out, whatever the recall.
    """
    runs = runs_for(recall, similarity)
    sets = stored(_sketch(docs, k, LEVELS * runs * BRANCHES, _common(docs, k), similarity), "sets")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")
    classes = sets.where("n > 0").groupBy("k1", "k2").agg(F.min(row).alias("least"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "mins", "rare", "bits")])
    classes = classes.withColumns({"rep": F.monotonically_increasing_id(), "doc_id": F.col("least.doc_id"), "tid": F.col("least.tid")})
    classes = stored(classes.withColumn("uid", row_number_of(classes, F.col("tid"))).drop("doc_id"), "classes")
    leaves = stored(_leaves(classes, docs, k, runs, small, dense), "leaves")
    paths = stored(leaves.groupBy("rep").agg(F.collect_set("path").alias("paths")), "paths")
    members = leaves.join(classes.select("rep", "copies", "n"), "rep").join(paths, "rep")

    blocks = F.greatest(F.ceil(F.col("bsets") / BLOCK_SETS), F.ceil(F.col("bshingles") / BLOCK_SHINGLES)).cast("int")
    members = stored(members.withColumn("blocks", blocks).drop("bsets", "bshingles"), "members")
    parted = _needed(members.where("blocks = 1"), similarity).withColumns({"bi": F.lit(0), "bj": F.lit(0), "side": F.lit(0)})
    rest = _unmet(classes, paths, similarity).join(classes.select("rep", "copies", "n"), "rep")
    rest = rest.withColumns({"paths": F.array().cast("array<long>"), "bi": F.lit(0), "bj": F.lit(0), "side": F.lit(0)})
    asked = stored(parted.unionByName(_paired_blocks(members.where("blocks > 1"))).drop("blocks").unionByName(rest), "asked")

    wanted = classes.select("rep", "uid", "tid", "k1", "k2").join(small_side(stored(asked.select("rep").distinct(), "needed")), "rep", "left_semi")
    full = asked.join(_contents(docs, stored(wanted, "wanted"), k, "set", _shingle_lists), "rep")
    keys = ["path", "bi", "bj"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            bounds, path, n = group_bounds(t, keys), np.asarray(t["path"]), np.asarray(t["n"]).astype(np.int64)
            rep, copies, side = np.asarray(t["rep"]), np.asarray(t["copies"]), np.asarray(t["side"])
            bi, bj = np.asarray(t["bi"]), np.asarray(t["bj"])
            (paths, at), (flat, offsets) = list_column(t["paths"]), list_column(t["set"])
            paths, out = paths.view(np.int64), []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                allowed = _first_met(paths, at[a : b + 1], path[a]) & (rep[a:b, None] != rep[None, a:b])
                again = np.ones(b - a, bool)  # a row that stands there twice counts once
                again[np.unique(rep[a:b], return_index=True)[1]] = False
                allowed[again] = allowed[:, again] = False
                if bi[a] != bj[a]:
                    allowed &= side[a:b, None] != side[None, a:b]
                size = n[a:b]
                allowed &= _near(size, similarity)
                if not allowed.any():
                    continue
                linked = _compare(size, [flat[offsets[i] : offsets[i + 1]] for i in range(a, b)], allowed, similarity)
                if not linked.any():
                    continue
                has = np.flatnonzero(linked.any(axis=1))
                r = rep[a:b]
                out.append(np.column_stack([r[has], _least_reached(linked, r)[has], linked[has] @ copies[a:b]]))
            if out:
                x = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, i].copy()) for i in range(3)], names=["rep", "other", "links"])

    found = full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(verify), "rep long, other long, links long")
    found = stored(found, "found")
    roots = connected_components(found.select(F.col("rep").alias("u"), F.col("other").alias("v")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    return sets.drop("mins", "rare", "bits"), classes.select("rep", "k1", "k2", "n", "copies", "least"), counts.join(roots.withColumnRenamed("node", "rep"), "rep", "full")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, n_links, n_shingles, tid (a hash of the text), first.

    class_id: the least doc_id that links of `similarity` or more lead to, its
    own if there is none; rows without a doc_id count last, and only a class of
    such rows has a null class_id. n_links: other rows at that similarity, copies
    included. first: the row stands for its class, the least by doc_id and tid;
    equal rows are first together. A-Z are lower-cased, words stand between ASCII
    white space; a text of fewer than five words is one shingle of all its words;
    a null or blank text has no shingle, no link, and its own id as class, and is
    first. doc_ids may be of any type that has an order; rows that share one are
    judged by their texts. Columns other than doc_id and text are not read.
    """
    sets, classes, found = links(docs, **options)
    c = stored(classes.join(found, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "linked")
    top = c.groupBy("root").agg(F.min("least").alias("top"))
    c = c.join(small_side(stored(top, "tops")), "root").select("k1", "k2", "top", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    # Classes come with all that is asked of them, so the rows of a class of many copies take part in one join, which AQE can split.
    j = sets.join(small_side(stored(c, "names"), BROADCAST_ROWS // 8), ["k1", "k2"], "left")
    blank = F.col("n") == 0
    return j.select(
        "doc_id",
        F.when(blank, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("n").cast("long").alias("n_shingles"),
        "tid",
        (blank | (F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("tid") == F.col("top.tid")))).alias("first"),
    )
