"""Repeated passages by sparse suffix arrays: suffixes at minimiser positions, sorted, compared and extended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, free_name, gram_hashes, list_column, mix, named, row_number_of, small_side, stored, text_hash, text_slices, tidy, whole_groups

#: Words a passage has at least, and words of the prefix by which suffixes are first sorted.
PASSAGE = 50
PREFIX = 15
#: Repeated prefixes up to which tasks get a map of them (2 ** MAP_BITS bits, 8 MB: a bit set in vain only keeps a
#: suffix for the exact step). More of them are joined with the suffixes instead.
MAP_ROWS = 4_000_000
MAP_BITS = 26
#: Suffixes of one prefix up to which one task compares them; those of a more frequent one are compared by partial aggregation.
HOT_ROWS = 10_000
#: Repeated windows of those up to which tasks get the least place of each (36 bytes); more are joined.
LOOKUP_ROWS = 500_000


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least of each w consecutive elements, by doubling."""
    at, size = np.arange(len(x)), 1
    while size < w:
        step = min(size, w - size)
        right = x[at[step:]] < x[at[:-step]]
        at = np.where(right, at[step:], at[:-step])
        size += step
    return at


def window_places(h: np.ndarray, offsets: np.ndarray, passage: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, rows, places, prefix hashes): the windows of `passage` words inside each text and their minimisers.

    The minimiser of a window is the place of its least prefix hash, the
    leftmost of equals. It follows from the window's words alone, so equal
    windows have it at equal offsets.
    """
    g = gram_hashes(h, prefix)
    if len(h) < passage:
        none = np.zeros(0, np.int64)
        return none, none, none, g
    places = sliding_argmin(g, passage - prefix + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(row[: len(places)] == row[passage - 1 : passage - 1 + len(places)])
    return starts, row[starts], places[starts], g


def _prefix_counts(docs: DataFrame, passage: int, prefix: int) -> DataFrame:
    """(key, c): prefix hashes that two or more retained suffixes begin with."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, h, offsets, _, _ in text_slices(b.column(0)):
                _, _, places, g = window_places(h, offsets, passage, prefix)
                if len(places):
                    once = places[np.append(True, places[1:] != places[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array(g[once].view(np.int64))], names=["key"])

    return docs.select("text").mapInArrow(tidy(keys), "key long").groupBy("key").agg(F.count("*").alias("c")).where("c > 1")


SUFFIX = "key long, uid long, tid long, start int, whs array<long>, vhs array<long>"


def _suffixes(docs: DataFrame, passage: int, prefix: int, keep=None) -> DataFrame:
    """SUFFIX rows: retained suffixes of docs (uid, tid, text), extended to the windows they stand for.

    whs and vhs have two independent hashes of each window that has the suffix
    as its minimiser, from start on: the prefix with so many words before it and
    the rest after it. keep: prefix hashes -> those that are wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, h, offsets, _, _ in text_slices(b.column(2)):
                starts, row, places, g = window_places(h, offsets, passage, prefix)
                key = g[places]
                if keep is not None:
                    wanted = keep(key)
                    starts, row, places, key = starts[wanted], row[wanted], places[wanted], key[wanted]
                if not len(starts):
                    continue
                new = np.flatnonzero(np.append(True, (places[1:] != places[:-1]) | (starts[1:] != starts[:-1] + 1)))
                ends = pa.array(np.append(new, len(starts)), pa.int32())
                with np.errstate(over="ignore"):
                    both = [pa.ListArray.from_arrays(ends, pa.array(gram_hashes(x, passage)[starts].view(np.int64))) for x in (h, mix(h + U64(1)))]
                at, rows = (starts - offsets[row]).astype(np.int32), pa.array(lo + row[new])
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), b.column(0).take(rows), b.column(1).take(rows), pa.array(at[new]), *both], schema=schema)

    schema = pa.schema([("key", pa.int64()), ("uid", pa.int64()), ("tid", pa.int64()), ("start", pa.int32()), ("whs", pa.list_(pa.int64())), ("vhs", pa.list_(pa.int64()))])
    return docs.select("uid", "tid", "text").mapInArrow(tidy(run), SUFFIX)


def _extended(docs: DataFrame, again: DataFrame, passage: int, prefix: int, hot_rows: int, map_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Extended suffixes whose prefix is repeated: of prefixes met up to hot_rows times, and of the others (None if there are none)."""
    if again.count() > map_rows:
        joined = stored(_suffixes(docs, passage, prefix).join(again, "key"), "suffixes")
        return joined.where(F.col("c") <= hot_rows).drop("c"), joined.where(F.col("c") > hot_rows).drop("c")
    slot = again.select(F.shiftrightunsigned("key", 64 - MAP_BITS).alias("slot"))
    words = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()  # at most 2 ** (MAP_BITS - 6) rows
    known = np.zeros(1 << (MAP_BITS - 6), np.int64)
    known[words["word"].to_numpy()] = words["bits"].to_numpy()
    hot = np.sort(again.where(F.col("c") > hot_rows).select("key").toArrow()["key"].to_numpy())  # at most map_rows
    sent = docs.sparkSession.sparkContext.broadcast((known, hot))

    def of(often: bool):
        def keep(key: np.ndarray) -> np.ndarray:
            known, hot = sent.value
            slot = (key >> U64(64 - MAP_BITS)).astype(np.int64)
            kept = (known[slot >> 6] >> (slot & 63)) & 1 == 1
            return kept & (np.isin(key.view(np.int64), hot) == often) if len(hot) else kept

        return _suffixes(docs, passage, prefix, keep)

    return of(False), of(True) if len(hot) else None


FOUND = "uid long, tid long, start int, n int, first long, kept boolean, own boolean"


def _windows_of(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(hash, hash, uid, tid, start) of each window of extended suffixes."""
    whs, vhs = (t.column(t.schema.names.index(c)) for c in ("whs", "vhs"))
    (wh, offsets), (vh, _) = list_column(whs), list_column(vhs)
    own = np.repeat(np.arange(t.num_rows), np.diff(offsets))
    uid, tid, start = (np.asarray(t.column(t.schema.names.index(c)))[own] for c in ("uid", "tid", "start"))
    return wh, vh, uid, tid, start.astype(np.int64) + np.arange(len(wh)) - offsets[:-1][own]


def _runs(uid: np.ndarray, tid: np.ndarray, start: np.ndarray, twice: np.ndarray, first: np.ndarray, kept: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """FOUND rows of the windows that are there twice; windows of one kind that follow one another in a text are one run."""
    apart = (uid[1:] != uid[:-1]) | (tid[1:] != tid[:-1]) | (start[1:] != start[:-1] + 1)
    cut = np.append(True, apart | (kept[1:] != kept[:-1]) | (own[1:] != own[:-1]) | (twice[1:] != twice[:-1]))
    runs = np.flatnonzero(cut)
    n = np.diff(np.append(runs, len(uid)))
    least = np.minimum.reduceat(first, runs)
    hit = twice[runs]
    columns = [uid[runs][hit], tid[runs][hit], start[runs][hit].astype(np.int32), n[hit].astype(np.int32), least[hit], kept[runs][hit], own[runs][hit]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", "tid", "start", "n", "first", "kept", "own"])


def _often(often: DataFrame, lookup_rows: int) -> DataFrame:
    """FOUND rows of suffixes whose prefix is frequent: each window is held against its least place, which partial aggregation finds."""
    often = stored(often.drop("key"), "often")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wh, vh, uid, tid, start = _windows_of(b)
            if not len(wh):
                continue
            order = np.lexsort((start, tid, uid, vh, wh))
            w, v = wh[order], vh[order]
            head = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])))
            low, high = order[head], order[np.append(head[1:], len(w)) - 1]
            columns = [wh[low].view(np.int64), vh[low].view(np.int64), *(c[at] for at in (low, high) for c in (uid, tid, start))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["whs", "vhs", "u0", "t0", "s0", "u1", "t1", "s1"])

    # The least and the last place of each window inside a batch: a window of many texts is one row of it.
    places = often.mapInArrow(tidy(ends), "whs long, vhs long, u0 long, t0 long, s0 long, u1 long, t1 long, s1 long")
    place = lambda n: F.struct(F.col(f"u{n}").alias("uid"), F.col(f"t{n}").alias("tid"), F.col(f"s{n}").cast("int").alias("start"))
    least = places.groupBy("whs", "vhs").agg(F.min(place(0)).alias("least"), F.max(place(1)).alias("most")).where("least <> most")
    least = stored(least.select("whs", "vhs", "least.uid", "least.tid", "least.start"), "least")
    if least.count() > lookup_rows:
        at = F.struct("uid", "tid", (F.col("start") + F.col("i")).alias("start")).alias("at")
        windows = often.select("uid", "tid", "start", F.posexplode(F.arrays_zip("whs", "vhs")).alias("i", "h")).select("h.whs", "h.vhs", at)
        windows = windows.join(least.withColumnsRenamed({"uid": "u", "tid": "t", "start": "s"}), ["whs", "vhs"])
        own = (F.col("at.uid") == F.col("u")) & (F.col("at.tid") == F.col("t"))
        return windows.select("at.uid", "at.tid", "at.start", F.lit(1), "u", own & (F.col("at.start") == F.col("s")), own)
    t = least.toArrow()
    wh, vh = (np.asarray(t[c]).view(U64) for c in ("whs", "vhs"))
    order = np.lexsort((vh, wh))
    sent = often.sparkSession.sparkContext.broadcast((wh[order], vh[order], *(np.asarray(t[c])[order] for c in ("uid", "tid", "start"))))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, others, uids, tids, starts = sent.value
        for b in batches:
            wh, vh, uid, tid, start = _windows_of(b)
            if not len(wh) or not len(keys):
                continue
            place = np.searchsorted(keys, wh)
            while True:  # past windows that agree in the first hash only
                inside = np.minimum(place, len(keys) - 1)
                on = (place < len(keys)) & (keys[inside] == wh) & (others[inside] != vh)
                if not on.any():
                    break
                place = place + on
            twice = (place < len(keys)) & (keys[inside] == wh)
            own = twice & (uids[inside] == uid) & (tids[inside] == tid)
            yield _runs(uid, tid, start, twice, uids[inside], own & (starts[inside] == start), own)

    return often.mapInArrow(tidy(look_up), FOUND)


def repeated_windows(docs: DataFrame, passage: int = PASSAGE, prefix: int = PREFIX, hot_rows: int = HOT_ROWS, map_rows: int = MAP_ROWS, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """(uid, tid, start, n, first, kept, own): n windows of `passage` words, the first at start, that stand at two or more places of docs (uid, tid, text).

    Suffixes are retained at minimiser positions only, and first sorted by
    their prefix; one whose prefix is met nowhere else goes. The others are
    extended left and right: each window that has the suffix as its minimiser is
    the prefix with so many words before it and the rest after it. Extended
    suffixes are sorted by all they hold and neighbours are compared by 128 bits
    of hash, so every alignment is tried and no choice of a partner hides a
    repeat. Suffixes of a prefix that is met more than hot_rows times are
    compared with their least place, found by partial aggregation, instead of in
    one task's order, so no task holds more than hot_rows suffixes of a prefix.
    first is the least uid that holds one of the windows; kept tells whether the
    windows stand here at their least place (uid, tid, start), own whether that
    is in this text at all.
    """
    again = stored(_prefix_counts(docs, passage, prefix), "prefixes")
    plain, often = _extended(docs, again, passage, prefix, hot_rows, map_rows)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key"]):
            wh, vh, uid, tid, start = _windows_of(t)
            order = np.lexsort((start, tid, uid, vh, wh))
            w, v, u, x, s = wh[order], vh[order], uid[order], tid[order], start[order]
            new = np.append(True, (w[1:] != w[:-1]) | (v[1:] != v[:-1]))
            other = np.append(False, (u[1:] != u[:-1]) | (x[1:] != x[:-1]) | (s[1:] != s[:-1])) & ~new  # a row that is there twice is one place
            head = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
            many = np.bincount(head, other, len(w))[head] > 0
            here = (u == u[head]) & (x == x[head])
            twice, first, kept, own = np.zeros(len(w), bool), np.zeros(len(w), np.int64), np.zeros(len(w), bool), np.zeros(len(w), bool)
            twice[order], first[order], kept[order], own[order] = many, u[head], here & (s == s[head]), here
            yield _runs(uid, tid, start, twice, first, kept, own)

    found = plain.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(neighbours), FOUND)
    return found if often is None else found.union(_often(often, lookup_rows))


RUNS = "array<struct<start:int,n:int,first:long>>"
SPANS = f"uid long, tid long, cut {RUNS}, kept {RUNS}, gone {RUNS}"
#: Spans, and rows that have some, up to which they are broadcast (about 60 bytes each).
BROADCAST_SPANS = 500_000


def _merged(start: np.ndarray, end: np.ndarray, first: np.ndarray) -> list[dict]:
    """Maximal runs of words in [start, end), with the least first place."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, first = start[order], first[order]
    end = np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    least = np.minimum.reduceat(first, new)
    return [{"start": int(a), "n": int(b - a), "first": int(f)} for a, b, f in zip(start[new], end[np.append(new[1:], len(start)) - 1], least, strict=True)]


def _without(runs: list[dict], kept: list[dict]) -> list[tuple[int, int, int]]:
    """(start, end, first) of what the kept runs leave of runs; both are apart and in order."""
    parts, i = [], 0
    for r in runs:
        at, end = r["start"], r["start"] + r["n"]
        while i < len(kept) and kept[i]["start"] + kept[i]["n"] <= at:
            i += 1
        j = i
        while j < len(kept) and kept[j]["start"] < end:
            if kept[j]["start"] > at:
                parts.append((at, kept[j]["start"], r["first"]))
            at = kept[j]["start"] + kept[j]["n"]
            j += 1
        if at < end:
            parts.append((at, end, r["first"]))
    return parts


def repeats(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(uid, tid, cut, kept, gone) for each document with a repeated passage; uid is its doc_id, tid a hash of its text.

    cut: runs of words (start, n, least first doc_id) inside windows that stood
    at an earlier place, by doc_id and then position; kept: runs inside windows
    that stand here first; gone: the runs that go so that a passage is left once.
    Those are the cut runs, but of windows whose first place is in this same text
    only the words that no kept window covers, as a period would else cut its own
    first place. Words are what stands between ASCII white space, as
    written. A text of fewer than `passage` words, empty or null repeats nothing.
    Equal rows are one place; rows with one doc_id and different texts are places
    of their own, in the order of tid. doc_ids of any type are taken: uid is a
    hash for those that are no whole numbers, a negative number made from the
    text where there is none. Other columns are not read.
    """
    found = repeated_windows(named(docs), passage)
    names = ["start", "n", "first", "kept", "own"]
    per = found.groupBy("uid", "tid").agg(F.collect_list(F.struct(*names)).alias("s")).select("uid", "tid", *[F.col("s")[c].alias(c) for c in names])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("first", pa.int64())]))
        for b in batches:
            cut, kept, gone = [], [], []
            for i in range(b.num_rows):
                s, n, f, k, own = (np.asarray(b.column(c)[i].values.to_numpy(zero_copy_only=False)) for c in (2, 3, 4, 5, 6))
                k, own, end = k.astype(bool), own.astype(bool), s + n - 1 + passage
                cut.append(_merged(s[~k], end[~k], f[~k]))
                kept.append(_merged(s[k], end[k], f[k]))
                again = own & ~k
                parts = np.array(_without(_merged(s[again], end[again], f[again]), kept[-1]), np.int64).reshape(-1, 3)
                gone.append(_merged(*(np.append(x[~own], parts[:, j]) for j, x in enumerate((s, end, f)))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, types) for x in (cut, kept, gone))], names=["uid", "tid", "cut", "kept", "gone"])

    return per.mapInArrow(tidy(spans), SPANS)


def cut_repeats(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """docs with each repeated passage left at its first place only; the columns stay, n_chars follows the text.

    Bytes from the first to the last word of each cut run go, the rest stays as
    it is. A document of which no word is left goes too; one without a cut is
    unchanged to the byte, a null or blank text included. Of a passage that
    repeats inside one text, overlapping itself or not, the first place stays whole.
    Where windows of two texts overlap, the words shared with the earlier text go. Rows are told apart by
    id and text, so rows that share an id keep what repeats nowhere; equal rows
    are cut alike. Columns of any name may stand beside doc_id and text.
    """
    spans = stored(repeats(docs, passage).where(F.size("gone") > 0).select("uid", "tid", "gone"), "spans")
    many = spans.agg(F.sum(1 + F.size("gone"))).first()[0] or 0
    schema, at = docs.schema, docs.columns.index("text")
    u, t, c, u2, t2 = (free_name(docs, n) for n in ("uid", "tid", "cut", "span_uid", "span_tid"))
    d = docs.select("*", row_number_of(docs, text_hash()).alias(u), text_hash().alias(t))
    spans = spans.select(F.col("uid").alias(u2), F.col("tid").alias(t2), F.col("gone").alias(c))
    same = (F.col(u) == F.col(u2)) & (F.col(t) == F.col(t2))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, texts, keep = b.column(at), b.column(at).to_pylist(), np.ones(b.num_rows, bool)
            runs = b.column(b.num_columns - 1)
            todo = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False))
            if len(todo):
                for lo, _, _, offsets, starts, ends in text_slices(column.take(pa.array(todo))):
                    for i in range(len(offsets) - 1):
                        row = todo[lo + i]
                        s, e = starts[offsets[i] : offsets[i + 1]], ends[offsets[i] : offsets[i + 1]]
                        raw, left, at_byte, words = texts[row].encode(), [], 0, len(s)
                        for r in runs[row].as_py():
                            left.append(raw[at_byte : s[r["start"]]])
                            at_byte = e[r["start"] + r["n"] - 1]
                            words -= r["n"]
                        texts[row] = b"".join([*left, raw[at_byte:]]).decode()
                        keep[row] = words > 0
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, column.type)
            out = pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])
            yield out.filter(pa.array(keep))

    # Stored, so that tasks hold BATCH_ROWS texts at once; what is then left to the caller's plan is no Python over whole texts.
    if many > BROADCAST_SPANS:
        out = stored(d.join(spans, same, "left").select(*docs.columns, c).mapInArrow(tidy(cut), schema), "cut")
    else:
        done = stored(d.join(F.broadcast(spans), same).select(*docs.columns, c).mapInArrow(tidy(cut), schema), "cut")
        out = d.join(F.broadcast(spans.select(u2, t2)), same, "left_anti").select(*docs.columns).union(done)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
