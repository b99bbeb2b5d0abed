"""Shared pieces: tables in the shared folder, size-checked broadcasts, rolling hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Rows up to which a narrow side (an id and a flag or two, under 32 bytes a row) is broadcast.
BROADCAST_ROWS = 2_000_000

#: ASCII white space, as Java's \s and the contracts' [\x20\x09-\x0D] have it.
SPACE = r"[\x20\x09-\x0D]"

U64 = np.uint64
ROLL = U64(0x9E3779B97F4A7C15)  # odd multiplier of the rolling hashes


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="tallyforge-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir()


def tidy(task: Callable) -> Callable:
    """A task over batches that gives freed memory back to the system at its end, as workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


#: Rows in one Arrow batch between the JVM and Python while stored() runs: whole texts are large rows.
BATCH_ROWS = 500

#: Folders written by stored() since each scratch() that is open, the innermost last.
_open: list[list[str]] = []


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: cuts lineage, survives lost executors.

    Results that are not stored run with Spark's own limit on the bytes of a batch instead of BATCH_ROWS.
    lasting: the folder outlives scratch().
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    if _open and not lasting:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that stored() writes inside are removed at the end: for steps whose result is stored after they ended."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows, else df for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def row_number_of(df: DataFrame, tid: Column, id_col: str = "doc_id") -> Column:
    """A long for the row's id: the id itself where ids are whole numbers, else its hash; for null a negative number made from the text.

    Together with text_hash() it names a row: rows that agree in both have one id and one text.
    """
    c = F.col(id_col)
    own = c.cast("long") if isinstance(df.schema[id_col].dataType, IntegralType) else F.when(c.isNotNull(), F.xxhash64(c.cast("string")))
    return F.coalesce(own, -F.abs(tid % (1 << 62)) - 1)


def named(docs: DataFrame, *more: str) -> DataFrame:
    """(uid, tid, text and the columns `more`) of docs: the two longs that name a row."""
    return docs.select(row_number_of(docs, text_hash()).alias("uid"), text_hash().alias("tid"), "text", *more)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive elements of h, by doubling: O(log k) passes."""
    if len(h) < k:
        return h[:0]
    done, power, n = None, ROLL, 0  # done: hashes of runs of n; part: of runs of size
    part, size = h.copy(), 1
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if done is None:
                    done, n, shift = part, size, power
                else:
                    m = len(h) - n - size + 1
                    done = done[:m] * power + part[n : n + m]
                    n += size
                if n == k:
                    return mix(done + U64(k))
            m = len(h) - 2 * size + 1
            if m > 0:
                part = part[:m] * power + part[size : size + m]
            power, size = power * power, size * 2


def list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat uint64 values and offsets of an array<long> column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)[offsets[0] : offsets[-1]]
    return values.view(U64), offsets - offsets[0]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that come sorted by keys; a group's rows are never parted."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        last = np.ones(t.num_rows, bool)
        for k in keys:
            c = np.asarray(t[k])
            last &= c == c[-1]
        cut = t.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield pa.concat_tables([*held, t.slice(0, cut)])
            held = []
        elif held and any(held[-1][k][0].as_py() != t[k][0].as_py() for k in keys):
            yield pa.concat_tables(held)
            held = []
        held.append(t.slice(cut))
    if held:
        yield pa.concat_tables(held)


def group_bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which groups begin, and the number of rows."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        c = np.asarray(t[k])
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 18
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: list[np.ndarray] = []


def _power_table() -> list[np.ndarray]:
    if not _powers:
        with np.errstate(over="ignore"):
            for base in (ROLL, U64(pow(int(ROLL), -1, 1 << 64))):
                p = np.full(SLICE_BYTES + 1, base, U64)
                p[0] = 1
                _powers.append(np.multiply.accumulate(p))
    return _powers


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each word; words in order."""
    power, inverse = _power_table()
    out = np.zeros(len(starts), U64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            if hi - lo > SLICE_BYTES:  # one huge word: the hashes of all its pieces, and its length
                at, h = np.arange(lo, hi, SLICE_BYTES), U64(hi - lo)
                for piece in hash_words(data, at, np.minimum(at + SLICE_BYTES, hi)):
                    h = h * ROLL + piece
                out[i] = mix(h)
            else:
                s = np.zeros(hi - lo + 1, U64)
                np.cumsum((data[lo:hi].astype(U64) + U64(1)) * power[: hi - lo], out=s[1:])
                a, e = starts[i:j] - lo, ends[i:j] - lo
                out[i:j] = mix((s[e] - s[a]) * inverse[a] + (e - a).astype(U64))
            i = j
    return out


def text_slices(column: pa.Array, fold: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, word offsets of the rows, starts, ends) of whole texts, SLICE_BYTES at a time.

    Words stand between ASCII white space; starts and ends are byte places in
    their own text. fold lower-cases A-Z first. Null texts have no words.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES, "right")) - 1)
        end = min(end, len(column))
        part = data[bounds[row] : bounds[end]]
        if fold:
            part = _FOLD[part]
        inside = ~_SPACES[part]
        edge = np.zeros(len(part) + 1, bool)
        cuts = bounds[row : end + 1] - bounds[row]
        edge[cuts] = True  # words do not run over texts
        begin = inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]]))
        stop = inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        offsets = np.searchsorted(starts, cuts)
        first = np.repeat(cuts[:-1], np.diff(offsets))
        yield row, end, hash_words(part, starts, ends), offsets, starts - first, ends - first
        row = end
