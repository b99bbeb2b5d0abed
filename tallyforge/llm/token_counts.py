"""Encoded lengths and their exact histogram."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

#: Folder of public vocabulary files, and the file used; parameters everywhere.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokenisation pattern published with that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths in one block of the two-level suffix sums.
BLOCK = 4096

_encoders: dict[str, object] = {}


def encoder(vocabulary: str, folder: str = TOKENIZERS):
    """A tiktoken encoder of a vocabulary file, one for each process."""
    import tiktoken

    path = os.path.join(folder, vocabulary)
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[path] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


#: Characters from which a text is encoded in parts, and in a run of white space from which the run is encoded by itself.
PART = 200_000
RUN = 20_000
_GAPS = regex.compile(r"\p{White_Space}+")
_PIECES = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def encoded_length(text: str | None, enc) -> int:
    """Tokens of a whole text; null and empty: 0.

    Long texts are encoded in parts, cut where the pattern always begins a new
    piece: before white space that follows something else. Of a long run of white
    space the pattern makes one piece, without the last character unless the text
    ends there; a long run of anything else is taken apart by the pattern itself.
    Pieces are merged one by one, so no text is too long for the matcher.
    """
    if not text:
        return 0
    if len(text) <= RUN:
        return len(enc.encode_ordinary(text))
    total, start, end = 0, 0, 0  # text[start:end] waits to be encoded together
    of = lambda piece: len(enc._encode_single_piece(piece.encode()))
    gaps = _GAPS.finditer(text)
    gap = next(gaps, None)
    if gap is None or gap.start() > 0:  # what stands before the first gap
        end = gap.start() if gap else len(text)
    while True:
        if end - start > PART:
            total += sum(of(m.group()) for m in _PIECES.finditer(text, start, end)) if end - start > 2 * PART else len(enc.encode_ordinary(text[start:end]))
            start = end
        if gap is None:
            break
        after = next(gaps, None)
        stop = after.start() if after else len(text)
        if gap.end() - gap.start() > RUN or stop - gap.end() > PART:
            total += len(enc.encode_ordinary(text[start:end]))
            last = gap.end() if gap.end() == len(text) else gap.end() - 1
            if last > gap.start():
                total += of(text[gap.start() : last])
            total += sum(of(m.group()) for m in _PIECES.finditer(text[last:stop]))
            start = end = stop
        else:
            end = stop
        gap = after
    return total + len(enc.encode_ordinary(text[start:end]))


def with_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and n_tokens (long) of every row: the encoded length of its whole text; null and empty: 0."""
    schema = docs.select(*keep).schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, folder)
        for b in batches:
            n = pa.array([encoded_length(x.as_py(), enc) for x in b.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(tidy(count), schema)


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length, one row for each length that occurs."""
    return lengths.groupBy(F.col(length).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Histogram with, for each length L, what holds at a context limit of L:

    docs_at_least, tokens_at_least (over documents of L tokens or more),
    truncated_tokens (sum of min(length, L) over all documents), whole_docs
    (those that fit), share_at_most (their share, so quantiles read off it).
    Sums run in two levels, blocks of BLOCK lengths and inside blocks, so no
    task gets all lengths. The histogram is written once, as three branches read
    it and each would encode all texts again. An empty histogram gives no rows.
    """
    hist = stored(hist, "histogram")
    h = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("t"), F.floor(F.col("n_tokens") / BLOCK).alias("b"))
    blocks = h.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    # One row for each BLOCK lengths: this window sees 1/BLOCK of the longest length.
    after = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.withColumns({"ad": F.coalesce(F.sum("bd").over(after), zero), "at": F.coalesce(F.sum("bt").over(after), zero)})
    total = hist.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("all_tokens"))
    inside = Window.partitionBy("b").orderBy(F.col("n_tokens").desc())
    s = h.join(blocks.select("b", "ad", "at"), "b").withColumns(
        {"docs_at_least": F.col("ad") + F.sum("n_docs").over(inside), "tokens_at_least": F.col("at") + F.sum("t").over(inside)}
    )
    s = s.join(F.broadcast(total))  # one row
    whole = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return s.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        whole.alias("whole_docs"),
        (whole / F.col("all_docs")).alias("share_at_most"),
    )


def quantile_at(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length L with at least that share of documents at most L tokens long."""
    rows = [F.min(F.when(F.col("share_at_most") >= p, F.col("n_tokens"))).alias(f"q{i}") for i, p in enumerate(shares)]
    one = sums.agg(*rows)
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, p in enumerate(shares)])).alias("x")).select("x.*")


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """(limit, truncated_tokens): the sum of min(length, limit) over all documents, for any limit, from the suffix sums."""
    above = sums.where(F.col("n_tokens") > limit)
    below = sums.where(F.col("n_tokens") <= limit).agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("low"))
    high = above.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("high"))
    return below.join(F.broadcast(high)).select(F.lit(limit).cast("long").alias("limit"), (F.col("low") + F.lit(limit) * F.col("high")).alias("truncated_tokens"))
