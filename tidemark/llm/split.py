"""Oversized texts cut into overlapping pieces at natural places, by pointer doubling over successor tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import kernel as K
from tidemark.sources.tables import current, not_deleted

#: Twelfths of a token: a Han character weighs 1 / 1.5, any other 1 / 4.
HAN, OTHER, TOKEN = 8, 3, 12
#: A piece may end before the limit, at a better place, if it keeps this share of the limit.
LEAST_FILL = 0.5
#: An overlap may begin later, at a better place, if it keeps this share of its length.
LEAST_OVERLAP = 0.9

PIECES = "chunk_id long, piece_no int, section_path string, content string, start_pos int, end_pos int, n_tokens int"

_SENTENCE_ENDS = np.frombuffer("。！？.!?；;".encode("utf-32-le"), np.uint32)


@lru_cache(1)
def _joining() -> np.ndarray:
    """By code point: whether it belongs to the character before it."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "M" or c == 0x200D for c in range(0x110000)), bool, 0x110000)


def weights(codes: np.ndarray) -> np.ndarray:
    return np.where((codes >= K.HAN_FIRST) & (codes <= K.HAN_LAST), HAN, OTHER)


def levels(codes: np.ndarray) -> np.ndarray:
    """How good a place each position is to cut at, position i being before character i.

    3: after a line break; 2: after the end of a sentence; 1: between words or around a Han character; 0: inside a
    word; -1: never, as it would part a character from its marks or a line break in two.
    """
    n = len(codes)
    out = np.zeros(n + 1, np.int8)
    before, after = codes[:-1], codes[1:]
    space = K.spaces()[codes]
    han = (codes >= K.HAN_FIRST) & (codes <= K.HAN_LAST)
    stop = np.isin(codes, _SENTENCE_ENDS)
    inner = out[1:-1]
    inner[(space[:-1] & ~space[1:]) | han[:-1] | han[1:]] = 1
    # the last stop counts for the white space after it, too
    tail = np.where(space, 0, np.arange(1, n + 1))
    last = np.maximum.accumulate(tail)  # one past the last character that is no space
    ended = (last > 0) & stop[np.maximum(last - 1, 0)]
    wide = stop[:-1] & (before > 0x2FFF)
    inner[(ended[:-1] & space[:-1] & ~space[1:]) | (wide & ~stop[1:] & ~space[1:])] = 2
    inner[before == 10] = 3
    inner[(before == 13) & (after != 10)] = 3
    inner[_joining()[after] | ((before == 13) & (after == 10)) | (before == 0x200D)] = -1
    out[0] = out[-1] = 3
    return out


def _last(mark: np.ndarray) -> np.ndarray:
    """At each position, the last marked one up to it."""
    return np.maximum.accumulate(np.where(mark, np.arange(len(mark)), 0))


def _next(mark: np.ndarray) -> np.ndarray:
    """At each position, the next marked one from it on."""
    n = len(mark)
    return np.minimum.accumulate(np.where(mark, np.arange(n), n - 1)[::-1])[::-1]


def successors(codes: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For a piece that begins at each position: where it ends, and where the next one begins.

    The end is the farthest legal one of the best level found in the later part of the reach; the next piece
    begins so that the text both share is as long as ``overlap`` allows, at a good place if one is near, and
    always so that it gets further than this piece.
    """
    n = len(codes)
    level = levels(codes)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(weights(codes), out=total[1:])
    room, shared = TOKEN * (limit + 1) - 1, TOKEN * overlap
    at = np.arange(n + 1)
    allowed = level >= 0
    reach = np.searchsorted(total, total + room, "right") - 1
    end = np.where(_last(allowed)[reach] > at, _last(allowed)[reach], np.minimum(np.maximum(reach, at + 1), n))
    least = np.searchsorted(total, total + int(room * LEAST_FILL), "left")
    for better in (1, 2, 3):
        place = _last(level >= better)[reach]
        end = np.where((place > at) & (place >= np.minimum(least, reach)), place, end)
    end = np.where(reach >= n, n, end)

    # for each end: the first position from which the shared text is short enough
    begin = np.searchsorted(total, total - shared, "left")
    half = np.searchsorted(total, total - int(shared * (1 - LEAST_OVERLAP)), "left")  # at least so much is shared from here
    start = np.minimum(_next(allowed)[begin], at)
    for better in (1, 2, 3):
        place = _next(level >= better)[begin]
        start = np.where((place <= half) & (place < at), place, start)
    following = np.where(end < n, start[end], n)
    # a start from which the piece would end no later than this one is no start: the next place is then, up to this end
    onward = _next(allowed)
    stuck = np.flatnonzero((end < n) & ((following <= at) | (end[np.minimum(following, n)] <= end)))
    while len(stuck):
        later = np.minimum(onward[np.minimum(np.maximum(following[stuck], stuck) + 1, n)], end[stuck])
        following[stuck] = later
        stuck = stuck[(later < end[stuck]) & (end[later] <= end[stuck])]
    return end, following


def greedy_cuts(following: np.ndarray) -> np.ndarray:
    """Positions reached from 0 by repeated steps, found in a logarithmic number of rounds.

    Round r knows every position within 2**r steps and a table of 2**r steps at once; applying the table to the
    known ones and squaring it doubles both.
    """
    n = len(following) - 1
    known, jump = np.zeros(1, np.int64), following
    while True:
        more = np.unique(np.concatenate((known, jump[known])))
        if len(more) == len(known):
            return more[more < n]
        known, jump = more, jump[jump]


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, which together cover it; none for an empty text.

    ``limit`` is at least 1 and ``overlap`` from 0 to below it; anything else is a ValueError.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError(f"no pieces of {limit} tokens share {overlap}")
    if not text:
        return []
    codes, _ = K.flatten([text])
    end, following = successors(codes, limit, overlap)
    starts = greedy_cuts(following)
    return list(zip(starts.tolist(), end[starts].tolist(), strict=True))


def size(text: str) -> int:
    """Tokens a text counts for: of its characters without white space at both ends."""
    codes, _ = K.flatten([text.strip()])
    return int(weights(codes).sum()) // TOKEN if len(codes) else 0


def _splitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if size(r["content"]) <= r["max_tokens"]:
                continue
            base = r["start_pos"] or 0
            for k, (a, b) in enumerate(pieces(r["content"], r["max_tokens"], r["overlap_tokens"] or 0)):
                part = r["content"][a:b]
                rows.append((r["id"], k, r["section_path"], part, base + a, base + b, size(part)))
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def oversized_pieces(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every live chunk above the ``max_tokens`` of its content type.

    Result: chunk_id, piece_no (from 0), section_path, content (an exact slice of the chunk's), start_pos and
    end_pos in the file (the chunk's start_pos, 0 if null, plus the slice's bounds), n_tokens. Pieces are within
    the limit and cover the whole content; neighbours share at most ``overlap_tokens``, and nine tenths of them where
    the text has places to begin at. Null, empty and small contents, types without a limit and null limits give no
    pieces; a null overlap is none; repeated rows count once. A limit below 1, an overlap below 0 or not below its
    limit is a ValueError, found in the small table of limits before anything is cut.
    """
    limit = limits.where(F.col("content_type").isNotNull()).groupBy("content_type").agg(F.max(F.struct("max_tokens", "overlap_tokens")).alias("l"))
    limit = limit.select("content_type", "l.max_tokens", "l.overlap_tokens").where(F.col("max_tokens").isNotNull())
    share = F.coalesce("overlap_tokens", F.lit(0))
    if wrong := limit.where((F.col("max_tokens") < 1) | (share < 0) | (share >= F.col("max_tokens"))).head():
        raise ValueError(f"{wrong.content_type}: no pieces of {wrong.max_tokens} tokens share {wrong.overlap_tokens}")
    # no text can be too large that is within the limit with every character Han
    large = (
        chunks.where(F.col("content").isNotNull() & not_deleted() & F.col("id").isNotNull())
        .select("id", "updated_at", "content_type", "content", "section_path", "start_pos")
        .join(limit, "content_type")
        .where(F.char_length("content") * HAN >= TOKEN * (F.col("max_tokens") + 1))
    )
    # whether a row is the current one is decided on ids and times only; texts that are small are never shuffled
    newest = chunks.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("updated_at").alias("newest"))
    rows = large.join(newest, "id").where(F.col("updated_at").eqNullSafe(F.col("newest"))).drop("newest").dropDuplicates(["id"])
    return rows.mapInArrow(_splitter, PIECES)


def checked(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(chunk_id, within, covers, shares) of each chunk that is cut: whether every piece is within the limit, the pieces
    cover it without a gap, and neighbours share no more than they may."""
    limit = limits.groupBy("content_type").agg(F.max(F.struct("max_tokens", "overlap_tokens")).alias("l"))
    found = oversized_pieces(chunks, limits)
    order = Window.partitionBy("chunk_id").orderBy("piece_no")
    text = F.regexp_replace("shared", r"(?U)^\s+|\s+$", "")
    han = F.char_length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]+", ""))
    size_of = F.floor((han * HAN + (F.char_length(text) - han) * OTHER) / F.lit(TOKEN))
    rows = found.withColumn("before", F.lag("end_pos").over(order)).withColumn("next", F.lead("start_pos").over(order))
    rows = rows.withColumn("shared", F.expr("substring(content, 1, greatest(before - start_pos, 0))"))
    kinds = current(chunks.select("id", "updated_at", "content_type", F.coalesce("start_pos", F.lit(0)).alias("base"), F.char_length("content").alias("length")), "content_type", "base", "length").withColumnRenamed("id", "chunk_id")
    rows = rows.join(kinds, "chunk_id").join(F.broadcast(limit), "content_type")  # a row a content type
    touching = (F.col("before").isNull() & (F.col("start_pos") == F.col("base"))) | ((F.col("start_pos") <= F.col("before")) & (F.col("end_pos") > F.col("before")))
    ending = F.col("next").isNotNull() | (F.col("end_pos") == F.col("base") + F.col("length"))
    share = F.col("before").isNull() | (size_of <= F.coalesce("l.overlap_tokens", F.lit(0)))
    return rows.groupBy("chunk_id").agg(F.bool_and(F.col("n_tokens") <= F.col("l.max_tokens")).alias("within"), F.bool_and(touching & ending).alias("covers"), F.bool_and(share).alias("shares"))
