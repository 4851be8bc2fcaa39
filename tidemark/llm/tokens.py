"""Token ids of a byte-level BPE vocabulary, encoded and decoded as streams of bounded memory."""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text taken in at a time, and bytes of one uncut piece merged at a time (more, if the lookahead needs it).
BLOCK, WINDOW = 16_384, 16_384
#: Pieces of up to so many characters are remembered with their ids, so many of them at once.
SHORT, REMEMBERED = 48, 1 << 17


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after a token's end beyond which nothing can change it, from the merge list alone.

    Whether a token is formed depends on what follows only through a chain of tokens, each of a higher priority (a
    smaller rank) than the one before it and overlapping its end: the first is what a later merge might take away from
    it, the second what might take that away, and so on. The answer is the longest stretch of text any such chain
    covers. Taken in order of rank, a token's own stretch is the longest of, for each of its proper suffixes, what comes
    before the suffix and the longest stretch of a token of smaller rank that begins with the suffix.
    """
    reach: dict[bytes, int] = {}  # by prefix: the longest stretch of the tokens so far that begin with it
    longest = 1
    for token in sorted(ranks, key=ranks.__getitem__):
        n = len(token)
        if n < 2:
            continue
        stretch = max([n, *(k + reach[token[k:]] for k in range(1, n) if token[k:] in reach)])
        longest = max(longest, stretch)
        for k in range(1, n + 1):
            reach[token[:k]] = max(reach.get(token[:k], 0), stretch)
    return longest


class _Pieces(dict):
    """Ids by piece; what is missing is merged, and remembered if it is short. Full, it begins anew."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> list[int]:
        ids = [i for run in self.merge(piece.encode()) for i in run]
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Transducer:
    """Encodes a text block by block and gives ids as soon as nothing that follows can change them.

    A text is first cut into pieces by PATTERN. The pattern looks at most one character beyond a piece, so a piece is
    final when two more characters are there, and the next one begins with no memory of it. The bytes of a piece are
    merged in a window: tokens that end at least ``lookahead`` bytes before the window's end are final and given, and
    the window moves on to where the last of them ends, as the encoding of what follows a token of an encoding is its
    rest. All texts and pieces, short or long, go this one way; what is held at a time is bounded by the block and the
    window (and by the longest piece, which the pattern can't let go before its end).
    """

    def __init__(self, ranks: dict[bytes, int], window: int = WINDOW, block: int = BLOCK, lookahead: int | None = None):
        import regex
        import tiktoken

        self.core = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.lookahead = sufficient_lookahead(ranks) if lookahead is None else lookahead
        self.block, self.window = block, max(window, self.lookahead + 2 * max(map(len, ranks)))
        self.cut = regex.compile(PATTERN).findall
        self.pieces = _Pieces(self.merge_stream)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return []
        return list(chain.from_iterable(self.stream(text[at : at + self.block] for at in range(0, len(text), self.block))))

    def stream(self, blocks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of the blocks' text, piece by piece, each given when it is final."""
        held, ids = "", self.pieces
        for block in blocks:
            if held:  # something follows: all but the last pieces are final
                found = self.cut(held)
                at = len(held)
                while found and at > len(held) - 2:
                    at -= len(found.pop())
                for piece in found:
                    yield ids[piece]
                held = held[at:]
            held += block
        for piece in self.cut(held):
            yield ids[piece]

    def _merge(self, piece: bytes) -> list[int]:
        return self.core._core_bpe.encode_single_piece(piece)

    def merge_stream(self, piece: bytes) -> Iterator[list[int]]:
        """Ids of one piece, in runs that are final when given."""
        start = 0
        while len(piece) - start > self.window:
            ids = self._merge(piece[start : start + self.window])
            ends = np.cumsum([len(self.bytes_of[i]) for i in ids])
            final = int(np.searchsorted(ends, self.window - self.lookahead, "right"))
            yield ids[:final]
            start += int(ends[final - 1])
        yield self._merge(piece[start:])

    def decode(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """The text of ids, piece by piece; bytes of a character split over tokens wait for the rest of it."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        held: list[bytes] = []
        for i in ids:
            held.append(self.bytes_of[i])
            if len(held) == block:
                yield machine.decode(b"".join(held))
                held = []
        yield machine.decode(b"".join(held), True)


@lru_cache(2)
def transducer(vocabulary: bytes, window: int = WINDOW, block: int = BLOCK) -> Transducer:
    """The transducer of a vocabulary file's content, one per Python worker."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return Transducer(ranks, window, block)


def load(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary file, sent once to each executor: under a megabyte, whatever the corpus."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def _encoder(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(vocabulary.value).encode
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for lo in range(0, len(texts), 512):  # lists of a few hundred texts at a time
                found = [encode(x) for x in texts.slice(lo, 512).to_pylist()]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                values = np.fromiter((i for x in found for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 512), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "ids"])

    return run


def token_ids(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row; empty and null texts give an empty list. No special tokens."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return spread(rows).mapInArrow(_encoder(load(documents.sparkSession, path)), "doc_id long, ids array<int>")


def _round_trip(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary.value)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            back = ["".join(machine.decode(machine.encode(x))) for x in texts]
            same = pa.array([x == y for x, y in zip(texts, back, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in back], pa.int64()), same], names=["doc_id", "n_chars", "same"])

    return run


def round_trip(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_chars, same): the length of what decoding a row's ids gives, and whether it is its text; a null text counts as empty."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return spread(rows).mapInArrow(_round_trip(load(documents.sparkSession, path)), "doc_id long, n_chars long, same boolean")
