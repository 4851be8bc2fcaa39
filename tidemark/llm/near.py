"""Near-duplicate texts: MinHash bands, Bayesian pruning of candidates, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel as K
from tidemark.llm.copies import canonical_text, with_keys
from tidemark.session import materialise, shuffle_partitions, spread
from tidemark.sources.tables import not_deleted

#: A pair is a candidate if all ROWS MinHash values of one of BANDS bands agree. At a similarity of 0.5 a pair is
#: missed with (1 - 0.5 ** ROWS) ** BANDS = 4.5 %, at 0.55 with 1 %, at 0.6 with 0.13 %, at 0.7 with 2 in a million.
BANDS, ROWS = 48, 4
#: Values compared until each look, and how likely a pair must still be to reach the threshold. The first 64 travel with
#: every band entry, the others are fetched only for pairs that those leave.
NEAR_LOOKS, FAR_LOOKS, TOLERANCE = (16, 32, 48, 64), (128, 192), 0.002
#: Band entries of a bucket on average; buckets of more than HOT are split, into parts of at most half as many.
BUCKET, HOT = 16_384, 65_536
MOST_BUCKETS = 1 << 18
#: Slots that the exact search counts shingles in, to know the rare ones.
SLOTS = 1 << 20

SKETCH = "id long, updated_at long, gone boolean, k1 long, k2 long, text_class long, bands binary, bits binary"
ENTRIES = "task int, is_cross boolean, side boolean, entries binary"
PAIRS = "a long, b long"
SETS = "text_class long, shingles binary"
ENTRY = np.dtype([("key", "<u2"), ("text_class", "<i8"), ("bits", "<u8")])


@lru_cache(1)
def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    seeds = K.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
    seeds = (seeds >> np.uint64(32)).astype(np.uint32)
    return seeds[: BANDS * ROWS], seeds[BANDS * ROWS :] | np.uint32(1)


def _signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values of each text, a row each; ``values`` grouped by text."""
    xors, factors = _hash_family()
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), len(xors)), np.uint32)
    work = np.empty_like(short)
    for k in range(len(xors)):
        np.bitwise_xor(short, xors[k], out=work)
        np.multiply(work, factors[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def _pack_bits(signatures: np.ndarray) -> np.ndarray:
    """One bit of each of the values of a signature that are compared, 64 to a word, a row each text."""
    bits = (signatures[:, : FAR_LOOKS[-1]] >> np.uint32(13)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    """A number of 32 bits for the ROWS values of each band, a row each text."""
    rows = signatures[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = rows[:, :, 0]
    for k in range(1, ROWS):
        key = K.mix(key) + rows[:, :, k]
    return (K.mix(key) >> np.uint64(32)).astype("<u4")


def _text_shingles(texts: list[str], words: int, min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the texts that are long enough, grouped by text, and the text of each."""
    hashes, owner = K.token_hashes(*K.flatten(texts))
    enough = np.bincount(owner, minlength=len(texts)) >= max(min_tokens, words)
    return K.unique_by_owner(*K.shingles(hashes[enough[owner]], owner[enough[owner]], words))


def _frequencies(rows: DataFrame, words: int, min_tokens: int) -> np.ndarray:
    """How many rows have a shingle of each of SLOTS slots: an array of a fixed size, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            texts = [(x or "").lower() for x in batch.column("content").to_pylist()]
            for lo, hi in K.slices(texts):
                values, _ = _text_shingles(texts[lo:hi], words, min_tokens)
                total += np.bincount((values % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    found = rows.select("content").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _prefixes(values: np.ndarray, starts: np.ndarray, threshold: float, frequency: np.ndarray) -> list[bytes]:
    """Of each text the shingles of which a similar text must share one: in an order that is the same for all texts, rare
    ones first, all but the last ``ceil(threshold * n) - 1``."""
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    values = values[np.lexsort((values, frequency[(values % np.uint64(SLOTS)).astype(np.int64)], owner))]
    ends = np.append(starts[1:], len(values))
    return [(values[a : b - int(np.ceil(threshold * (b - a) - 1e-9)) + 1] >> np.uint64(32)).astype("<u4").tobytes() for a, b in zip(starts, ends, strict=True)]


def _sketcher(words: int, min_tokens: int, exact: float | None, frequency):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").lower() for x in batch.column("content").to_pylist()]
            small = batch.drop_columns(["content"])
            for lo, hi in K.slices(texts):
                n = hi - lo
                values, of = _text_shingles(texts[lo:hi], words, min_tokens)
                at, starts = np.unique(of, return_index=True)
                classes, bits, bands = np.zeros(n, np.int64), np.full(n, None, object), np.full(n, None, object)
                if len(at):
                    sizes = np.diff(np.append(starts, len(values))).astype(np.uint64)
                    classes[at] = K.mix(np.add.reduceat(K.mix(values), starts) + sizes).view(np.int64)
                    found = _signatures(values, starts)
                    bits[at] = [x.tobytes() for x in _pack_bits(found)]
                    bands[at] = [x.tobytes() for x in _band_keys(found)] if exact is None else _prefixes(values, starts, exact, frequency.value)
                none = ~np.isin(np.arange(n), at)
                yield pa.RecordBatch.from_arrays(
                    [*small.slice(lo, n).columns, pa.array(classes, mask=none), pa.array(bands, pa.binary()), pa.array(bits, pa.binary())],
                    names=[*small.schema.names, "text_class", "bands", "bits"],
                )

    return run


def sketches(chunks: DataFrame, words: int, min_tokens: int, exact: float | None = None) -> DataFrame:
    """A row of each row of ``chunks``: small columns, class of the shingle set, band keys, and bits; one pass over the texts."""
    given = spread(chunks.where(F.col("id").isNotNull()).select("id", "updated_at", "is_deleted", "content"))
    given = given.select(F.col("id").cast("long"), F.col("updated_at").cast("long"), (~not_deleted() | F.col("content").isNull()).alias("gone"), "content")
    rows = with_keys(given, canonical_text(F.col("content"))).select("id", "updated_at", "gone", "k1", "k2", "content")
    frequency = None if exact is None else chunks.sparkSession.sparkContext.broadcast(_frequencies(rows, words, min_tokens))
    return rows.mapInArrow(_sketcher(words, min_tokens, exact, frequency), SKETCH)


@dataclass(frozen=True)
class Tasks:
    """How the entries of each bucket are compared: in one task, or, split into parts, in a task for every two parts."""

    parts: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, buckets: int, large: dict[int, int], part: int) -> Tasks:
        parts = np.ones(buckets, np.int64)
        for bucket, n in large.items():
            parts[bucket] = -(-n // part)
        each = parts * (parts + 1) // 2
        return cls(parts, np.cumsum(each) - each)

    def spread(self, bucket: np.ndarray, classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For the entries: places, tasks, whether the task compares two parts, and whether the entry is of the second. A split entry goes to each task of its part."""
        n = self.parts[bucket]
        one = np.flatnonzero(n == 1)
        yield one, self.first[bucket[one]], np.zeros(len(one), bool), np.zeros(len(one), bool)
        many = np.flatnonzero(n > 1)
        n, first = n[many], self.first[bucket[many]]
        mine = (K.mix(classes[many].view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
        for other in range(int(n.max(initial=0))):
            has = n > other
            i, s, at = mine[has], n[has], first[has]
            lo, hi = np.minimum(i, other), np.maximum(i, other)
            yield many[has], at + lo * s - lo * (lo - 1) // 2 + hi - lo, lo != hi, i > other


def _keys(batch: pa.RecordBatch, buckets: int, numbered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every entry of a batch: its bucket, key, and the place of its text among the batch's different ones; and those texts' rows."""
    _, rows = np.unique(batch.column("text_class").to_numpy(), return_index=True)  # copies count once
    blobs = batch.column("bands").take(pa.array(rows)).to_pylist()
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    values = np.frombuffer(b"".join(blobs), "<u4").astype(np.uint64)
    if numbered:
        values = values + (np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), len(rows)) << np.uint64(32))
    hashes = K.mix(values)
    bucket = ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
    return bucket, (hashes >> np.uint64(48)).astype("<u2"), np.repeat(np.arange(len(rows)), sizes), rows


def _words(column: pa.Array) -> np.ndarray:
    """The bits of signatures as words of 64, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), FAR_LOOKS[-1] // 64)


def _counter(buckets: int, numbered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_keys(batch, buckets, numbered)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def _banded(tasks: Tasks, numbered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = len(tasks.parts)
        for batch in batches:
            bucket, key, text, rows = _keys(batch, buckets, numbered)
            entries = np.empty(len(bucket), ENTRY)
            entries["key"] = key
            entries["text_class"] = batch.column("text_class").to_numpy()[rows][text]
            entries["bits"] = _words(batch.column("bits").take(pa.array(rows)))[text, 0]
            for at, task, cross, side in tasks.spread(bucket, entries["text_class"].copy()):
                if not len(at):
                    continue
                order = np.lexsort((side, task))
                at, task, cross, side = at[order], task[order], cross[order], side[order]
                starts = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (side[1:] != side[:-1])])
                raw = entries[at].tobytes()
                offsets = pa.array((np.append(starts, len(at)) * ENTRY.itemsize).astype(np.int32)).buffers()[1]
                blobs = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(task[starts].astype(np.int32)), pa.array(cross[starts]), pa.array(side[starts]), blobs], names=["task", "is_cross", "side", "entries"])

    return run


@lru_cache(8)
def least_agreements(threshold: float, tolerance: float) -> dict[int, int]:
    """By number of bits compared, the fewest that must agree for a pair to be kept.

    Of texts of similarity s, a bit agrees with probability (1 + s) / 2. With every s equally likely beforehand, a
    pair is dropped when the probability that s reaches the threshold, given the agreements so far, is below
    ``tolerance``.
    """
    s = np.linspace(0, 1, 4001)
    p = np.clip((1 + s) / 2, 1e-12, 1 - 1e-12)
    out = {}
    for n in (*NEAR_LOOKS, *FAR_LOOKS):
        log = np.arange(n + 1)[:, None] * np.log(p) + (n - np.arange(n + 1))[:, None] * np.log(1 - p)
        weight = np.exp(log - log.max(1, keepdims=True))
        after = weight[:, s >= threshold].sum(1) / weight.sum(1)
        out[n] = int(np.argmax(after >= tolerance))
    return out


def prune(left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Positions of the pairs that stay after every look at their first word; each looks only at what the one before left."""
    alive = np.arange(len(left))
    differ = left ^ right
    for n in NEAR_LOOKS:
        mask = np.uint64((1 << n) - 1)
        agree = n - np.bitwise_count(differ[alive] & mask).astype(np.int64)
        alive = alive[agree >= least_agreements(threshold, tolerance)[n]]
    return alive


def prune_further(left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """The same for the words after it."""
    alive = np.arange(len(left))
    for n in FAR_LOOKS:
        agree = n - np.bitwise_count(left[alive, : n // 64] ^ right[alive, : n // 64]).sum(1).astype(np.int64)
        alive = alive[agree >= least_agreements(threshold, tolerance)[n]]
    return alive


def _pruner(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(prune_further(_words(batch.column("x")), _words(batch.column("y")), threshold, tolerance))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return run


def _pairs(entries: np.ndarray, side: np.ndarray, cross: bool, threshold: float, tolerance: float) -> pa.RecordBatch:
    """The pairs of equal keys that pruning leaves; with ``cross`` only those of two sides."""
    order = np.lexsort((entries["text_class"], entries["key"]))
    key, text, bits, side = entries["key"][order], entries["text_class"][order], entries["bits"][order], side[order]
    keep = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])] if len(key) else np.zeros(0, bool)
    key, text, bits, side = key[keep], text[keep], bits[keep], side[keep]
    found, d = [], 1
    at = np.arange(len(key))
    while len(at := at[at + d < len(key)]):
        at = at[key[at] == key[at + d]]
        asked = at[side[at] != side[at + d]] if cross else at
        if len(asked):
            some = asked[prune(bits[asked], bits[asked + d], threshold, tolerance)]
            found.append(np.stack([text[some], text[some + d]]))
        d += 1
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    a, b = np.unique(np.sort(pairs, axis=0), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _matcher(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cross, held = None, False, []

        def answer() -> pa.RecordBatch:
            entries = [np.frombuffer(raw, ENTRY) for raw, _ in held]
            side = np.repeat([x for _, x in held], [len(e) for e in entries])
            return _pairs(np.concatenate(entries), side, cross, threshold, tolerance)

        for batch in batches:
            for task, is_cross, side, raw in zip(*(batch.column(c).to_pylist() for c in ("task", "is_cross", "side", "entries")), strict=True):
                if task != at and held:
                    yield answer()
                    held = []
                at, cross = task, is_cross
                held.append((raw, side))
        if held:
            yield answer()

    return run


def _setter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").lower() for x in batch.column("content").to_pylist()]
            for lo, hi in K.slices(texts):
                values, owner = K.unique_by_owner(*K.shingles(*K.token_hashes(*K.flatten(texts[lo:hi])), words))
                at = (np.searchsorted(owner, np.arange(hi - lo + 1)) * 8).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.astype("<u8").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("text_class").slice(lo, hi - lo), blobs], names=["text_class", "shingles"])

    return run


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("left", "right")]
            sizes = [np.fromiter(map(len, x), np.int64, len(x)) // 8 for x in sides]
            good = np.zeros(batch.num_rows, bool)
            cuts = np.flatnonzero(np.diff((sizes[0] + sizes[1]).cumsum() // K.SLICE_CHARS)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
                n = hi - lo
                values = np.frombuffer(b"".join([*sides[0][lo:hi], *sides[1][lo:hi]]), "<u8")
                owner = np.repeat(np.tile(np.arange(n), 2), np.concatenate([x[lo:hi] for x in sizes]))
                union = np.bincount(K.unique_by_owner(values, owner)[1], minlength=n)
                both = np.bincount(owner, minlength=n) - union
                good[lo:hi] = (both > 0) & (both >= threshold * union)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _live_members(sketched: DataFrame) -> DataFrame:
    """(id, updated_at, text_class, k1, k2) of the current rows that are live and long enough."""
    state = F.struct("updated_at", "gone", "text_class", "k1", "k2")
    now = sketched.groupBy("id").agg(F.max(state).alias("s")).where(~F.col("s.gone") & F.col("s.text_class").isNotNull())
    return now.select("id", "s.updated_at", "s.text_class", "s.k1", "s.k2")


def similar_classes(chunks: DataFrame, words: int = 3, threshold: float = 0.5, min_tokens: int = 40, tolerance: float = TOLERANCE, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members of each class of equal shingle sets, and the pairs of different classes that are similar.

    Members: (id, updated_at, text_class, k1, k2), live rows of at least ``min_tokens`` tokens only. Pairs: (a, b),
    a < b, classes whose sets of runs of ``words`` tokens have a Jaccard similarity of at least ``threshold``.
    Equal texts are one class from the first task on, so copies, however many, cost no pairs. Which bands are hot is
    counted before anything is compared: a bucket of too many entries is split, and every two of its parts meet in a
    task of their own. What 64 MinHash bits leave there is compared by 192 of them. Only texts that are in a candidate are read again, and turned into shingle sets once.

    ``exact`` finds every pair: candidates are then all that share one of the shingles of which two similar texts must
    share one, and none is pruned. It costs as many comparisons as there are pairs with a shingle in common there.
    """
    spark = chunks.sparkSession
    sketched = materialise(sketches(chunks, words, min_tokens, threshold if exact else None), "near-sketches")
    members = materialise(_live_members(sketched), "near-members")
    banded = sketched.where(F.col("bands").isNotNull()).select("text_class", "bands", "bits")
    total = banded.agg(F.sum(F.octet_length("bands"))).head()[0] or 0
    buckets = min(max(2 * shuffle_partitions(spark), total // (4 * BUCKET) + 1), MOST_BUCKETS)
    limit = max(HOT, 4 * (total // 4) // buckets)  # so that at most a quarter of the buckets is above it
    sizes = banded.mapInArrow(_counter(buckets, not exact), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    tasks = Tasks.of(buckets, {r.bucket: r.n for r in sizes.where(F.col("n") > limit).collect()}, limit // 2)
    entries = banded.mapInArrow(_banded(tasks, not exact), ENTRIES)
    matched = entries.repartition("task").sortWithinPartitions("task").mapInArrow(_matcher(threshold, 0.0 if exact else tolerance), PAIRS)
    candidates = matched.distinct()
    if not exact:
        more = banded.groupBy("text_class").agg(F.first("bits").alias("bits"))  # equal sets have equal bits
        both = candidates.join(more.select(F.col("text_class").alias("a"), F.col("bits").alias("x")), "a").join(more.select(F.col("text_class").alias("b"), F.col("bits").alias("y")), "b")
        candidates = both.select("a", "b", "x", "y").mapInArrow(_pruner(threshold, tolerance), PAIRS)
    candidates = materialise(candidates, "near-candidates")

    first = members.groupBy("text_class").agg(F.min(F.struct("id", "updated_at")).alias("row"))
    ends = candidates.select(F.explode(F.array("a", "b")).alias("text_class")).distinct()
    wanted = first.join(ends, "text_class").select("text_class", F.col("row.id").alias("_id"), F.col("row.updated_at").alias("_at"))
    texts = chunks.where(F.col("content").isNotNull()).select(F.col("id").cast("long").alias("_id"), F.col("updated_at").cast("long").alias("_was"), "content")
    asked = texts.join(wanted, "_id").where(F.col("_was").eqNullSafe(F.col("_at"))).select("text_class", "content")
    sets = materialise(asked.mapInArrow(_setter(words), SETS), "near-sets")
    sets = sets.groupBy("text_class").agg(F.first("shingles").alias("shingles"))  # repeated rows give the same set
    both = candidates.join(sets.select(F.col("text_class").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("text_class").alias("b"), F.col("shingles").alias("right")), "b")
    return members, both.select("a", "b", "left", "right").mapInArrow(_verifier(threshold), PAIRS)


def similar_pairs(chunks: DataFrame, words: int = 3, threshold: float = 0.5, min_tokens: int = 40, exact: bool = False) -> DataFrame:
    """All pairs of live chunks that are similar but no copies of each other: (chunk_id_a, chunk_id_b), a < b.

    Copies are texts of equal canonical key (see ``copies``). Null, empty and short contents are in no pair;
    repeated rows count once; an empty table has no pairs. No transitive closure, no cap on partners. ``exact`` as in
    ``similar_classes``.
    """
    members, pairs = similar_classes(chunks, words, threshold, min_tokens, exact=exact)
    # one shingle set in texts that are no copies: every two of them are similar
    mixed = members.groupBy("text_class").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi")).where("lo <> hi")
    links = pairs.unionByName(mixed.select(F.col("text_class").alias("a"), F.col("text_class").alias("b")))
    x = members.select(F.col("text_class").alias("a"), F.col("id").alias("ia"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    y = members.select(F.col("text_class").alias("b"), F.col("id").alias("ib"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    both = links.join(x, "a").join(y, "b").where("(a1 <> b1 or a2 <> b2) and (a <> b or ia < ib)")
    return both.select(F.least("ia", "ib").alias("chunk_id_a"), F.greatest("ia", "ib").alias("chunk_id_b"))


def similarity_classes(chunks: DataFrame, words: int = 3, threshold: float = 0.5, min_tokens: int = 40) -> DataFrame:
    """One row of each live chunk of at least ``min_tokens`` tokens: (chunk_id, class_id, n_links).

    ``class_id`` is the smallest id of the chunks with the same shingle set, ``n_links`` the number of other
    classes that are similar to it. Copies are not expanded into pairs.
    """
    members, pairs = similar_classes(chunks, words, threshold, min_tokens)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("text_class")).groupBy("text_class").agg(F.count("*").alias("n_links"))
    classes = members.groupBy("text_class").agg(F.min("id").alias("class_id")).join(ends, "text_class", "left")
    return members.join(classes, "text_class").select(F.col("id").alias("chunk_id"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
