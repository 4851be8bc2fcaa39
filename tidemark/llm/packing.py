"""Texts packed whole into containers of a fixed number of tokens, by conflict-constrained best fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import VOCABULARY, load, transducer
from tidemark.operators.snapshots import folded
from tidemark.session import materialise, spread

CAPACITY = 2_048
#: Texts packed together in one task; more make hardly fuller containers.
GROUP = 8_192
#: Bits of the maps a container carries of its sources and duplicate clusters.
MAP_BITS = 1 << 12

PACKED = "container_id long, doc_id long, piece_no int, first_token long, n_tokens long"


class BestFit:
    """Open containers ordered by what is left in them, each with bitmaps of its sources and clusters.

    The successor of a size is the container with the least room that still holds it. The search goes on from
    successor to successor until one has neither the item's source nor its cluster. If all that fit conflict, a new
    container is opened as long as there are fewer than ``free``, which any packing needs; after that a shared
    source is let pass, then a shared cluster, before another is opened: unused space counts for more. ``strict``
    never lets a shared cluster pass.
    """

    def __init__(self, capacity: int, strict: bool = False, free: int = 0):
        self.capacity, self.strict, self.free = capacity, strict, free
        self.room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.filled = 0  # bit r: some container has r left
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _take(self, left: int, place: int, size: int, source: int, cluster: int) -> int:
        bins = self.room[left]
        number = bins.pop(place)
        if not bins:
            self.filled &= ~(1 << left)
        self._put(number, left - size, source, cluster)
        return number

    def _put(self, number: int, left: int, source: int, cluster: int) -> None:
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if left:
            self.room[left].append(number)
            self.filled |= 1 << left

    def open(self, size: int, source: int, cluster: int) -> int:
        self.sources.append(0)
        self.clusters.append(0)
        self._put(len(self.sources) - 1, self.capacity - size, source, cluster)
        return len(self.sources) - 1

    def add(self, size: int, source: int, cluster: int) -> int:
        """The number of the container the item went into."""
        shared_source = shared_cluster = None
        rest = self.filled >> size << size
        while rest:
            left = (rest & -rest).bit_length() - 1
            bins = self.room[left]
            for place in range(len(bins) - 1, -1, -1):
                number = bins[place]
                if not self.clusters[number] & cluster:
                    if not self.sources[number] & source:
                        return self._take(left, place, size, source, cluster)
                    shared_source = shared_source or (left, place)
                else:
                    shared_cluster = shared_cluster or (left, place)
            rest &= rest - 1
        if (shared_source or shared_cluster) and len(self.sources) < self.free:
            return self.open(size, source, cluster)
        second = shared_source or (None if self.strict else shared_cluster)
        return self._take(*second, size, source, cluster) if second else self.open(size, source, cluster)


def _bit(key: int) -> int:
    return 1 << (int(key) % MAP_BITS)


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, strict: bool = False) -> list[list[tuple[int, int, int, int]]]:
    """For each item its pieces: (container, piece number, first token, tokens).

    An item larger than the capacity fills containers of its own and leaves a remainder, which is packed like an
    item. Larger items go first. Empty items lie in the first container.
    """
    bins = BestFit(capacity, strict, -(-sum(sizes) // capacity))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in sizes]
    rest = []
    for i, size in enumerate(sizes):
        whole = size // capacity if size > capacity else 0
        for piece in range(whole):
            out[i].append((bins.open(capacity, 0, 0), piece, piece * capacity, capacity))
        if size - whole * capacity:
            rest.append((size - whole * capacity, i, whole))
    for size, i, piece in sorted(rest, key=lambda x: (-x[0], x[1])):
        number = bins.add(size, _bit(sources[i]), _bit(clusters[i]))
        out[i].append((number, piece, piece * capacity, size))
    for i, size in enumerate(sizes):
        if not size:
            if not bins.sources:
                bins.open(0, 0, 0)
            out[i].append((0, 0, 0, 0))
    return out


def _counter(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(vocabulary.value).encode
        for batch in batches:
            counts = np.fromiter((len(encode(x)) for x in batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(counts)], names=["doc_id", "source_key", "cluster_key", "n_tokens"])

    return run


def sized(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source_key, cluster_key, n_tokens) of every row; null and empty texts have 0 tokens. A null source is a source of its own."""
    text = F.col("text").cast("string")
    rows = spread(documents.select("doc_id", "source", "text")).select(
        F.col("doc_id").cast("long"), F.xxhash64(F.col("source").cast("string")).alias("source_key"), F.xxhash64(folded(F.coalesce(text, F.lit("")))).alias("cluster_key"), text.alias("text")
    )
    return rows.mapInArrow(_counter(load(documents.sparkSession, path)), "doc_id long, source_key long, cluster_key long, n_tokens long")


def packed(documents: DataFrame, capacity: int = CAPACITY, strict: bool = False, group: int = GROUP, path: str = VOCABULARY) -> DataFrame:
    """Every text in a container: (container_id, doc_id, piece_no, first_token, n_tokens).

    A text of at most ``capacity`` tokens is one row; a longer one is cut into full containers and a remainder
    packed like a text. Texts are spread over groups of about ``group`` by a hash of doc_id and packed group by
    group, so any number of texts from one source or cluster is spread, too. Only keys and sizes are shuffled.
    The number of groups comes from a count of the table, run while the plan is built. Null and empty texts are one row of 0 tokens; rows with a null doc_id are packed as well. An empty table has no containers.
    """
    return _packed(sized(documents, path), capacity, strict, group, documents.count())


def _packed(sizes: DataFrame, capacity: int, strict: bool, group: int, rows_in_all: int | None = None) -> DataFrame:
    groups = max(1, round((sizes.count() if rows_in_all is None else rows_in_all) / group))
    names = ["container_id", "doc_id", "piece_no", "first_token", "n_tokens"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "cluster_key", "n_tokens"], kind="stable")
        found = pack(rows["n_tokens"].tolist(), rows["source_key"].tolist(), rows["cluster_key"].tolist(), capacity, strict)
        base = int(key[0]) << 32
        ids = rows["doc_id"].tolist()
        out = [(base + number, doc, piece, first, n) for doc, pieces in zip(ids, found, strict=True) for number, piece, first, n in pieces]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    rows = sizes.withColumn("_group", F.pmod(F.xxhash64(F.lit("pack"), "doc_id"), F.lit(groups)))
    return rows.groupBy("_group").applyInPandas(run, PACKED)


def fill(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_containers, n_tokens, share of space used, and the fewest containers any packing needs."""
    each = containers.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return each.agg(
        F.count("*").alias("n_containers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
        (F.sum("n") / (F.count("*") * F.lit(capacity))).alias("used"),
        F.ceil(F.sum("n") / F.lit(capacity)).alias("least_containers"),
    )


def checked(documents: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, whole, within): whether a text lies in containers with all its tokens, unsplit unless it is longer than one, and none of them is too full."""
    sizes = materialise(sized(documents, path), "sizes")
    rows = materialise(_packed(sizes, capacity, False, GROUP), "packed")
    full = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    each = rows.join(full, "container_id").groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"), F.max("used").alias("used"))
    found = sizes.join(each, sizes["doc_id"].eqNullSafe(each["doc_id"]), "left").select(sizes["doc_id"], "n_tokens", "placed", "pieces", "used")
    whole = (F.col("placed") == F.col("n_tokens")) & (F.col("pieces") == F.greatest(F.ceil(F.col("n_tokens") / F.lit(capacity)), F.lit(1)))
    return found.select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"), F.coalesce(F.col("used") <= capacity, F.lit(False)).alias("within"))


def conflicts(documents: DataFrame, capacity: int = CAPACITY, strict: bool = False, path: str = VOCABULARY) -> DataFrame:
    """One row, what had to be let pass: n_containers, and those that hold texts of one source, or of one cluster, more than once."""
    sizes = materialise(sized(documents, path), "sizes")
    rows = _packed(sizes, capacity, strict, GROUP).where(F.col("n_tokens") > 0).join(sizes.select("doc_id", "source_key", "cluster_key"), "doc_id")
    each = rows.groupBy("container_id").agg(*((F.count("*") > F.count_distinct(k)).alias(k) for k in ("source_key", "cluster_key")))
    return each.agg(F.count("*").alias("n_containers"), F.count_if("source_key").alias("with_shared_sources"), F.count_if("cluster_key").alias("with_shared_clusters"))
