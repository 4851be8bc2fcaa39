"""Most similar vectors of every vector, by an inverted multi-index.

Unit vectors are cut into two halves and each half is quantised by its own codebook; a cell of the index is a pair of
centroids. A query visits cells in the order of the summed distance of their two centroids and reranks the entries of
those cells by their exact cosine similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise, shuffle_partitions

#: Entries a cell has on average; the number of centroids of a half grows with the root of the number of vectors.
CELL_ENTRIES = 16
LEAST_CENTROIDS = 8
#: Vectors the codebooks are fitted on: so many for each centroid, within these bounds (64 MB), however many there are.
SAMPLE_PER_CENTROID, LEAST_SAMPLE, MOST_SAMPLE = 64, 4_096, 1 << 18
ROUNDS = 10
#: Entries of one partition of the index, and of one that is split.
PART_ENTRIES = 32_768
QUERY_BLOCK = 8_192
#: Queries answered exactly to see how far a search must go: for all neighbours, and for near ones, of which many queries have none.
PROBES, NEAR_PROBES = 200, 4_096
#: The share of the probes' near neighbours that a search for all near pairs must reach.
NEAR_RECALL = 0.998
#: Distances worked on at a time.
WORK = 1 << 22

ROUTED = "part int, is_query boolean, vector_class long, vector binary, cell int, cutoff float"
MATCHES = "query long, entry long, similarity float"


@dataclass(frozen=True)
class Codebooks:
    first: np.ndarray
    second: np.ndarray
    #: The group of each centroid of the first half; of each group its first partition and into how many it is split.
    group: np.ndarray
    start: np.ndarray
    splits: np.ndarray

    @property
    def parts(self) -> int:
        return int(self.splits.sum())

    def home(self, centroid: np.ndarray, names: np.ndarray) -> np.ndarray:
        """The partition of vectors: that of their centroid's group, by name in groups that are split."""
        from tidemark.llm.kernel import mix

        g = self.group[centroid]
        return self.start[g] + (mix(names.view(np.uint64)) % self.splits[g].astype(np.uint64)).astype(np.int64)

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to all centroids, less the vector's own norm."""
        half = vectors.shape[1] // 2
        return tuple((c * c).sum(1) - 2 * (v @ c.T) for v, c in ((vectors[:, :half], self.first), (vectors[:, half:], self.second)))


def _closest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    step, norms = max(1, WORK // len(centroids)), (centroids * centroids).sum(1)
    return np.concatenate([(norms - 2 * (points[lo : lo + step] @ centroids.T)).argmin(1) for lo in range(0, len(points), step)])


def _fit(points: np.ndarray, k: int) -> np.ndarray:
    """k-means; starts from evenly spaced rows of the sample, which is in random order already."""
    centroids = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = _closest(points, centroids)
        sums, counts = np.zeros_like(centroids), np.bincount(nearest, minlength=len(centroids))
        np.add.at(sums, nearest, points)
        centroids = sums[counts > 0] / counts[counts > 0, None]  # those without points, as in samples with few different ones, go
    return centroids


def _group(centroids: np.ndarray, load: np.ndarray, parts: int) -> np.ndarray:
    """Centroids in ``parts`` groups of about equal load, near ones together: halved along their main axis again and again."""
    out, number = np.zeros(len(centroids), np.int32), 0
    todo = [(np.arange(len(centroids)), parts)]
    while todo:
        members, n = todo.pop()
        if n <= 1 or len(members) <= 1:
            out[members] = number
            number += 1
            continue
        centred = centroids[members] - centroids[members].mean(0)
        axis = np.linalg.svd(centred, full_matrices=False)[2][0]
        members = members[np.argsort(centred @ axis)]
        share = np.cumsum(load[members] + 1e-9)
        cut = int(np.clip(np.searchsorted(share, share[-1] * (n // 2) / n), 1, len(members) - 1))
        todo += [(members[cut:], n - n // 2), (members[:cut], n // 2)]
    return out


def fit_codebooks(sample: np.ndarray, centroids: int, groups: int, rows: int) -> Codebooks:
    """Codebooks of a sample of ``rows`` vectors. A group that by its share of the sample holds more than two partitions' entries is split."""
    half = sample.shape[1] // 2
    first, second = _fit(sample[:, :half], centroids), _fit(sample[:, half:], centroids)
    load = np.bincount(_closest(sample[:, :half], first), minlength=len(first)).astype(float)
    group = _group(first, load, groups)
    held = np.bincount(group, load) / max(load.sum(), 1) * rows
    splits = np.where(held > 2 * PART_ENTRIES, np.ceil(held / PART_ENTRIES), 1).astype(np.int64)
    return Codebooks(first, second, group, np.cumsum(splits) - splits, splits)


def _units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a usable vector, and those vectors at length 1."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    if not len(rows):
        return rows, np.zeros((0, width), np.float32)
    flat = column.take(pa.array(rows)).flatten()
    whole = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = whole / np.abs(whole).max(1, keepdims=True, initial=0)
        units = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    good = np.isfinite(units).all(1)
    return rows[good], units[good].astype(np.float32)


def _classes(units: np.ndarray) -> np.ndarray:
    """A 64-bit number of each direction; equal vectors have equal numbers."""
    from tidemark.llm.kernel import mix

    bits = np.ascontiguousarray(units + np.float32(0)).view(np.uint32).astype(np.uint64)
    odd = mix(np.arange(1, bits.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((mix(bits + np.uint64(1)) * odd).sum(1)).view(np.int64)


def _namer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, units = _units(batch.column("embedding"), width)
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(pa.array(rows)), pa.array(_classes(units))], names=["chunk_id", "vector_class"])

    return run


def traversal(d1: np.ndarray, d2: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``cells`` centroid pairs of each query by summed distance: both numbers and the sum.

    What a heap over the two sorted lists would pop: the pair of ranks (i, j) can only be among the first n if
    (i + 1) * (j + 1) <= n, as all pairs of lower ranks come first. So that staircase is the whole frontier, for
    all queries of the block at once.
    """
    k1, k2 = d1.shape[1], d2.shape[1]
    cells = min(cells, k1 * k2)
    o1, o2 = np.argsort(d1, axis=1)[:, : min(k1, cells)], np.argsort(d2, axis=1)[:, : min(k2, cells)]
    i, j = _staircase(o1.shape[1], o2.shape[1], cells)
    sums = np.take_along_axis(d1, o1, 1)[:, i] + np.take_along_axis(d2, o2, 1)[:, j]
    top = np.argpartition(sums, cells - 1, axis=1)[:, :cells]
    top = np.take_along_axis(top, np.argsort(np.take_along_axis(sums, top, 1), axis=1), 1)
    return np.take_along_axis(o1, i[top], 1), np.take_along_axis(o2, j[top], 1), np.take_along_axis(sums, top, 1)


@lru_cache(4)
def _staircase(k1: int, k2: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ranks of which (i + 1) * (j + 1) <= cells."""
    steps = np.minimum(k2, cells // np.arange(1, k1 + 1))
    return np.repeat(np.arange(k1), steps), np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)


def _router(books, width: int, cells: int, mutual: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Codebooks = books.value
        for batch in batches:
            rows, units = _units(batch.column("embedding"), width)
            asked = batch.column("asked").to_numpy(zero_copy_only=False)[rows].astype(bool)
            names, at = np.unique(_classes(units), return_index=True)  # equal vectors count once
            wanted = np.isin(names, _classes(units[asked]))
            units = units[at]
            everywhere = cells >= len(b.first) * len(b.second)
            step = max(1, min(256, WORK // (1 if everywhere else len(_staircase(len(b.first), len(b.second), cells)[0]))))
            for lo in range(0, len(units), step):
                u, name = units[lo : lo + step], names[lo : lo + step]
                d1, d2 = b.distances(u)
                near = d1.argmin(1)
                home = b.home(near, name)
                parts, classes, blobs, cell, cutoff = [home], [name], [u], [near * len(b.second) + d2.argmin(1)], [np.full(len(u), np.nan)]
                kind = [np.zeros(len(u), bool)]
                if (q := np.flatnonzero(wanted[lo : lo + step])).size:
                    groups = np.full((len(q), len(b.splits)), everywhere)
                    edge = np.full(len(q), np.inf, np.float32)
                    if not everywhere:
                        c1, _, sums = traversal(d1[q], d2[q], cells)
                        np.put_along_axis(groups, b.group[c1].astype(np.int64), True, 1)
                        edge = sums[:, -1]
                    touched = np.repeat(groups, b.splits, axis=1)
                    touched[np.arange(len(q)), home[q]] = False  # there its entry asks as well
                    if mutual:
                        touched &= np.arange(b.parts) > home[q][:, None]
                    cutoff[0][q] = edge
                    who, where = np.nonzero(touched)
                    parts.append(where)
                    classes.append(name[q][who])
                    blobs.append(u[q][who])
                    cell.append(np.full(len(who), -1))
                    cutoff.append(edge[who])
                    kind.append(np.ones(len(who), bool))
                vectors = np.ascontiguousarray(np.concatenate(blobs).astype("<f4"))
                offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * (width * 4)).buffers()[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(parts).astype(np.int32)),
                        pa.array(np.concatenate(kind)),
                        pa.array(np.concatenate(classes)),
                        pa.Array.from_buffers(pa.binary(), len(vectors), [None, offsets, pa.py_buffer(vectors.tobytes())]),
                        pa.array(np.concatenate(cell).astype(np.int32)),
                        pa.array(np.concatenate(cutoff).astype(np.float32), from_pandas=True),
                    ],
                    names=[x.split()[0] for x in ROUTED.split(", ")],
                )

    return run


class _Best:
    """The k best entries of each query of a block so far; grows by what beats the k-th and is cut now and then."""

    def __init__(self, queries: int, k: int, least: float):
        self.k, self.floor = k, np.full(queries, least, np.float32)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, max(1 << 18, 8 * k * queries)

    def add(self, who: np.ndarray, entry: np.ndarray, similarity: np.ndarray) -> None:
        self.parts.append((who, entry, similarity))
        self.size += len(who)
        if self.size > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        who, entry, similarity = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((entry, -similarity, who))
        who, entry, similarity = who[order], entry[order], similarity[order]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
        last = rank == self.k - 1
        self.floor[who[last]] = np.maximum(self.floor[who[last]], similarity[last])
        keep = rank < self.k
        self.parts = [(who[keep], entry[keep], similarity[keep])]
        self.size = int(keep.sum())
        return self.parts[0]


def _search(b: Codebooks, index: tuple, asked: np.ndarray, queries: np.ndarray, cutoff: np.ndarray, k: int, least: float, back: _Best | None) -> pa.RecordBatch:
    """Matches of a block of queries in the entries of one partition, which are sorted by cell. ``back`` collects those of the entries."""
    cells, names, vectors = index
    best = _Best(len(queries), k, least)
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, int)
    ends = np.append(starts[1:], len(cells))
    d1, d2 = b.distances(queries)
    first, second = cells[starts] // len(b.second), cells[starts] % len(b.second)
    edge = np.where(np.isinf(cutoff), cutoff, cutoff + 1e-5 * (1 + np.abs(cutoff)))
    for lo in range(0, len(starts), 512):
        visited = d1[:, first[lo : lo + 512]] + d2[:, second[lo : lo + 512]] <= edge[:, None]
        for c in range(visited.shape[1]):
            who = np.flatnonzero(visited[:, c])
            if not len(who):
                continue
            for s in range(starts[lo + c], ends[lo + c], 2048):
                e = min(s + 2048, ends[lo + c])
                for w in range(0, len(who), 2048):
                    some = who[w : w + 2048]
                    found = queries[some] @ vectors[s:e].T
                    good = found >= best.floor[some][:, None]
                    if back:
                        good |= found >= back.floor[s:e]
                    i, j = np.nonzero(good)
                    if len(i):
                        i, j, value = some[i], j + s, found[i, j]
                        other = asked[i] != names[j]
                        best.add(i[other], names[j[other]], value[other])
                        if back:
                            back.add(j[other], asked[i[other]], value[other])
    return _matches(asked, best)


def _matches(names: np.ndarray, best: _Best) -> pa.RecordBatch:
    who, entry, similarity = best.cut()
    return pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(entry), pa.array(np.minimum(similarity, np.float32(1)))], names=["query", "entry", "similarity"])


class _Rows:
    """Names, vectors and numbers of rows as they come, kept as arrays."""

    def __init__(self, width: int):
        self.width, self.kept, self.n = width, [], 0

    def add(self, rows: pa.RecordBatch) -> None:
        column = rows.column("vector")
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        vectors = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view("<f4").reshape(-1, self.width).copy()
        self.kept.append((rows.column("vector_class").to_numpy(), vectors, rows.column("cell").to_numpy(), rows.column("cutoff").to_numpy(zero_copy_only=False)))
        self.n += rows.num_rows

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All rows, those of one name once, in order of their names; then there are none."""
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros((0, self.width), np.float32), np.zeros(0, np.int32), np.zeros(0, np.float32)
        name, vectors, cell, cutoff = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        self.kept, self.n = [], 0
        name, at = np.unique(name, return_index=True)
        return name, vectors[at], cell[at], cutoff[at]


def _searcher(books, width: int, k: int, least: float, mutual: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Codebooks = books.value
        part, index, back = None, None, None
        entries, queries = _Rows(width), _Rows(width)

        def ask(name: np.ndarray, vectors: np.ndarray, cutoff: np.ndarray, other: _Best | None) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(name), QUERY_BLOCK):
                hi = lo + QUERY_BLOCK
                yield _search(b, index, name[lo:hi], vectors[lo:hi], cutoff[lo:hi], k, least, other)

        def close() -> Iterator[pa.RecordBatch]:
            """All entries are there: put them in order; those that ask do so now, finding both directions by themselves."""
            nonlocal index, back
            name, vectors, cell, cutoff = entries.take()
            order = np.argsort(cell, kind="stable")
            index = cell[order].astype(np.int64), name[order], vectors[order]
            back = _Best(len(name), k, least) if mutual else None
            asking = ~np.isnan(cutoff)
            yield from ask(name[asking], vectors[asking], cutoff[asking], None)

        def finish() -> Iterator[pa.RecordBatch]:
            if index is None:
                yield from close()
            name, vectors, _, cutoff = queries.take()
            yield from ask(name, vectors, cutoff, back)
            if mutual:
                yield _matches(index[1], back)

        for batch in batches:
            number, is_query = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("part", "is_query"))
            change = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (is_query[1:] != is_query[:-1])])
            for lo, hi in zip(change, np.append(change[1:], len(number)), strict=True):
                if number[lo] != part:
                    if part is not None:
                        yield from finish()
                    part, index, back = number[lo], None, None
                rows = batch.slice(lo, hi - lo)
                if not is_query[lo]:
                    entries.add(rows)
                    continue
                if index is None:
                    yield from close()
                queries.add(rows)
                if queries.n >= QUERY_BLOCK:
                    name, vectors, _, cutoff = queries.take()
                    yield from ask(name, vectors, cutoff, back)
        if part is not None:
            yield from finish()

    return run


def nearest(
    vectors: DataFrame, k: int = 5, least: float = -1.0, cells: int = 1, recall: float | None = None, asked: Column | None = None, width: int = 64, probes: int = PROBES, exact: bool = False
) -> DataFrame:
    """The ``k`` most similar other chunks of each asked chunk: (chunk_id, neighbour_id, similarity).

    Only embeddings of exactly ``width`` finite numbers, not all zero, count, one per chunk_id; others are in no
    result. Every usable vector is in the index; those for which ``asked`` holds (all, if None) are queries. A
    query visits ``cells`` cells of the index, or, if that is more, as many as the share ``recall`` of the
    neighbours of ``probes`` queries, found exactly in the same run, lies in; with ``exact`` all of them. ``least``
    leaves out less similar neighbours. Ties go to the smaller neighbour_id. Equal vectors are one entry, so a large
    group of them costs one; a dense region of many different ones is split over partitions. An empty table gives no
    rows. Building the plan counts the rows, fits the codebooks on a sample and answers the probes.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("chunk_id").isNotNull()).select(F.col("chunk_id").cast("long"), F.col("embedding").cast("array<float>"))
    usable = rows.mapInArrow(_namer(width), "chunk_id long, vector_class long")
    members = materialise(usable.groupBy("chunk_id").agg(F.min("vector_class").alias("vector_class")), "vector-members")
    n = members.count()
    centroids = max(round((n / CELL_ENTRIES) ** 0.5), LEAST_CENTROIDS)
    groups = min(centroids, max(shuffle_partitions(spark), -(-n // PART_ENTRIES)))
    want = int(np.clip(SAMPLE_PER_CENTROID * centroids, LEAST_SAMPLE, MOST_SAMPLE))
    drawn = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(min(1.0, 1.5 * want / max(n, 1)) * (1 << 30)))
    sample = drawn.orderBy(F.xxhash64(F.lit(1), "chunk_id"), "chunk_id").limit(want).select("embedding").toArrow()
    _, points = _units(sample.column("embedding").combine_chunks(), width)
    if not len(points):
        points = np.eye(1, width, dtype=np.float32)
    fitted = fit_codebooks(points, centroids, groups, n)
    books = spark.sparkContext.broadcast(fitted)

    # where every vector asks, one of two partitions asks the other, and both directions are kept there
    mutual = asked is None
    if exact:
        visit = len(fitted.first) * len(fitted.second)
    else:
        visit = cells if recall is None else max(cells, cells_for(recall, rows, books, points[:probes], width, k, least, mutual))
    flag = F.lit(True) if mutual else F.coalesce(asked, F.lit(False))
    routed = rows.withColumn("asked", flag).mapInArrow(_router(books, width, visit, mutual), ROUTED)
    found = routed.repartitionById(fitted.parts, F.col("part")).sortWithinPartitions("part", "is_query").mapInArrow(_searcher(books, width, k, least, mutual), MATCHES)
    found = found.repartition("query").groupBy("query", "entry").agg(F.max("similarity").alias("similarity"))  # equal vectors of different batches
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "entry")
    matches = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    return _named(members, matches, flag, k)


def _probe(books, width: int, k: int, queries: np.ndarray, least: float, mutual: bool):
    """The k best entries of each probe in each batch, of those at least so similar, and the summed distance of the cell each lies in.

    With ``mutual`` also how many cells the entry would have to visit to find the probe, as then either may be the one that asks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Codebooks = books.value
        asked, (q1, q2) = _classes(queries), b.distances(queries)
        cell1, cell2 = q1.argmin(1), q2.argmin(1)
        for batch in batches:
            _, units = _units(batch.column("embedding"), width)
            names, at = np.unique(_classes(units), return_index=True)
            if not len(names):
                continue
            units = units[at]
            near1, near2 = (np.concatenate(x) for x in zip(*([d.argmin(1) for d in b.distances(units[lo : lo + 256])] for lo in range(0, len(units), 256)), strict=True))
            step = max(1, WORK // len(names))
            for lo in range(0, len(queries), step):
                found = queries[lo : lo + step] @ units.T
                found[asked[lo : lo + step, None] == names[None, :]] = -2
                if least > 0:
                    who, best = np.nonzero(found >= least)
                else:
                    best = np.argpartition(-found, min(k, len(names)) - 1, axis=1)[:, :k]
                    who, best = np.repeat(np.arange(len(found)), best.shape[1]), best.ravel()
                value, who = found[who, best], who + lo
                reach = q1[who, near1[best]] + q2[who, near2[best]]
                back = np.zeros(len(who), np.int64)
                for i in range(len(who) if mutual else 0):
                    d1, d2 = (d[0] for d in b.distances(units[best[i]][None]))
                    back[i] = _cells_within(d1, d2, d1[cell1[who[i]]] + d2[cell2[who[i]]])
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(names[best]), pa.array(value), pa.array(reach.astype(np.float32)), pa.array(back)], names=["query", "entry", "similarity", "reach", "back"])

    return run


def _cells_within(d1: np.ndarray, d2: np.ndarray, reach: float) -> int:
    """How many pairs of centroids have no greater summed distance."""
    return int(np.searchsorted(np.sort(d2), reach + 1e-5 * (1 + abs(reach)) - d1, "right").sum())


def cells_for(recall: float, rows: DataFrame, books, queries: np.ndarray, width: int, k: int, least: float = -1.0, mutual: bool = False) -> int:
    """Cells a query must visit to find the share ``recall`` of its k nearest, from exact answers to some queries over all rows."""
    found = rows.mapInArrow(_probe(books, width, k, queries, least, mutual), f"{MATCHES}, reach float, back long")
    found = found.groupBy("query", "entry").agg(*(F.max(c).alias(c) for c in ("similarity", "reach", "back")))
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "entry")
    exact = found.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= k) & (F.col("similarity") > -2)).select("query", "reach", "back").toPandas()  # at most k rows a probe
    q1, q2 = books.value.distances(queries)
    ranks = [max(_cells_within(q1[q], q2[q], r), back) for q, r, back in exact.itertuples(index=False)]
    return int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else 1


def _named(members: DataFrame, matches: DataFrame, flag: Column, k: int) -> DataFrame:
    """Matches of classes as matches of ids: of each class the k + 1 best candidates hold the answers of all its members."""
    first = Window.partitionBy("vector_class").orderBy("chunk_id")
    heads = members.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1).drop("rank")
    asking = members.where(flag)
    own = heads.select(F.col("vector_class").alias("query"), F.col("chunk_id").alias("neighbour_id"), F.lit(1.0).cast("float").alias("similarity"))
    other = matches.join(heads.withColumnRenamed("vector_class", "entry"), "entry").select("query", F.col("chunk_id").alias("neighbour_id"), "similarity")
    ranked = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour_id")
    lists = own.unionByName(other).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k + 1)
    lists = lists.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour_id", "similarity"))).alias("found")).where(F.size("found") > 1)
    mine = F.slice(F.filter("found", lambda x: x["neighbour_id"] != F.col("chunk_id")), 1, k)
    return asking.join(lists, F.col("vector_class") == F.col("query")).select("chunk_id", F.inline(mine)).select("chunk_id", "neighbour_id", "similarity")


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.9, width: int = 64, recall: float = NEAR_RECALL, exact: bool = False) -> DataFrame:
    """Pairs of chunks at least ``least`` similar, one among the ``k`` nearest of the other: (chunk_id_a, chunk_id_b), a < b.

    Queries visit as many cells as the share ``recall`` of the near neighbours of NEAR_PROBES queries lies in; with
    ``exact`` all cells. A float has seven digits; a similarity within 1e-6 of ``least`` counts as reached.
    """
    found = nearest(vectors, k, least - 1e-6, recall=recall, width=width, probes=NEAR_PROBES, exact=exact)
    return found.select(F.least("chunk_id", "neighbour_id").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_b")).distinct()
