"""Similarity among the results of one search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Results compared with each other at a time.
BLOCK = 512


def _units(vectors: list) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """By length of vector: places and vectors at length 1. Missing numbers count as 0; one without length stays so."""
    lengths = np.array([len(v) if v is not None else 0 for v in vectors])
    out = []
    for width in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == width)
        m = np.nan_to_num(np.array([[np.nan if x is None else x for x in vectors[i]] for i in at], np.float64))
        size = np.linalg.norm(m, axis=1, keepdims=True)
        out.append((int(width), at, np.divide(m, size, out=np.zeros_like(m), where=size > 0)))
    return out


def cosine_matrix(ranked: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, similarity) of each two results, by rank; ``ranked``: (rank, chunk_id, embedding) of one search, ranks from 1.

    All pairs are the result asked for. They are made block by block, so no task holds more than two blocks; vectors of
    different lengths, or without any, have similarity 0.
    """
    number = F.floor((F.col("rank") - 1) / F.lit(block)).cast("int")
    blocks = ranked.groupBy(number.alias("b")).agg(F.collect_list(F.struct("rank", "embedding")).alias("items"))
    last = ranked.agg(F.max(number).alias("last")).scalar()
    others = F.explode(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))))
    left = blocks.select(F.col("b").alias("x"), others.alias("y"), F.col("items").alias("left"))
    right = blocks.select(others.alias("x"), F.col("b").alias("y"), F.col("items").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                found = np.zeros((len(a), len(b)))
                ours = {w: (at, u) for w, at, u in _units([x["embedding"] for x in a])}
                for w, at, u in _units([x["embedding"] for x in b]):
                    if w in ours:
                        found[np.ix_(ours[w][0], at)] = ours[w][1] @ u.T
                i, j = (np.array([x["rank"] for x in side], np.int64) for side in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array(found.ravel())], names=["i", "j", "similarity"])

    return left.join(right, ["x", "y"]).select("left", "right").mapInArrow(run, "i long, j long, similarity double")


def _kept(ranked: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}  # by length of vector
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                good = np.ones(part.num_rows, bool)
                for width, at, units in _units(part.column("embedding").to_pylist()):
                    before = kept.setdefault(width, [])
                    close = np.zeros(len(at), bool)
                    for held in before:
                        close |= (units @ held.T).max(1, initial=-1) >= threshold
                    among, mine = units @ units.T, []
                    for k in range(len(at)):
                        if not close[k] and not (mine and among[k, mine].max() >= threshold):
                            mine.append(k)
                    good[at] = False
                    good[at[mine]] = True
                    before.append(units[mine])
                yield part.drop_columns(["embedding"]).filter(pa.array(good))

    # greedy in rank order: each decision needs all before it, so the results of a search are one task's, block by block
    return ranked.repartition(1).sortWithinPartitions("rank").mapInArrow(run, ranked.drop("embedding").schema)


def semantic_dedup(ranked: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(rank, chunk_id) of the results kept in order: each below the threshold to all kept before it. However many there are, all are compared."""
    return _kept(ranked.select(F.col("rank").cast("long"), "chunk_id", "embedding"), threshold)


def dedup_with_scores(ranked: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(rank, chunk_id, score) of the results kept; the score is theirs, 1 if they have none."""
    score = F.col("score").cast("double") if "score" in ranked.columns else F.lit(1.0)
    return _kept(ranked.select(F.col("rank").cast("long"), "chunk_id", score.alias("score"), "embedding"), threshold)
