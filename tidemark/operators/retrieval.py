"""Ranked retrieval: nearest vectors, full text by BM25, both fused with the confidence of documents."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Confidence
from tidemark.functions import vectors as V
from tidemark.functions.confidence import confidence, query_time
from tidemark.operators.dedup import semantic_dedup
from tidemark.operators.index import Index, TextIndex, of_ids
from tidemark.sources.tables import not_deleted

#: BM25's parameters, and the weight of a term that most rows have.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Candidates of each channel and of both together, in multiples of the results wanted.
CHANNEL, MERGED = 10, 5
#: Results of one search at most; beyond, it is an error.
MOST_RESULTS = 1_000


def vector_topk(vectors: DataFrame, query: Sequence[float], n: int, unique: bool = False) -> DataFrame:
    """The ``n`` nearest chunks by Euclidean distance: (chunk_id, score), score 1 / (1 + distance).

    Vectors of another length or with missing or NaN numbers are no candidates; a chunk counts once, with its
    nearest vector; ties go to the smaller chunk_id. With ``unique`` the table must have one row an id, as a stored
    index does: only the best of each task then reach the last one, nothing is shuffled.
    """
    near = vectors.where(F.col("chunk_id").isNotNull()).select("chunk_id", V.l2(F.col("embedding"), V.literal(query)).alias("distance"))
    if not unique:
        near = near.groupBy("chunk_id").agg(F.min("distance").alias("distance"))
    # unusable vectors have no distance or NaN, both come last
    best = near.orderBy(F.asc_nulls_last("distance"), "chunk_id").limit(n).where(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return best.select("chunk_id", (F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).alias("score"))


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def query_phrases(query: str) -> list[list[str]]:
    """A phrase for each word of a query, once for each time it is there; a word's parts must follow one another."""
    kept = re.sub(r"[^\w\s一-龥\-]", " ", query)
    found = ([p for p in re.split(r"[\W_]+", _folded(word)) if p] for word in kept.split())
    return [p for p in found if p]


def bm25(index: TextIndex, queries: Sequence[str], within: DataFrame | None = None) -> DataFrame:
    """(query_no, chunk_id, score) of every row that has at least one phrase of the query, in the order of ``queries``.

    Only the postings of the queries' terms are read. With ``within`` (chunk_id) the index is taken as if it held those
    rows only; the number and mean length of rows are theirs. Words are joined by OR, a repeated word counts as often; a
    query without a word finds nothing. Scores are rounded to nine digits, so that equal ones stay equal in whatever
    order their parts were added.
    """
    spark = index.postings.sparkSession
    parts = []
    for q, query in enumerate(queries):
        phrases: dict[tuple[str, ...], int] = {}
        for p in query_phrases(query):
            phrases[tuple(p)] = phrases.get(tuple(p), 0) + 1
        parts += [(q, n, i, term, len(p), times) for n, (p, times) in enumerate(phrases.items()) for i, term in enumerate(p)]
    names = ("query_no", "phrase_no", "part", "term", "parts", "times")
    asked = spark.createDataFrame(pa.table({c: pa.array([p[k] for p in parts], pa.string() if c == "term" else pa.int32()) for k, c in enumerate(names)}))
    spots, totals = index.of(p[3] for p in parts).select("chunk_id", "dl", "term", "position"), index.totals
    if within is not None:
        rows = index.lengths.join(within.select("chunk_id"), "chunk_id", "left_semi")
        spots, totals = spots.join(within.select("chunk_id"), "chunk_id", "left_semi"), rows.agg(F.count("*").alias("n"), F.sum("dl").alias("total"))
    n, avgdl = totals.select("n").scalar(), totals.select(F.try_divide("total", "n").alias("a")).scalar()
    # the phrases come from the caller's list of queries, so their number is known here
    hits = spots.join(F.broadcast(asked), "term")
    by, held = ("query_no", "phrase_no", "chunk_id"), [F.first(c).alias(c) for c in ("dl", "times")]
    counts = hits.where(F.col("parts") == 1).groupBy(*by).agg(F.count("*").alias("f"), *held)
    if any(p[4] > 1 for p in parts):  # a phrase of several terms is there where all of them are in their places
        several = hits.where(F.col("parts") > 1).groupBy(*by, (F.col("position") - F.col("part")).alias("start")).agg(F.count("*").alias("found"), F.first("parts").alias("parts"), *held)
        counts = counts.unionByName(several.where(F.col("found") == F.col("parts")).groupBy(*by).agg(F.count("*").alias("f"), *held))
    rows_with = counts.groupBy("query_no", "phrase_no").agg(F.count("*").alias("df"))
    scored = counts.join(F.broadcast(rows_with), ["query_no", "phrase_no"])
    raw = F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)
    part = F.col("times") * idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / avgdl))
    return scored.groupBy("query_no", "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))


def bm25_topk(index: TextIndex, queries: Sequence[str], n: int, within: DataFrame | None = None) -> DataFrame:
    """The ``n`` best rows of each query: (query_no, rank, chunk_id, score); ties go to the smaller chunk_id."""
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), "chunk_id")
    ranked = bm25(index, queries, within).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= n).select("query_no", "rank", "chunk_id", "score")


@dataclass(frozen=True)
class Weights:
    alpha: float
    beta: float


def weights(mode: str | None = None, alpha: float | None = None, beta: float | None = None, default: tuple[float, float] = (0.6, 0.4)) -> Weights:
    """Of the two channels: by mode, or as given; one alone leaves the rest of 1 to the other; both must make 1."""
    if mode == "keyword":
        return Weights(0.0, 1.0)
    if mode == "semantic":
        return Weights(1.0, 0.0)
    if alpha is None and beta is None:
        return Weights(*default)
    a = alpha if alpha is not None else 1 - beta
    b = beta if beta is not None else 1 - alpha
    if abs(a + b - 1) > 0.01:
        raise ValueError(f"alpha and beta must make 1, not {a + b:g}")
    return Weights(a, b)


def clamped(top_k: int) -> int:
    return max(1, min(int(top_k), 100))


def enabled_vaults(requested: Sequence[str] | str | None, enabled: Sequence[str]) -> list[str]:
    """The requested vaults that are enabled; all enabled ones if none are requested. None left of those requested is an error."""
    if not requested:
        return list(enabled)
    names = [x.strip() for x in requested.split(",")] if isinstance(requested, str) else list(requested)
    left = [x for x in names if x in enabled]
    if not left:
        raise ValueError(f"none of the vaults {names} exists and is enabled")
    return left


RESULT = ("rank", "chunk_id", "content", "file_path", "absolute_path", "section", "start_pos", "end_pos", "vault_name", "chunk_type", "semantic_score", "keyword_score", "confidence_score", "final_score", "confidence_reason", "file_hash")


def candidates(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """Both channels by chunk, 0 where one has no score: (chunk_id, semantic_score, keyword_score)."""
    s = semantic.select("chunk_id", F.col("score").alias("s"))
    k = keyword.select("chunk_id", F.col("score").alias("k"))
    return s.join(k, "chunk_id", "full").select("chunk_id", F.coalesce("s", F.lit(0.0)).alias("semantic_score"), F.coalesce("k", F.lit(0.0)).alias("keyword_score"))


def scored(found: DataFrame, chunks: DataFrame, files: DataFrame, query: str, w: Weights, rules: Confidence, as_of: dt.date, vaults: Sequence[str] | None = None) -> DataFrame:
    """Candidates with their chunk, file and final score: (alpha * semantic + beta * log1p(keyword)) * confidence.

    ``found`` is the broadcast side, so it must be of a known size. Flagged chunks and files and vaults not in ``vaults``
    (None: none is left out) are filtered here, after the candidates were cut. Contents are not read yet.
    """
    live = not_deleted()
    c = chunks.where(live).select(F.col("id").alias("chunk_id"), "file_id", F.coalesce(F.nullif(F.col("section_title"), F.lit("")), F.lit("Root")).alias("section"), "start_pos", "end_pos", F.col("content_type").alias("chunk_type"), "confidence_json")
    f = files.where(live).select(F.col("id").alias("file_id"), "file_path", "absolute_path", "vault_name", "file_hash")
    rows = F.broadcast(F.broadcast(found).join(c, "chunk_id")).join(f, "file_id")
    if vaults is not None:
        rows = rows.where(F.col("vault_name").isin(list(vaults)))
    rows = rows.select("*", *confidence(F.col("confidence_json"), rules, as_of, query_time(query)))
    final = (F.lit(w.alpha) * F.col("semantic_score") + F.lit(w.beta) * F.log1p(F.greatest(F.lit(0.0), F.col("keyword_score")))) * F.col("confidence_score")
    return rows.withColumn("final_score", final)


def best_by_file(rows: DataFrame, key: str = "file_path") -> DataFrame:
    """The best chunk of each path; between equal scores the smaller chunk_id. One path in two vaults is one."""
    best = Window.partitionBy(key).orderBy(F.desc("final_score"), "chunk_id")
    return rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == 1).drop("_n")


def search(
    index: Index, query: str, query_vector: Sequence[float], limit: int = 10, *, w: Weights = Weights(0.6, 0.4), vaults: Sequence[str] | None = None, rules: Confidence | None = None,
    as_of: dt.date = dt.date(2024, 6, 1), prefilter: bool = False, words: str | None = None, similar: float | None = None,
) -> DataFrame:
    """The ``limit`` best files for a query, one chunk each, as RESULT.

    Each channel gives 10 candidates per result; their best 5 per result by final score are reduced to one chunk a
    file. Vaults are filtered after the candidates were cut, or before with ``prefilter``. Both channels run whatever
    the weights, so rows of a muted channel may fill up the result with a final score of 0. A blank query finds nothing.
    ``words``: what the full text is asked for, if not the query, such as the query segmented. ``similar``: of chunks
    whose vectors are at least so similar only the best one is kept.

    The search runs at once: the candidates, at most 20 a result, pass the driver, so that chunks and contents are read
    by id only, from the pages that hold them. It is meant for pages of results; more than MOST_RESULTS are an error.
    """
    spark = index.chunks.sparkSession
    if not 0 < limit <= MOST_RESULTS:
        raise ValueError(f"a search gives 1 to {MOST_RESULTS} results, not {limit}")
    rules = rules or Confidence.shipped()
    got = pa.schema([("chunk_id", pa.int64()), ("semantic_score", pa.float64()), ("keyword_score", pa.float64())]).empty_table()
    if query.strip():
        vectors, within = index.vectors, None
        if prefilter and vaults is not None:
            inside = index.files.where(F.col("vault_name").isin(list(vaults))).select(F.col("id").alias("file_id"))
            within = index.text.lengths.join(inside, "file_id", "left_semi").select("chunk_id")
            vectors = vectors.join(within, "chunk_id", "left_semi")
        semantic = vector_topk(vectors, query_vector, CHANNEL * limit, unique=True)
        keyword = bm25_topk(index.text, [words or query], CHANNEL * limit, within).select("chunk_id", "score")
        got = candidates(semantic, keyword).toArrow()
    ids = got.column("chunk_id").to_pylist()
    rows = scored(spark.createDataFrame(got), of_ids(index.chunks, "id", ids), index.files, query, w, rules, as_of, vaults)
    short = rows.orderBy(F.desc("final_score"), "chunk_id").limit(MERGED * limit)
    if similar is not None:
        short = _distinct(short, of_ids(index.vectors, "chunk_id", ids), similar)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("final_score"), "chunk_id")
    top = best_by_file(short).orderBy(F.desc("final_score"), "chunk_id").limit(limit).withColumn("rank", F.row_number().over(order))
    held = top.select(*(c for c in RESULT if c != "content")).toArrow()
    content = of_ids(index.chunks, "id", held.column("chunk_id").to_pylist()).select(F.col("id").alias("chunk_id"), "content")
    return content.join(F.broadcast(spark.createDataFrame(held)), "chunk_id").select(*RESULT)


def _distinct(rows: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Rows without those too similar to a better one; chunks without a vector are similar to none."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("final_score"), "chunk_id")
    ranked = rows.select("chunk_id", "final_score").withColumn("rank", F.row_number().over(order)).join(vectors, "chunk_id", "left")
    return rows.join(semantic_dedup(ranked, threshold).select("chunk_id"), "chunk_id", "left_semi")


def response(results: DataFrame) -> DataFrame:
    """What a caller sees: rank, file, path, the first 300 characters, scores of 4 digits, reason."""
    return results.select("rank", F.col("file_path").alias("file"), F.col("absolute_path").alias("abs_path"), F.substring("content", 1, 300).alias("content"), F.round("final_score", 4).alias("score"), F.round("confidence_score", 4).alias("confidence"), "confidence_reason")


def as_csv(results: DataFrame) -> DataFrame:
    """Ten columns for a CSV file: 200 characters of content on one line."""
    text = F.regexp_replace(F.substring("content", 1, 200), "[\r\n]+", " ")
    return results.select("rank", "file_path", "absolute_path", "section", "vault_name", "chunk_type", text.alias("content"), "final_score", "confidence_score", "confidence_reason")
