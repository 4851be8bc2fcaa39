"""Ranking: BM25 against SQLite's full-text index, fusion and deduplication by hand."""

import datetime as dt
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.config import Confidence
from tidemark.operators import dedup
from tidemark.operators import retrieval as R
from tidemark.operators.embed import HashingEmbedder, embed_chunks
from tidemark.operators.index import Index, text_index, weighted_texts

CORPUS = ["alpha beta beta gamma", "alpha alpha delta", "beta epsilon zeta eta theta", "2024-01-15 报告 中国联通", "été_x foo", "alpha"]
QUERIES = ["beta", "alpha", "alpha beta", "beta beta", "2024-01-15", "01-15", "15-01", "中国", "-", "ete", "x", "été_x", "", "Alpha-alpha delta foo"]


def texts(spark, given):
    return spark.createDataFrame([(i + 1, t, "x") for i, t in enumerate(given)], "chunk_id long, content string, terms string")


def sqlite_scores(corpus, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content)")
    db.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", [(i + 1, t) for i, t in enumerate(corpus)])
    words = [w for w in query.split() if any(c.isalnum() for c in w)]
    if not words:
        return {}
    return {r: -s for r, s in db.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (" OR ".join(f'"{w}"' for w in words),))}


def test_bm25_like_sqlite(spark):
    got: dict = {}
    for r in R.bm25(text_index(texts(spark, CORPUS)), QUERIES).collect():
        got.setdefault(r.query_no, {})[r.chunk_id] = r.score
    for i, q in enumerate(QUERIES):
        assert got.get(i, {}) == pytest.approx(sqlite_scores(CORPUS, q), abs=1e-9), q


def test_bm25_edges(spark):
    assert R.bm25(text_index(texts(spark, [])), ["a"]).count() == 0
    few = text_index(texts(spark, [None, "", "a"]))
    assert R.bm25(few, ["a", "?"]).count() == 1
    assert R.bm25(few, ["a"], within=texts(spark, [None]).select("chunk_id")).count() == 0
    tied = R.bm25_topk(text_index(texts(spark, ["a b", "a b", "c", "d", "e"])), ["a"], 1).collect()
    assert [(r.rank, r.chunk_id) for r in tied] == [(1, 1)]
    stored = text_index(texts(spark, ["b a b", None]))
    assert sorted((r.chunk_id, r.term, r.dl, r.position) for r in stored.postings.collect()) == [(1, "a", 3, 1), (1, "b", 3, 0), (1, "b", 3, 2)]
    assert tuple(stored.totals.first())[:2] == (2, 3) and stored.of(["b"]).count() == 2 and stored.of([]).count() == 0


def test_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0]), (4, [0.0]), (5, None), (6, [float("nan"), 0.0]), (7, [0.0, -1.0]), (2, [3.0, 4.0]), (8, [None, 1.0])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    assert [(r[0], r[1]) for r in R.vector_topk(df, [0.0, 0.0], 10).collect()] == [(1, 1.0), (3, 0.5), (7, 0.5), (2, 1 / 6)]
    assert R.vector_topk(df.limit(0), [0.0, 0.0], 3).count() == 0


def test_weights():
    assert R.weights("keyword") == R.Weights(0, 1) and R.weights("semantic") == R.Weights(1, 0)
    assert R.weights(alpha=0.7).beta == pytest.approx(0.3) and R.weights(beta=0.3).alpha == pytest.approx(0.7)
    assert R.weights() == R.Weights(0.6, 0.4)
    with pytest.raises(ValueError):
        R.weights(alpha=0.6, beta=0.6)
    assert R.clamped(0) == 1 and R.clamped(500) == 100
    assert R.enabled_vaults("a, b", ["b"]) == ["b"] and R.enabled_vaults(None, ["b"]) == ["b"]
    with pytest.raises(ValueError):
        R.enabled_vaults(["x"], ["b"])


@pytest.fixture()
def index(spark):
    about = '{"doc_type":"x","status":"y"}'
    chunks = [(1, 1, "apple pie", "", "text", 0, 9, about, False), (2, 1, "apple", "T", "text", 9, 14, about, None), (3, 2, "pear", "T", "text", 0, 4, about, False), (4, 3, "apple", "T", "text", 0, 4, about, True), (5, 4, "plum", "T", "text", 0, 1, about, False), (6, 5, "fig", "T", "text", 0, 1, about, False)]
    files = [(1, "a.md", "/v1/a.md", "v1", "h", False), (2, "a.md", "/v2/a.md", "v2", "h", False), (3, "c.md", "/c", "v1", "h", False), (4, "d.md", "/d", "v1", "h", True), (5, "e.md", "/e", "v1", "h", False)]
    vectors = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0])]
    chunks = [(*c[:3], c[3], f"P{c[0]}", '{"tags": ["green", 7]}' if c[0] == 3 else "{", *c[4:]) for c in chunks]
    c = spark.createDataFrame(chunks, "id long, file_id long, content string, section_title string, section_path string, metadata string, content_type string, start_pos int, end_pos int, confidence_json string, is_deleted boolean")
    f = spark.createDataFrame(files, "id long, file_path string, absolute_path string, vault_name string, file_hash string, is_deleted boolean")
    return Index(f, c, spark.createDataFrame([v for v in vectors if v[0] in (1, 2, 3)], "chunk_id long, embedding array<float>"), text_index(weighted_texts(f, c)))


def test_search(index):
    rows = R.search(index, "apple", [1.0, 0.0], 5, rules=Confidence(), as_of=dt.date(2024, 1, 1)).collect()
    # one path in two vaults is one file; flagged chunks and files are out
    assert [(r.rank, r.chunk_id, r.section) for r in rows] == [(1, 1, "Root")]
    assert rows[0].semantic_score == 1.0 and rows[0].final_score == pytest.approx((0.6 + 0.4 * math.log1p(rows[0].keyword_score)) * math.log(2))
    assert R.search(index, "apple", [1.0, 0.0], 5, vaults=["v2"]).first().chunk_id == 3
    assert R.search(index, "  ", [1.0, 0.0], 5).count() == 0
    assert R.search(index, "fig", [1.0, 0.0], 5, w=R.weights("semantic"), rules=Confidence()).orderBy("rank").collect()[-1].final_score == 0.0
    assert [R.search(index, "fig", [1.0, 0.0], 1, vaults=["v2"], prefilter=p).count() for p in (False, True)] == [1, 1]
    assert [R.search(index, q, [1.0, 0.0], 1, w=R.weights("keyword")).first().chunk_id for q in ("e.md", "#green", "7", "P2")] == [6, 3, 3, 2]
    assert R.search(index, "apple", [1.0, 0.0], 5, vaults=[]).count() == 0
    assert {r.chunk_id for r in R.search(index, "apple fig", [1.0, 0.0], 5, similar=0.9).collect()} == {1, 6}
    with pytest.raises(ValueError):
        R.search(index, "apple", [1.0, 0.0], R.MOST_RESULTS + 1)
    shown = R.response(R.search(index, "apple", [1.0, 0.0], 5)).first()
    assert shown.file == "a.md" and R.as_csv(R.search(index, "apple", [1.0, 0.0], 5)).columns[0] == "rank"


def test_fusion_arithmetic(spark):
    s = spark.createDataFrame([(1, 0.5)], "chunk_id long, score double")
    k = spark.createDataFrame([(1, math.e - 1), (2, 1.0)], "chunk_id long, score double")
    assert sorted(map(tuple, R.candidates(s, k).collect())) == [(1, 0.5, math.e - 1), (2, 0.0, 1.0)]
    assert (0.6 * 0.5 + 0.4 * math.log1p(math.e - 1)) * math.log1p(1) == pytest.approx(0.48520302639196167)


def test_similar_results(spark):
    rows = [(1, 10, [1.0, 0.0]), (2, 20, [1.0, 0.0]), (3, 30, [0.0, 1.0]), (4, 40, [0.0, 0.0]), (5, 50, None)]
    df = spark.createDataFrame(rows, "rank long, chunk_id long, embedding array<float>")
    assert [r.chunk_id for r in dedup.semantic_dedup(df).orderBy("rank").collect()] == [10, 30, 40, 50]
    assert {(r.i, r.j): r.similarity for r in dedup.cosine_matrix(df).collect()}[(1, 2)] == pytest.approx(1.0)
    assert dedup.cosine_matrix(df.limit(0)).count() == 0 and dedup.semantic_dedup(df.limit(0)).count() == 0
    # far more than a block, every vector twice
    many = spark.createDataFrame([(i + 1, i, [float(i // 2 + 1), 1000.0 - i // 2, 3.0]) for i in range(1400)], "rank long, chunk_id long, embedding array<float>")
    assert [r.chunk_id for r in dedup.semantic_dedup(many, 1 - 1e-12).orderBy("rank").collect()] == list(range(0, 1400, 2))
    assert dedup.cosine_matrix(many, block=500).count() == 1400 * 1400
    scored = df.withColumn("score", F.col("rank") / 2)
    assert [(r.chunk_id, r.score) for r in dedup.dedup_with_scores(scored).orderBy("rank").collect()] == [(10, 0.5), (30, 1.5), (40, 2.0), (50, 2.5)]
    assert {r.score for r in dedup.dedup_with_scores(df).collect()} == {1.0}
    best = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.5), (3, "b", 0.1)], "chunk_id long, file_path string, final_score double")
    assert sorted(r.chunk_id for r in R.best_by_file(best).collect()) == [1, 3]


def test_embedder(spark):
    df = texts(spark, ["a b", "a b", None, ""])
    got = {r.chunk_id: r.embedding for r in embed_chunks(df).collect()}
    assert set(got) == {1, 2, 4} and got[1] == got[2] and len(got[1]) == HashingEmbedder().dimensions
    assert sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5) and not any(got[4])
    assert df.select(F.lit(1)).count() == 4
