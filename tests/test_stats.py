"""Statistics, upkeep, dictionary and cache."""

import os

import pytest

from tidemark.cache import FileCache, QueryCache, TwoLevelCache, cache_key
from tidemark.operators import stats
from tidemark.plans.maintenance import Store, cascade
from tidemark.sources.dictionary import dictionary_statistics, merge_dictionary, read_dictionary, write_dictionary

C = "id long, file_id long, chunk_index int, content string, content_type string, section_title string, section_path string, start_pos int, end_pos int, is_deleted boolean"
F = "id long, vault_name string, file_path string, absolute_path string, file_hash string, updated_at long, is_deleted boolean"


@pytest.fixture()
def tables(spark):
    files = [(i, "v" if i < 9 else None, f"f{i}", f"/x/F{i}.md", f"h{i % 3}", i % 4, i >= 9) for i in range(1, 11)]
    chunks = [(i, 1 + i % 10, i, f"c{i}", "text", None if i % 2 else "T", "Root", 0, 1, i > 70) for i in range(1, 101)]
    vectors = [(i, [1.0]) for i in range(60, 80)] + [(60, [1.0]), (500, None)]
    return spark.createDataFrame(files, F), spark.createDataFrame(chunks, C), spark.createDataFrame(vectors, "chunk_id long, embedding array<float>")


def test_statistics(tables):
    files, chunks, vectors = tables
    assert stats.overview(*tables).first().asDict() == {"active_files": 8, "deleted_files": 2, "active_chunks": 70, "deleted_chunks": 30, "vectors": 20, "chunks_per_file": 8.8}
    assert tuple(stats.soft_deleted(files, chunks).first()) == (20.0, 30.0, 30.0, True)
    assert not stats.soft_deleted(files, chunks, 30.0).first().needed
    assert tuple(stats.soft_deleted(files.limit(0), chunks.limit(0)).first()) == (0.0, 0.0, 0.0, False)
    assert [(r.vault_name, r.files, r.chunks) for r in stats.by_vault(files, chunks).collect()] == [("v", 8, 56)]
    assert [r.id for r in stats.recent_files(files).collect()] == [3, 7, 2, 6, 1]
    assert stats.next_chunk_index(chunks).first()[0] == 101 and stats.next_chunk_index(chunks.limit(0)).first()[0] == 0
    assert tuple(stats.purge_counts(*tables).first()) == (2, 30, 9)
    f, c, v = stats.purge(*tables)
    assert (f.count(), c.count(), v.select("chunk_id").distinct().count()) == (8, 56, 9)
    assert cascade(f, chunks).count() == 80


def test_lookups(tables):
    files, chunks, _ = tables
    assert [r.id for r in stats.file_chunks(chunks, 2).collect()] == [1, 11, 21, 31, 41, 51, 61]
    assert stats.file_by_hash(files, "h0").first().id == 3 and stats.file_by_hash(files, "h0", True, "none").head() is None
    assert stats.file_by_path(files, "/x/F2.md").first().id == 2 and stats.file_by_path(files, "/q/f3.MD").first().id == 3
    assert stats.file_by_path(files, "nowhere").head() is None


def test_contexts(spark, tables):
    got = {r.file_id: r.context for r in stats.document_context(tables[1], 30).collect()}
    assert got[2].startswith("### 正文\nc1\n### 正文\nc11\n") and len(got[2]) == 30 and len(got) == 10
    assert stats.document_context(tables[1].limit(0)).count() == 0
    hits = spark.createDataFrame([(2, "b", "y" * 400), (1, "a", "x")], "rank int, file_path string, content string")
    assert stats.search_context(hits).first()[0] == "【文档 1】a\n内容: x\n【文档 2】b\n内容: " + "y" * 300
    assert stats.search_context(hits.limit(0)).first()[0] == "无结果"
    assert stats.load_template(None, "x") == stats.load_template("/nowhere/t.md", "x") == "x"
    assert stats.render("{{a}} {{b}} {{c}}", {"a": "{{b}}", "b": "1"}) == "1 1 {{c}}"


def test_store(spark, tables, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.version() == 0
    files, chunks, vectors = tables
    store.write(files=files, chunks=chunks, vectors=vectors)
    assert store.maintain(dry_run=True)["would_remove"] == {"files": 2, "chunks": 30, "vectors": 9}
    assert not store.maintain(threshold=50)["purged"] and store.version() == 1
    assert store.maintain(compact=False)["purged"] and store.version() == 2
    assert store.read("files").count() == 8 and store.maintain()["needed"] is False
    assert not store.maintain(force=True, clean=False)["purged"] and store.version() == 3 and "v2" not in os.listdir(tmp_path / "s")
    assert store.compact(1) == 4 and store.read("files").count() == 8 and store.state()["file_size_mb"] >= 0 < store.bytes()
    assert store.migrate("files", ["id", "file_path"]) == 5 and store.read("files").columns == ["id", "file_path"] and store.read("chunks").count() == 56


def test_dictionary(spark, tmp_path):
    (tmp_path / "one.txt").write_text("a 100 n\n\n# z 1\nc\nb x n\n")
    (tmp_path / "two.txt").write_text("a 1000 n\n b 100 n\n")
    words = read_dictionary(spark, [str(tmp_path / "one.txt"), str(tmp_path / "two.txt")])
    merged = merge_dictionary(words)
    assert sorted(map(tuple, merged.collect())) == [("a", 1000, "two.txt"), ("b", 100, "one.txt")]
    assert tuple(dictionary_statistics(merged).first()) == (2, 1, 1, 2)
    write_dictionary(merged, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a 1000 n", "b 100 n"]
    odd = spark.createDataFrame([(" x ", None, "s"), ("x", 5, "r"), (None, 1, "s"), ("", 1, "s"), ("#c", 9, "s")], "word string, freq int, source string")
    assert [tuple(r) for r in merge_dictionary(odd).collect()] == [("x", 100, "s")]


@pytest.mark.parametrize("file", [False, True])
def test_cache(tmp_path, file):
    now = [0.0]
    clock = lambda: now[0]
    c = FileCache(str(tmp_path / "x/c.db"), 10, 2, clock) if file else QueryCache(10, 2, clock)
    assert c.set("a", [1]) and c.set("b", {"x": "é"}) and c.get("a") == [1]
    now[0] = 1
    assert c.get("a") == [1]
    c.set("c", 3)
    assert c.get("b") is None and c.get("a") == [1] and not c.set("d", object())
    now[0] = 12
    assert c.get("a") is None and c.cleanup() == 1 and c.clear() == 0 and not c.delete("a")
    assert cache_key("q", 1, ["b", "a"], 0.5, 0.5) == cache_key("q", 1, ["a", "b"], 0.5, 0.5) != cache_key("q", 1, None, 0.501, 0.499)


def test_cache_levels(tmp_path):
    path = str(tmp_path / "c.db")
    first = TwoLevelCache(QueryCache(), FileCache(path))
    assert first.set("a", [1]) and not first.set("b", object()) and first.get("a") == [1] and first.get("c") is None
    other = TwoLevelCache(QueryCache(), FileCache(path))
    assert other.get("a") == [1] and other.clear() == 1 and other.get("a") is None
    held = FileCache(path)
    held._db.execute("INSERT INTO results VALUES ('x', '{', 0, 0, 1)")
    held.clock = lambda: 1.0
    assert held.get("x") is None and not held.delete("x")
    held.close()


def test_pages_and_many_chunks(spark):
    rows = [(i, 1, i // 3, "x", "text", None, "Root", 0, 1, False) for i in range(3000)]
    chunks = spark.createDataFrame(rows, C)
    first = stats.chunk_page(chunks, 1, 1000).collect()
    assert [r.id for r in first] == list(range(1000))
    assert [r.id for r in stats.chunk_page(chunks, 1, 10, (first[-1].chunk_index, first[-1].id)).collect()] == list(range(1000, 1010))
    text = stats.document_context(chunks).first().context
    assert text == "\n".join("### 正文\nx" for _ in range(3000))[:8000]
