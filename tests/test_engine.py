"""A small vault from disk to answers."""

import datetime as dt
import json
import os

import pytest

from tidemark.__main__ import main
from tidemark.api import Service
from tidemark.config import Chunking, Excludes, Model, Settings, Vault
from tidemark.engine import Engine
from tidemark.functions.markdown import chars_for_tokens, token_counter
from tidemark.operators.embed import HashingEmbedder, Lazy, OnnxEmbedder, embedder, probe
from tidemark.operators.retrieval import Weights
from tidemark.sources.vault import list_vault, read_listed
from tidemark.streaming.ingest import ingest


@pytest.fixture()
def vault(tmp_path):
    root = tmp_path / "vault"
    for name, text in {"a.md": "# Apples\nred apples and pears\n", "sub/b.md": "---\ndoc_type: project\nstatus: draft\ndate: 2024-01-01\n---\nblue plums\n", "sub/.hid/_c.md": "hidden grapes\n", ".git/x.md": "no\n", "sub/skip/y.md": "no\n", "sub/t.txt": "no", "q.tmp.md": "no", "bad.md": b"\xff\xfe"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        os.utime(path, (1000, 1000))
    return root


def test_listing(spark, vault):
    vaults = [Vault(str(vault), "v", exclude=Excludes(("skip",), ("*.tmp.*",))), Vault("/nowhere", "off", enabled=False)]
    got = sorted((r.rel_path, r.mtime, r.file_size) for r in list_vault(spark, vaults).collect())
    assert [x[0] for x in got] == ["a.md", "bad.md", "sub/.hid/_c.md", "sub/b.md"] and got[0][1:] == (1000, 30)
    with pytest.raises(FileNotFoundError):
        list_vault(spark, [Vault("/nowhere", "v")])
    rows = {r.absolute_path: r for r in read_listed(spark.createDataFrame([(str(vault / x),) for x in ("a.md", "bad.md", "none.md")], "absolute_path string")).collect()}
    assert rows[str(vault / "a.md")].text.startswith("# Apples") and rows[str(vault / "bad.md")].text is None
    assert len(rows) == 2


SMALL = Model(dimensions=32)


def settings_of(*vaults, **options):
    return Settings(vaults=vaults, embedding_model=SMALL, **options)


def test_life_of_an_index(spark, vault, tmp_path):
    e = Engine(spark, settings_of(Vault(str(vault), "v", exclude=Excludes(("skip",), ("*.tmp.*",)))), str(tmp_path / "store"))
    day = dt.datetime(2024, 6, 1, tzinfo=dt.UTC)
    assert e.scan_index(day)["new"] == 4
    assert e.stats()["active_files"] == 4 and e.stats()["active_chunks"] == 3 == e.stats()["vectors"]
    assert len(e.store.read("vectors").first().embedding) == 32
    found = e.search("plums", 3, mode="keyword", as_of=day.date())
    assert found[0]["file"] == "sub/b.md" and found[0]["confidence_reason"].startswith("Type:project") and e.search("plums", 3, mode="keyword", as_of=day.date()) == found
    assert set(e.scan_index(day).values()) == {0}
    (vault / "a.md").write_text("# Apples\ngreen kiwis\n")
    (vault / "sub/b.md").rename(vault / "zanzibar.md")
    (vault / "sub/.hid/_c.md").unlink()
    assert e.scan_index(day) == {"new": 0, "modified": 1, "moved": 1, "deleted": 1, "touched": 0}
    first = lambda q: next((r.file_path for r in e.results(q, 1, w=Weights(0.0, 1.0)).collect() if r.keyword_score > 0), None)
    assert first("kiwis") == "a.md" and first("plums") == "zanzibar.md"
    # what a file is called is found under the new name only; texts that went are not found
    assert first("zanzibar") == "zanzibar.md" and first("b") is None and first("grapes") is None and first("pears") is None
    assert e.stats()["deleted_chunks"] == 2 and e.stats()["vectors"] == 2 == e.store.read("lengths").count()
    assert e.maintenance(dry_run=True)["would_remove"]["files"] == 1 and e.maintenance(force=True)["purged"] and e.stats()["deleted_chunks"] == 0
    assert first("kiwis") == "a.md" and e.store.read("totals").first().n == 2
    row = e.store.read("files").where("file_path = 'a.md'").first()
    assert e.resource(f"x://file/{row.id}")["content_preview"].startswith("# Apples") and e.resource("vault/v")["files"] == 3
    assert e.resource(f"chunks/{row.id}")["chunks"][0]["content"] == "# Apples\ngreen kiwis" and "next" not in e.resource(f"chunks/{row.id}")
    with pytest.raises(ValueError):
        e.resource("other/1")
    assert "zanzibar.md" in e.prompt_search("plums", as_of=day.date()) and "blue plums" in e.prompt_summary("zanzibar.md")


def test_vaults_that_are_not_scanned_stay(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.md").write_text(f"{name} cherry\n")
    one, two = (Vault(str(tmp_path / x), x) for x in ("one", "two"))
    e = Engine(spark, settings_of(one, two), str(tmp_path / "store"))
    e.rebuild()
    for vaults in ((one, Vault(two.path, "two", enabled=False)), (one,)):
        e._use(settings_of(*vaults))
        assert set(e.scan_index().values()) == {0} and e.stats()["active_files"] == 2
        # without a name all enabled vaults are searched, and no other
        assert {r["file"] for r in e.search("cherry")} == {"one.md"}
        with pytest.raises(ValueError):
            e.search("cherry", vaults=["two"])
    (tmp_path / "one/one.md").unlink()
    assert e.scan_index()["deleted"] == 1 and e.stats()["active_files"] == 1
    e._use(settings_of(one, two))
    assert {r["file"] for r in e.search("cherry")} == {"two.md"}


def test_segmented_index(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.md").write_text("中国联通网络优化\n")
    (tmp_path / "words.txt").write_text("中国联通 1000 nz\n网络 100 n\n优化 100 n\n")
    plain = Engine(spark, settings_of(Vault(str(tmp_path / "v"), "v")), str(tmp_path / "plain"))
    cut = Engine(spark, settings_of(Vault(str(tmp_path / "v"), "v"), jieba_user_dict=str(tmp_path / "words.txt")), str(tmp_path / "cut"))
    for e, terms, score in ((plain, 4, False), (cut, 6, True)):
        e.rebuild()
        assert e.store.read("postings").count() in (terms, terms + 1, terms + 2)
        assert (e.results("优化网络", 1).first().keyword_score > 0) == score


def test_service(spark, vault, tmp_path):
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts/prompt_search_with_context.md").write_text("Q {{query}} C {{context}}")
    s = settings_of(Vault(str(vault), "v"), prompts=str(tmp_path / "prompts"))
    service = Service(Engine(spark, s, str(tmp_path / "store"), cache_file=str(tmp_path / "c/cache.db")), str(tmp_path / "none.yaml"))
    assert service.call("rebuild_index")["status"] == "completed" and service.call("scan_index")["summary"].startswith("new: 0")
    got = service.call("search", {"query": "pears", "mode": "hybrid", "top_k": 1})
    assert got["total"] == 1 and got["query"] == "pears" and set(got["results"][0]) == {"rank", "file", "abs_path", "content", "score", "confidence", "confidence_reason"}
    assert service.call("search", {"query": "x", "alpha": 0.6, "beta": 0.6}) == {"error": "alpha and beta must make 1, not 1.2", "query": "x", "total": 0, "results": []}
    assert service.call("search", {"query": "x", "vaults": ["w"]})["total"] == 0
    assert all("error" in service.call(*x) for x in (("search",), ("nothing",), ("stats", {"x": 1}), ("reload_config",)))
    assert service.call("stats")["files"] == {"total": 6, "by_vault": {"v": 6}} and service.call("config")["vaults"][0]["exclude"] == {"dirs": [], "patterns": []}
    assert service.call("maintenance", {"dry_run": True})["status"] == "dry_run" and service.call("maintenance")["status"] == "completed"
    assert service.read("chunks/x") == {"error": "x is no file id"} and "error" in service.read("file/1") and service.read("vault/none")["files"] == 0
    with pytest.raises(ValueError):
        service.read("nothing/1")
    assert service.prompt("search_with_context", {"query": "pears", "top_k": "1"}).startswith("Q pears C 【文档 1】")
    assert "none of the vaults" in service.prompt("search_with_context", {"query": "pears", "vaults": "w"}) and service.prompt("summarize_document", {"file_path": "none"}).startswith("unknown")


def test_token_modes():
    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(ranks):
        pytest.skip("no vocabulary here")
    exact = token_counter(Chunking(token_mode="tiktoken", vocabulary=ranks))
    assert exact("hello world") == 2 and exact("") == 0 and token_counter(Chunking())("hello world") == 2
    assert exact("internationalisation of everything") != token_counter(Chunking())("internationalisation of everything")
    assert chars_for_tokens(3) == 12
    with pytest.raises(ValueError):
        token_counter(Chunking(token_mode="other"))


def test_models(tmp_path):
    now, made = [0.0], []
    lazy = Lazy(lambda: made.append(1) or HashingEmbedder(8), 0, lambda: now[0])
    assert not lazy.loaded and lazy.dimensions == 8 and lazy.embed(["a"]).shape == (1, 8) and made == [1]
    lazy.unload()
    assert not lazy.loaded and lazy.embed(["a"]).shape == (1, 8) and made == [1, 1]
    lazy.idle = 5
    now[0] = 100.0
    lazy._look()  # what the timer calls
    assert not lazy.loaded
    assert probe(HashingEmbedder(16)) == 16 and embedder(Model(dimensions=16)) is embedder(Model(dimensions=16)) and embedder(Model(dimensions=16)).dimensions == 16
    with pytest.raises(FileNotFoundError):
        OnnxEmbedder(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        embedder(Model(name="none", cache_dir=str(tmp_path))).embed(["a"])


def test_command_line(spark, vault, tmp_path, capsys):
    config = tmp_path / "c.yaml"
    config.write_text(f"vaults: [{{path: {vault}, name: v}}]\nretrieval: {{alpha: 0.6, beta: 0.4}}\nembedding_model: {{dimensions: 16}}\ncache: {{db_path: {tmp_path}/cache.db}}\nlog_level: ERROR\n")

    def run(*args):
        code = main(["--config", str(config), "--store", str(tmp_path / "store"), *args])
        return code, capsys.readouterr().out

    assert run("config") == run("config", "--parsed") and '"alpha": 0.6' in run("config")[1]
    assert run("config", "--show")[1].startswith("vaults:") and run("config", "--validate") == (0, "valid\n")
    assert run("search", "pears")[0] == 1  # no index yet
    assert '"active_files": 6' in run("index", "build")[1] and "--force" in run("index", "build")[1] and '"new": 0' in run("index", "scan")[1]
    code, out = run("search", "pears", "--top-k", "2", "--output", "json")
    assert code == 0 and json.loads(out)[0]["file_path"] == "a.md" and len(json.loads(out)[0]) == 16
    assert run("search", "pears", "--output", "csv", "--vaults", "v")[1].splitlines()[0] == "rank,file_path,absolute_path,section,vault_name,chunk_type,content,final_score,confidence_score,confidence_reason"
    assert "semantic=" in run("search", "pears", "--mode", "keyword")[1] and '"file_ratio": 0.0' in run("status")[1]
    assert '"would_remove"' in run("maintenance", "--dry-run")[1] and '"purged": true' in run("maintenance", "--clean-only", "--force")[1] and '"purged": false' in run("maintenance", "--vacuum-only", "--force")[1]
    config.write_text("retrieval: {alpha: 0.6, beta: 0.6}\n")
    assert run("config", "--validate")[0] == 1


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, store, progress = (str(tmp_path / x) for x in ("in", "store", "progress"))
    spark.range(5).coalesce(1).write.parquet(source)
    ingest(spark, source, store, progress)
    ingest(spark, source, store, progress)
    assert spark.read.parquet(store).count() == 5
    spark.range(3).coalesce(1).write.mode("append").parquet(source)
    ingest(spark, source, store, progress)
    assert spark.read.parquet(store).count() == 8
