"""The whole index behind one object: building, scanning, searching, upkeep, lookups and prompts."""

from __future__ import annotations

import datetime as dt
import logging
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cache import FileCache, QueryCache, TwoLevelCache, cache_key
from tidemark.config import Settings, load_config
from tidemark.functions.confidence import query_time
from tidemark.functions.markdown import split_markdown, token_counter
from tidemark.functions.segment import segmented, segmenter
from tidemark.operators import retrieval as R
from tidemark.operators import scan, stats
from tidemark.operators.embed import Embedder, embed_chunks, embedder
from tidemark.operators.index import text_tables, totals_of, weighted_texts
from tidemark.plans.maintenance import Store
from tidemark.session import materialise
from tidemark.sources.dictionary import words_of
from tidemark.sources.vault import list_vault, read_listed

log = logging.getLogger(__name__)

#: The built-in prompts, used where the settings name no folder of templates.
SEARCH_PROMPT = "{{context}}\n\n{{query}}"
SUMMARY_PROMPT = "{{file_path}}\n{{doc_type}} {{status}} {{final_date}}\n\n{{content}}"
#: Names of the template files.
SEARCH_TEMPLATE, SUMMARY_TEMPLATE = "prompt_search_with_context.md", "prompt_summarize_document.md"
#: Chunks of a file that one lookup gives.
PAGE = 1_000
#: Results that are kept in memory, whatever the settings allow the file.
IN_MEMORY = 500


class Engine:
    """``make`` gives the embedder, on the driver and in each Python worker; by default the one the settings name."""

    def __init__(self, spark: SparkSession, settings: Settings, root: str, make: Callable[[], Embedder] | None = None, cache_file: str | None = None):
        self.spark, self.store, self._make = spark, Store(spark, root), make
        self._cache_file = cache_file
        self._use(settings)

    def _use(self, settings: Settings) -> None:
        self.settings, model = settings, settings.embedding_model
        self.make = self._make or (lambda: embedder(model))
        self.words = words_of(self.spark, settings.jieba_user_dict)
        self.cut = segmenter(self.words, settings.jieba_seg_mode)
        c = settings.cache
        held = FileCache(self._cache_file, c.ttl_seconds, c.max_entries) if self._cache_file else None
        self.cache = TwoLevelCache(QueryCache(c.ttl_seconds, min(c.max_entries, IN_MEMORY)), held)

    def reload_config(self, path: str) -> Settings:
        """New settings, all of them: weights, rules, vaults, chunking, segmentation and model."""
        self._use(load_config(path))
        self.cache.clear()
        return self.settings

    def enabled(self) -> list[str]:
        return [v.name for v in self.settings.vaults if v.enabled]

    def _listing(self) -> DataFrame:
        return materialise(list_vault(self.spark, self.settings.vaults, self.settings.exclude), "listing")

    def _chunks(self, files: DataFrame, texts: DataFrame, as_of: dt.datetime) -> DataFrame:
        rows = files.join(texts.select("absolute_path", "text"), "absolute_path").select(F.col("id").alias("file_id"), "text", "mtime")
        stamp, chunking = int(as_of.timestamp()), self.settings.chunking
        token_counter(chunking)  # what can't be counted is said here, not in a task
        made = F.xxhash64("file_id", "chunk_index", F.lit(stamp)).bitwiseAND(F.lit((1 << 62) - 1))
        chunks = split_markdown(rows, chunking, as_of.date(), lambda: token_counter(chunking))
        return chunks.select(made.alias("id"), "*", F.lit(False).alias("is_deleted"), F.lit(stamp).cast("long").alias("created_at"), F.lit(stamp).cast("long").alias("updated_at"))

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        return embed_chunks(chunks.select(F.col("id").alias("chunk_id"), "content"), self.make, self.settings.embedding_model.batch_size)

    def _text(self, files: DataFrame, chunks: DataFrame, buckets: int | None = None) -> dict[str, DataFrame]:
        return text_tables(weighted_texts(files, chunks), self.words, self.settings.jieba_seg_mode, buckets)

    def rebuild(self, as_of: dt.datetime | None = None) -> dict:
        """Everything anew from the vaults; counts of files, chunks and vectors."""
        as_of = as_of or dt.datetime.now(dt.UTC)
        stamp = F.lit(int(as_of.timestamp())).cast("long")
        listing = self._listing()
        texts = materialise(read_listed(listing), "texts")
        files = listing.join(texts.select("absolute_path", "file_hash"), "absolute_path").select(
            "vault_name", F.col("rel_path").alias("file_path"), "absolute_path", "file_hash", "file_size", "mtime", F.lit(False).alias("is_deleted"), stamp.alias("created_at"), stamp.alias("updated_at")
        )
        files = materialise(files.select(scan.new_id().alias("id"), "*"), "files")
        chunks = materialise(self._chunks(files, texts, as_of), "chunks")
        self.store.write(files=files, chunks=chunks, vectors=self._vectors(chunks), **self._text(files, chunks))
        self.cache.clear()
        log.info("index built: version %d", self.store.version())
        return self.stats()

    def scan_index(self, as_of: dt.datetime | None = None) -> dict:
        """Take in what changed on disk: only files whose time or size differs are read. Counts by kind of change.

        Files of vaults that are not listed now, because they are disabled or no longer configured, stay as they are.
        Rows of the text and vector indexes go with their chunks; moved files keep their chunks, whose index texts are
        made anew, as they hold the file's name.
        """
        if not self.store.version():
            self.rebuild(as_of)
            return dict.fromkeys(scan.KINDS, 0) | {"new": self.store.read("files").count()}
        as_of = as_of or dt.datetime.now(dt.UTC)
        stamp = int(as_of.timestamp())
        files, chunks, vectors, postings, lengths = (self.store.read(x) for x in ("files", "chunks", "vectors", "postings", "lengths"))
        active, listing = scan.active_files(files, self.enabled()), self._listing()
        texts = materialise(read_listed(scan.to_hash(active, listing)), "texts")
        changes = materialise(scan.diff_snapshots(active, listing, texts), "changes")
        counts = scan.change_counts(changes).first().asDict()
        log.info("scan: %s", counts)
        if not any(counts.values()):
            return counts
        after = materialise(scan.apply_changes(files, changes, stamp), "files")
        touched = changes.where(F.col("change_type").isin("new", "modified")).select("absolute_path")
        fresh = materialise(self._chunks(after.where(~F.col("is_deleted")).join(touched, "absolute_path", "left_semi"), texts, as_of), "chunks")
        kept = scan.apply_to_chunks(chunks, changes, stamp)
        moved = changes.where(F.col("change_type") == "moved").select(F.col("old_id").alias("file_id")).distinct()
        renamed = kept.join(moved, "file_id", "left_semi").select(*fresh.columns)
        buckets = self.store.read("totals").head().buckets
        text = self._text(after, fresh.unionByName(renamed), buckets)
        stale = scan.retired(chunks, changes, ("modified", "deleted", "moved"))
        text["lengths"] = lengths.join(stale, "chunk_id", "left_anti").unionByName(text["lengths"])
        text["postings"] = postings.join(stale, "chunk_id", "left_anti").unionByName(text["postings"])
        text["totals"] = totals_of(text["lengths"], buckets)
        gone = scan.retired(chunks, changes, ("modified", "deleted"))
        self.store.write(files=after, chunks=kept.unionByName(fresh), vectors=vectors.join(gone, "chunk_id", "left_anti").unionByName(self._vectors(fresh)), **text)
        self.cache.clear()
        return counts

    def search(self, query: str, top_k: int = 10, vaults=None, mode: str | None = None, alpha: float | None = None, beta: float | None = None, as_of: dt.date | None = None, similar: float | None = None) -> list[dict]:
        """The response of a search as a list; served from the cache while the tables are the same."""
        s = self.settings
        w = R.weights(mode, alpha, beta, (s.retrieval["alpha"], s.retrieval["beta"]))
        names = R.enabled_vaults(vaults, self.enabled())
        limit, day = R.clamped(top_k), as_of or dt.datetime.now(dt.UTC).date()
        key = cache_key(query, limit, names, w.alpha, w.beta, [query_time(query), day, similar], [self.store.root, self.store.version()])
        if (held := self.cache.get(key)) is not None:
            return held
        rows = R.response(self.results(query, limit, w=w, vaults=names, as_of=day, similar=similar)).orderBy("rank").collect()
        out = [r.asDict() for r in rows]
        self.cache.set(key, out)
        return out

    def results(self, query: str, limit: int, **options) -> DataFrame:
        """A search with all fields; the full text is asked for the query's segments where there is a segmenter."""
        vector = self.make().embed([query])[0].tolist()
        return R.search(self.store.index(), query, vector, limit, rules=self.settings.confidence, words=segmented(query, self.cut), **options)

    def stats(self) -> dict:
        return stats.overview(*(self.store.read(x) for x in ("files", "chunks", "vectors"))).first().asDict()

    def statistics(self) -> dict:
        """Counts by table and vault, the store's size, and the model."""
        files, chunks = self.store.read("files"), self.store.read("chunks")
        found, model = self.stats(), self.settings.embedding_model
        by_vault = {r.vault_name: r.files for r in stats.by_vault(files, chunks).collect()}  # a row a vault
        return {
            "files": {"total": found["active_files"], "by_vault": by_vault}, "chunks": {"total": found["active_chunks"], "avg_per_file": found["chunks_per_file"]},
            "vectors": {"total": found["vectors"], "dimensions": model.dimensions}, "storage": {"db_size_mb": round(self.store.bytes() / (1 << 20), 2), "db_path": self.store.root}, "model": {"name": model.name, "size": model.size},
        }

    def maintenance(self, force: bool = False, dry_run: bool = False, clean: bool = True, compact: bool = True) -> dict:
        return self.store.maintain(100 * float(self.settings.maintenance["soft_delete_threshold"]), force, dry_run, clean, compact, log.info)

    def resource(self, uri: str) -> Any:
        """``vault/<name>``: counts; ``file/<id>``: its row and 10,000 characters; ``chunks/<id>``: its chunks in order.

        Chunks come in pages of PAGE; ``next`` is the address of the next one.
        """
        m = re.fullmatch(r"(?:\w+://)?(vault|file|chunks)/([^?]+)(?:\?after=(-?\d+),(-?\d+))?", uri)
        if not m:
            raise ValueError(f"unknown resource {uri}")
        kind, name = m[1], m[2]
        files, chunks = self.store.read("files"), self.store.read("chunks")
        if kind == "vault":
            rows = stats.by_vault(files, chunks).where(F.col("vault_name") == name).collect()
            recent = stats.recent_files(files.where(F.col("vault_name") == name), columns=("file_path", "mtime", "file_size")).collect()
            return {**(rows[0].asDict() if rows else {"vault_name": name, "files": 0, "chunks": 0}), "recent": [r.asDict() for r in recent]}
        if not name.isdecimal():
            raise ValueError(f"{name} is no file id")
        if kind == "chunks":
            after = (int(m[3]), int(m[4])) if m[3] else None
            page = [r.asDict() for r in stats.chunk_page(chunks, int(name), PAGE, after).collect()]
            total = stats.file_chunks(chunks, int(name)).count()
            more = {"next": f"chunks/{name}?after={page[-1]['chunk_index']},{page[-1]['id']}"} if len(page) == PAGE else {}
            return {"file_id": int(name), "total": total, "chunks": page, **more}
        row = files.where((F.col("id") == int(name)) & ~F.col("is_deleted")).head()
        if row is None:
            raise ValueError(f"unknown file {name}")
        text = read_listed(self.spark.createDataFrame([(row.absolute_path,)], "absolute_path string")).select(F.substring("text", 1, 10_000)).head()
        return {**row.asDict(), "content_preview": text[0] if text and text[0] is not None else "[Error reading file]"}

    def _template(self, name: str, default: str) -> str:
        return stats.load_template(f"{self.settings.prompts.rstrip('/')}/{name}" if self.settings.prompts else None, default)

    def prompt_search(self, query: str, top_k: int = 5, vaults=None, template: str | None = None, as_of: dt.date | None = None, alpha: float | None = None, beta: float | None = None) -> str:
        s = self.settings
        values = {"query": query}
        try:
            names = R.enabled_vaults(vaults, self.enabled())
            w = R.weights(None, alpha, beta, (s.retrieval["alpha"], s.retrieval["beta"]))
            found = self.results(query, R.clamped(top_k), w=w, vaults=names, as_of=as_of or dt.datetime.now(dt.UTC).date())
            values["context"] = stats.search_context(found).first()[0]
        except ValueError as error:  # what was asked for can't be: the reader of the prompt is told so
            values["context"] = str(error)
        return stats.render(template or self._template(SEARCH_TEMPLATE, SEARCH_PROMPT), values)

    def prompt_summary(self, path: str, template: str | None = None) -> str:
        """A prompt to sum up a file, with what its first chunk says about it."""
        file = stats.file_by_path(self.store.read("files").where(~F.col("is_deleted")), path).head()
        if file is None:
            raise ValueError(f"unknown file {path}")
        chunks = self.store.read("chunks").where(F.col("file_id") == file.id)
        context = stats.document_context(chunks).head()
        about = chunks.where(~F.col("is_deleted")).orderBy("chunk_index", "id").select(*(F.get_json_object("confidence_json", f"$.{k}").alias(k) for k in ("doc_type", "status", "final_date"))).head()
        values = {"file_path": file.file_path, **{k: (about[k] if about else None) or "" for k in ("doc_type", "status", "final_date")}, "content": context.context if context else ""}
        return stats.render(template or self._template(SUMMARY_TEMPLATE, SUMMARY_PROMPT), values)
