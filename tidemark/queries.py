"""Registered queries of the core and their SQL.

Stored tables are taken at their current rows; ``as_of`` and the queries' texts are fixed, so results never depend on
the day of a run. Searches read an index that is built at the first use of a data folder, as it would be in service.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import SHIPPED_HALF_LIVES, SHIPPED_STATUSES, SHIPPED_TYPES, Chunking, Confidence, Excludes, Vault
from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.functions.confidence import QueryTime, confidence, query_time_columns
from tidemark.functions.markdown import abouts, split_markdown
from tidemark.operators import dedup, scan, stats
from tidemark.operators import retrieval as R
from tidemark.operators.embed import embed_chunks
from tidemark.operators.index import Index, one_vector, text_tables, tokenised, weighted_texts
from tidemark.operators.snapshots import folded, snapshot_changes
from tidemark.plans.maintenance import Store, cascade
from tidemark.session import materialise, scratch, shared_dir
from tidemark.sources.dictionary import dictionary_statistics, merge_dictionary
from tidemark.sources.tables import current, current_texts, not_deleted, table
from tidemark.sources.vault import list_vault, read_listed
from tidemark.streaming.ingest import changes_once

FLAGSHIP = "hybrid_search"
AS_OF = dt.date(2024, 6, 1)
AS_OF_SECONDS = 1_717_200_000
#: Fixed inputs of the search queries.
QUERY = "sensor of the hollow-quarry 传感器 bridge sensor"
TIMED = "report of 2024-03-05 sensor bridge"
NAMED, TAGGED = "station-journal", "#queue #beacon"
BATCH = ["sensor", "the bridge of the harbor", "été l'index de la bobine", "hollow-quarry", "válvula del túnel", "sensor sensor", "?!", "2024年 Behälter", "station-journal.md"]
VAULTS = ["tidewater", "fieldbook"]
WIDTH = 64

#: Indexes that are open, by folder.
_OPEN: dict[str, Index] = {}

FILE_COLUMNS = ("vault_name", "file_path", "absolute_path", "file_hash", "file_size", "mtime", "is_deleted", "created_at")
CHUNK_COLUMNS = ("file_id", "chunk_index", "content", "content_type", "section_title", "section_path", "start_pos", "end_pos", "metadata", "confidence_json", "is_deleted", "created_at")


def files_now(spark: SparkSession, d: str) -> DataFrame:
    return current(table(spark, d, "files"), *FILE_COLUMNS)


def chunks_now(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current chunks with small columns; the others are never read or shuffled."""
    return current(table(spark, d, "chunks"), *columns)


def vectors_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vectors")


def build_index(spark: SparkSession, d: str, root: str) -> Index:
    """The stored index of a data folder: files and chunks with one row an id, vectors and terms of the live ones."""
    store = Store(spark, root)
    number = store.version() + 1
    files = store.put(number, "files", files_now(spark, d))
    chunks = store.put(number, "chunks", current_texts(table(spark, d, "chunks"), *CHUNK_COLUMNS))
    live = chunks.where(not_deleted()).join(files.where(not_deleted()).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    vectors = one_vector(vectors_of(spark, d), WIDTH).join(live.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    for name, df in {"vectors": vectors, **text_tables(weighted_texts(files, chunks))}.items():
        store.put(number, name, df)
    store.count(number)
    return store.index()


def _state_of(spark: SparkSession, d: str) -> str:
    """A name for what a data folder's tables hold now: their files' sizes and times."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in ("files", "chunks", "vectors"):
        path = jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        at = path.getFileSystem(conf).getContentSummary(path)
        seen.append([name, at.getLength(), at.getFileCount(), path.getFileSystem(conf).getFileStatus(path).getModificationTime()])
    return hashlib.sha256(repr([d, seen]).encode()).hexdigest()[:24]


def index_of(spark: SparkSession, d: str) -> Index:
    """The index of a data folder, built once an application and kept in the shared folder until the application ends."""
    root = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/index-{_state_of(spark, d)}"
    scratch(spark, "index")  # whatever lies beside it goes with the application
    store = Store(spark, root)
    if not store.version():
        _OPEN[root] = build_index(spark, d, root)
    elif root not in _OPEN:
        _OPEN[root] = store.index()
    return _OPEN[root]


def index_build(spark: SparkSession, d: str) -> DataFrame:
    """A new index of the folder, built whatever is there: rows of its tables."""
    built = build_index(spark, d, scratch(spark, "index"))
    counts = {"files": built.files, "chunks": built.chunks, "vectors": built.vectors, "texts": built.text.lengths, "terms": built.text.postings}
    return stats.beside(*(df.agg(F.count("*").alias(name)) for name, df in counts.items()))


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The stored vector of the smallest chunk_id that has a length: one row reaches the driver."""
    found = index_of(spark, d).vectors.where(V.norm(F.col("embedding")) > 0).orderBy("chunk_id").select("embedding").head()
    return list(found[0]) if found else [1.0] + [0.0] * (WIDTH - 1)


def _found(spark: SparkSession, d: str, query: str = QUERY, **options) -> DataFrame:
    return R.search(index_of(spark, d), query, query_vector(spark, d), as_of=AS_OF, **options)


def _search(spark: SparkSession, d: str, query: str = QUERY, **options) -> DataFrame:
    rows = _found(spark, d, query, **options)
    return rows.select("rank", "chunk_id", "file_path", "vault_name", "section", *(F.round(c, 6).alias(c) for c in ("semantic_score", "keyword_score", "confidence_score", "final_score")))


def _ranked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The 100 nearest vectors with their ranks and scores."""
    v = index_of(spark, d).vectors
    top = R.vector_topk(v, query_vector(spark, d), 100, unique=True).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "chunk_id")).cast("long"))
    return v.join(F.broadcast(top), "chunk_id").select("rank", "chunk_id", "score", "embedding")


def disk_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in for reading files: the hash each path had in the last deliveries, folded."""
    seen = table(spark, d, "file_snapshots").where(F.col("file_hash").isNotNull())
    last = seen.groupBy("absolute_path").agg(F.max(F.struct("snapshot_no", "updated_at", folded(F.col("file_hash")).alias("h"))).alias("s"))
    return last.select("absolute_path", F.col("s.h").alias("file_hash"))


def scan_inputs(spark: SparkSession, d: str, vaults: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored files, the disk's listing and the changes; of all vaults, or of some that are scanned."""
    stored, disk = files_now(spark, d).withColumn("file_hash", folded(F.col("file_hash"))), table(spark, d, "disk_listing")
    if vaults is None:
        return stored, disk, scan.diff_snapshots(stored.where(not_deleted()), disk, disk_hashes(spark, d))
    disk = disk.where(F.col("vault_name").isin(vaults))
    return stored, disk, scan.diff_snapshots(scan.active_files(stored, vaults), disk, disk_hashes(spark, d))


def _known(rows: DataFrame) -> DataFrame:
    """Ids made for new files are left out, as SQL can't make them."""
    return rows.withColumn("known_id", F.when(F.col("id") < (1 << 62), F.col("id")))


def apply_scan(spark: SparkSession, d: str) -> DataFrame:
    stored, _, changes = scan_inputs(spark, d)
    return _known(scan.apply_changes(stored, changes, AS_OF_SECONDS)).select("known_id", "vault_name", "file_path", "file_hash", "file_size", "mtime", "is_deleted", "updated_at")


def chunks_after_scan(spark: SparkSession, d: str) -> DataFrame:
    after = scan.apply_to_chunks(chunks_now(spark, d, "file_id", "is_deleted"), scan_inputs(spark, d)[2], AS_OF_SECONDS)
    return after.select("id", "file_id", "is_deleted", "updated_at")


def vectors_after_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.without_deleted(vectors_of(spark, d).select("chunk_id").distinct(), chunks_after_scan(spark, d))


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """The listing put into the stored files by vault and path."""
    rows = table(spark, d, "disk_listing").select("vault_name", F.col("rel_path").alias("file_path"), "absolute_path", "mtime", "file_size").join(disk_hashes(spark, d), "absolute_path", "left")
    return _known(scan.upsert_files(files_now(spark, d), rows, AS_OF_SECONDS)).select("known_id", "vault_name", "file_path", "absolute_path", "file_hash", "file_size", "mtime", "is_deleted", "updated_at")


def file_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """The file found by the hash of the first live file that has one."""
    files = files_now(spark, d)
    first = files.where(not_deleted() & F.col("file_hash").isNotNull()).orderBy("id").select("file_hash").head()
    return stats.file_by_hash(files, first[0] if first else "").select("id", "vault_name", "file_path")


def confidences(spark: SparkSession, d: str, time: QueryTime | None = None) -> DataFrame:
    rows = chunks_now(spark, d, "confidence_json")
    found = rows.select(F.col("id").alias("chunk_id"), *confidence(F.col("confidence_json"), Confidence.shipped(), AS_OF, time))
    return found.select("chunk_id", F.round("confidence_score", 6).alias("confidence_score"), "confidence_reason")


def index_texts(spark: SparkSession, d: str) -> DataFrame:
    return weighted_texts(files_now(spark, d), current_texts(table(spark, d, "chunks"), "file_id", "content", "section_title", "section_path", "metadata", "is_deleted", where=not_deleted()))


def term_counts(spark: SparkSession, d: str) -> DataFrame:
    found = tokenised(index_texts(spark, d))
    return found.select("chunk_id", F.size("terms").cast("long").alias("dl"), F.size(F.array_distinct("terms")).cast("long").alias("distinct_terms"))


def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text", "mtime")
    return split_markdown(rows, Chunking(overlap=100), AS_OF)


#: A file worked out by hand: every kind of block, and the lines that end a table.
FIXTURE = "---\ndoc_type: project\nstatus: draft\ndate: 2024-03-05\ntags: [net, ops]\n---\n# A\nintro\n## B\n- one\n- two\n\nafter\n| h |\n|---|\n- x\n- y\n```py\n1\n```\ntail\n"
FIXTURE_CHUNKS = [
    ("header", "A", 0, 10, "# A\nintro"), ("header", "A / B", 10, 15, "## B"), ("list", "A / B", 15, 28, "- one\n- two"), ("text", "A / B", 28, 34, "after"), ("table", "A / B", 34, 46, "| h |\n|---|"),
    ("text", "A / B", 46, 50, "- x"), ("list", "A / B", 50, 54, "- y"), ("code", "A / B", 54, 66, "```py\n1\n```"), ("text", "A / B", 66, 71, "tail"),
]


def markdown_fixture(spark: SparkSession, d: str) -> DataFrame:
    """The file above with each row of the samples' ids, as one file each."""
    rows = table(spark, d, "lang_samples").select(F.col("sample_id").cast("long").alias("file_id"), F.lit(FIXTURE).alias("text"), F.lit(0.0).alias("mtime"))
    return split_markdown(rows, Chunking(), AS_OF).select("file_id", "chunk_index", "content_type", "section_path", "start_pos", "end_pos", "content", F.get_json_object("confidence_json", "$.final_date").alias("final_date"))


def frontmatters(spark: SparkSession, d: str) -> DataFrame:
    found = abouts(table(spark, d, "documents").select("doc_id", "text", "mtime"), AS_OF)
    return found.select("doc_id", "doc_type", "status", "final_date", F.char_length("body").cast("long").alias("body_length"))


def document_hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.sha2("text", 256).alias("hash"), F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd").alias("day"))


def vault_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents written out as a vault, walked, read and hashed; a folder and a pattern are left out."""
    root = scratch(spark, "vault").removeprefix("file:")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "wb") as f:
                    f.write(text.encode())
            yield batch.select(["path"])

    kind = F.col("doc_id") % 10
    name = F.when(kind == 1, "skip/").when(kind == 2, "a/.hidden/_").when(kind == 3, "b/x.tmp.").otherwise(F.concat(F.lit("c"), kind.cast("string"), F.lit("/")))
    rows = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.concat(name, F.col("doc_id").cast("string"), F.when(kind == 4, ".txt").otherwise(".md")).alias("path"), "text")
    materialise(rows.mapInArrow(write, "path string"), "written")
    listing = list_vault(spark, [Vault(root, "v", exclude=Excludes(("skip",), ("x.tmp*",)))])
    found = listing.join(read_listed(listing), "absolute_path")
    return found.select("rel_path", "file_size", "file_hash", F.char_length("text").cast("long").alias("length"))


def compacted(spark: SparkSession, d: str) -> DataFrame:
    """The current files stored, compacted and read again."""
    store = Store(spark, scratch(spark, "store"))
    store.write(files=files_now(spark, d).repartition(8))
    store.compact(1)
    return store.read("files").select("id", "file_path", "updated_at")


def cosines(spark: SparkSession, d: str) -> DataFrame:
    v = index_of(spark, d).vectors
    return v.select("chunk_id", F.round(V.cosine(F.col("embedding"), V.literal(query_vector(spark, d))), 5).alias("similarity"))


def missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = scan.files_without_chunks(files_now(spark, d), chunks_now(spark, d, "file_id", "is_deleted"))
    return found.select("id", "vault_name", "file_path")


def orphan_vectors(spark: SparkSession, d: str) -> DataFrame:
    c = chunks_now(spark, d, "is_deleted").where(not_deleted()).select(F.col("id").alias("chunk_id"))
    return vectors_of(spark, d).select("chunk_id").distinct().join(c, "chunk_id", "left_anti")


def purged(spark: SparkSession, d: str) -> DataFrame:
    f, c, v = stats.purge(files_now(spark, d), chunks_now(spark, d, "file_id", "is_deleted"), vectors_of(spark, d).select("chunk_id").distinct())
    side = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"))
    return side(f, "file", "id").unionByName(side(c, "chunk", "id")).unionByName(side(v, "vector", "chunk_id"))


def _small(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flags and keys only."""
    return files_now(spark, d), chunks_now(spark, d, "file_id", "is_deleted"), vectors_of(spark, d)


QUERIES = {
    "p1_found": lambda s, d: snapshot_changes(table(s, d, "file_snapshots")),
    "vector_topk": lambda s, d: R.vector_topk(index_of(s, d).vectors, query_vector(s, d), 100, unique=True).select("chunk_id", F.round("score", 6).alias("score")),
    "bm25_topk": lambda s, d: R.bm25_topk(index_of(s, d).text, [QUERY], 100).select("rank", "chunk_id", F.round("score", 6).alias("score")),
    "bm25_multi_query": lambda s, d: R.bm25(index_of(s, d).text, BATCH).select("query_no", "chunk_id", F.round("score", 6).alias("score")),
    "index_build": index_build,
    "term_statistics": term_counts,
    "confidence_decay": confidences,
    "confidence_time_match": lambda s, d: confidences(s, d, QueryTime(2024, 3, 5)),
    "time_range_parse": lambda s, d: table(s, d, "documents").select("doc_id", *query_time_columns(F.col("text"))),
    "hybrid_search": _search,
    "hybrid_timed": lambda s, d: _search(s, d, TIMED),
    "hybrid_keyword_mode": lambda s, d: _search(s, d, w=R.weights("keyword")),
    "hybrid_semantic_mode": lambda s, d: _search(s, d, w=R.weights("semantic")),
    "hybrid_vault_postfilter": lambda s, d: _search(s, d, vaults=VAULTS),
    "hybrid_vault_prefilter": lambda s, d: _search(s, d, vaults=VAULTS, prefilter=True),
    "search_by_filename": lambda s, d: _search(s, d, NAMED, w=R.weights("keyword")),
    "search_by_tag": lambda s, d: _search(s, d, TAGGED, w=R.weights("keyword")),
    "search_blank": lambda s, d: _search(s, d, " \t"),
    "search_distinct": lambda s, d: _search(s, d, similar=0.85),
    "search_csv": lambda s, d: R.as_csv(_found(s, d)).select("rank", "file_path", "absolute_path", "section", "vault_name", "chunk_type", "content", *(F.round(c, 6).alias(c) for c in ("final_score", "confidence_score")), "confidence_reason"),
    "search_response": lambda s, d: R.response(_found(s, d)),
    "search_context": lambda s, d: stats.search_context(_found(s, d)),
    "cosine_matrix": lambda s, d: dedup.cosine_matrix(_ranked_vectors(s, d)).select("i", "j", F.round("similarity", 5).alias("similarity")),
    "semantic_dedup": lambda s, d: dedup.semantic_dedup(_ranked_vectors(s, d)),
    "dedup_with_scores": lambda s, d: dedup.dedup_with_scores(_ranked_vectors(s, d)).select("rank", "chunk_id", F.round("score", 6).alias("score")),
    "cosine_to_query": cosines,
    "scan_diff_two_vaults": lambda s, d: scan_inputs(s, d, VAULTS)[2],
    "scan_diff": lambda s, d: scan_inputs(s, d)[2],
    "scan_summary": lambda s, d: scan.change_counts(scan_inputs(s, d)[2]),
    "apply_scan": apply_scan,
    "chunks_after_scan": chunks_after_scan,
    "vectors_after_scan": vectors_after_scan,
    "upsert_files": upserted,
    "file_by_hash": file_by_hash,
    "vault_files": vault_files,
    "compacted": compacted,
    "document_hashes": document_hashes,
    "frontmatter": frontmatters,
    "markdown_fixture": markdown_fixture,
    "stream_changes": lambda s, d: changes_once(s, f"{d}/file_snapshots.parquet"),
    "missing_chunks_antijoin": missing_chunks,
    "orphan_vectors": orphan_vectors,
    "cascade_delete": lambda s, d: cascade(files_now(s, d), chunks_now(s, d, "file_id")).select("id", "file_id"),
    "exclude_glob": lambda s, d: table(s, d, "disk_listing").select("absolute_path", "rel_path").distinct().where(~T.excluded(F.col("rel_path"), ("q?", "*draft*", "A-*", "*.tmp"))),
    "skipped_dirs": lambda s, d: table(s, d, "disk_listing").select("absolute_path", "rel_path").distinct().where(~T.in_skipped_dir(F.col("rel_path"), ("q1", "misc"))),
    "stats_overview": lambda s, d: stats.overview(*_small(s, d)),
    "files_by_vault": lambda s, d: stats.by_vault(*_small(s, d)[:2]),
    "vault_recent": lambda s, d: stats.recent_files(files_now(s, d)),
    "soft_delete_ratio": lambda s, d: stats.soft_deleted(*_small(s, d)[:2]),
    "purge_counts": lambda s, d: stats.purge_counts(*_small(s, d)),
    "purge_deleted": purged,
    "chunk_index_next": lambda s, d: stats.next_chunk_index(chunks_now(s, d, "chunk_index")),
    "file_chunks": lambda s, d: stats.file_chunks(current_texts(table(s, d, "chunks"), *CHUNK_COLUMNS, where=F.col("file_id") == 1), 1),
    "file_by_path": lambda s, d: stats.file_by_path(files_now(s, d), "/elsewhere/STATION-journal.md").select("id", "absolute_path"),
    "token_estimate": lambda s, d: table(s, d, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens")),
    "query_cleaning": lambda s, d: table(s, d, "lang_samples").select("sample_id", T.clean_query(F.col("sample_text")).alias("cleaned"), T.match_expression(T.clean_query(F.col("sample_text"))).alias("expression")),
    "fts_weighted_text": lambda s, d: index_texts(s, d).select("chunk_id", F.col("content").alias("index_text")),
    "document_context": lambda s, d: stats.document_context(index_of(s, d).chunks),
    "dict_merge": lambda s, d: merge_dictionary(table(s, d, "dictionary")),
    "dict_statistics": lambda s, d: dictionary_statistics(merge_dictionary(table(s, d, "dictionary"))),
    "markdown_chunks": markdown_chunks,
    "embed_chunks": lambda s, d: embed_chunks(index_of(s, d).chunks.where(not_deleted()).select(F.col("id").alias("chunk_id"), "content")),
}

# The current row of an id, as SQL.
_FILES = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM files WHERE id IS NOT NULL) WHERE rn = 1)"
_CHUNKS = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM chunks WHERE id IS NOT NULL) WHERE rn = 1)"
_LIVE_C = "lc AS (SELECT * FROM c WHERE NOT coalesce(is_deleted, false))"
_LIVE_F = "lf AS (SELECT * FROM f WHERE NOT coalesce(is_deleted, false))"
_IX = "ix AS (SELECT * FROM lc WHERE file_id IN (SELECT id FROM lf))"
_USABLE = f"v AS (SELECT DISTINCT chunk_id, embedding FROM vectors WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND chunk_id IN (SELECT id FROM ix))"
_Q = "q AS (SELECT embedding::DOUBLE[] AS e FROM v WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY chunk_id LIMIT 1)"
#: What the rows of the CTE in the place of {} are found by, and its terms.
_TEXTS = r"""m AS (SELECT r.*, parse_filename(lf.file_path) AS n, CASE WHEN json_valid(metadata) THEN metadata END::JSON AS j FROM {} r JOIN lf ON lf.id = r.file_id),
xt AS (SELECT id AS chunk_id, array_to_string(list_filter([n, n, section_path, section_title, section_title,
  array_to_string(list_transform(list_filter(from_json(j->'$.tags', '["VARCHAR"]'), lambda x: trim(x) <> ''), lambda x: '#' || trim(x)), ' '), j->>'$.doc_type', content], lambda x: coalesce(x, '') <> ''), ' ') AS index_text FROM m),
tk AS (SELECT chunk_id, regexp_extract_all(lower(strip_accents(index_text)), '[\p{{L}}\p{{N}}]+') AS t FROM xt)"""
_INDEX = f"{_FILES}, {_CHUNKS}, {_LIVE_F}, {_LIVE_C}, {_IX}"


def _map(rules: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {float(v)}::DOUBLE" for k, v in rules.items()) + "}"


def _phrases(queries: list[str]) -> str:
    rows = []
    for q, text in enumerate(queries):
        found = R.query_phrases(text)
        for n, p in enumerate(dict.fromkeys(map(tuple, found))):
            words = ", ".join(f"'{w}'" for w in p)
            rows.append(f"({q}, {n}, [{words}], {found.count(list(p))})")
    return "p(query_no, phrase_no, words, times) AS (VALUES " + ", ".join(rows) + ")"


def _bm25(queries: list[str]) -> str:
    return rf"""{_phrases(queries)},
tf AS (
  SELECT query_no, phrase_no, times, chunk_id, len(t) AS dl,
         len(list_filter(range(1, len(t) - len(words) + 2), lambda i: t[i:i + len(words) - 1] = words)) AS f
  FROM tk JOIN p ON list_has_all(t, words)
), hit AS (SELECT * FROM tf WHERE f > 0),
df AS (SELECT query_no, phrase_no, count(*) AS df FROM hit GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk),
bm AS (
  SELECT query_no, chunk_id, round(sum(times * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
         * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM hit JOIN df USING (query_no, phrase_no), st GROUP BY ALL
)"""


def _date(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_strptime({x}, '%Y-%m-%d')::DATE END"


def _confidence(source: str, time: tuple[int, int, int] | None = None) -> str:
    """CTEs cj, ck, cf, cw with chunk_id, confidence_score and confidence_reason of the rows of ``source``."""
    day = _date("fd")
    aged = f"coalesce(greatest(0.5::DOUBLE, power(0.5::DOUBLE, date_diff('day', {day}, DATE '{AS_OF}') / coalesce({_map(SHIPPED_HALF_LIVES)}[kind], 365.0::DOUBLE))), 0.5::DOUBLE)"
    if time:
        y, m, n = time
        aged = f"""CASE WHEN {day} IS NULL THEN 1.0 WHEN year({day}) = {y} AND month({day}) = {m} AND day({day}) = {n} THEN 2.0
          WHEN year({day}) = {y} AND month({day}) = {m} THEN 1.8 WHEN year({day}) = {y} THEN 1.5 ELSE greatest(0.2, 1 - 0.3 * abs(year({day}) - {y})) END::DOUBLE"""
    field = lambda name, missing: f"CASE WHEN json_exists(j, '$.{name}') THEN j->>'$.{name}' ELSE {missing} END"
    old = f"'Age:' || coalesce(date_diff('day', {day}, DATE '{AS_OF}'), 365) || 'd'"
    return f"""cj AS (SELECT id AS chunk_id, CASE WHEN json_valid(confidence_json) AND json_type(CASE WHEN json_valid(confidence_json) THEN confidence_json END) = 'OBJECT' THEN confidence_json ELSE '{{}}' END::JSON AS j FROM {source}),
ck AS (SELECT chunk_id, {field('doc_type', "'technical'")} AS kind, {field('status', "'active'")} AS status, nullif({field('final_date', 'NULL')}, '') AS fd FROM cj),
cf AS (SELECT *, coalesce({_map(SHIPPED_TYPES)}[kind], 1.0::DOUBLE) AS tw, coalesce({_map(SHIPPED_STATUSES)}[status], 1.0::DOUBLE) AS sw FROM ck),
cw AS (SELECT chunk_id, ln(1 + tw * sw * CASE WHEN fd IS NULL THEN 1.0 ELSE {aged} END) AS confidence_score,
       'Type:' || coalesce(kind, 'None') || '(' || tw || ') | Status:' || coalesce(status, 'None') || '(' || sw || ') | ' || {f"CASE WHEN fd IS NULL THEN {old} ELSE 'TimeMatch' END" if time else old} AS confidence_reason FROM cf)"""


def _ranked(query: str = QUERY, alpha: float = 0.6, beta: float = 0.4, post: str = "true", pre: str = "true", time: tuple[int, int, int] | None = None, similar: float | None = None) -> str:
    """CTEs up to rk, the results of a search with all their columns."""
    short = "sh"
    distinct = ""
    if similar is not None:
        short = "sd"
        distinct = f"""
so AS (SELECT sh.*, v.embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY final_score DESC, sh.chunk_id) AS pos FROM sh LEFT JOIN v USING (chunk_id)),
near AS (SELECT b.pos AS j, list(a.pos) AS above FROM so a JOIN so b ON a.pos < b.pos AND coalesce(list_inner_product(a.x, b.x) / nullif(sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x)), 0), 0.0) >= {similar} GROUP BY b.pos),
fold(i, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL SELECT fold.i + 1, CASE WHEN list_has_any(coalesce(above, []), kept) THEN kept ELSE list_append(kept, fold.i + 1) END FROM fold LEFT JOIN near ON near.j = fold.i + 1 WHERE fold.i < (SELECT count(*) FROM so)
), sd AS (SELECT * FROM so WHERE list_contains((SELECT kept FROM fold ORDER BY i DESC LIMIT 1), pos)),"""
    return f"""WITH RECURSIVE {_INDEX}, {_USABLE}, {_Q}, pc AS (SELECT * FROM ix WHERE {pre}),
vs AS (SELECT chunk_id, 1 / (1 + list_distance(embedding::DOUBLE[], e)) AS s FROM v, q WHERE chunk_id IN (SELECT id FROM pc) ORDER BY s DESC, chunk_id LIMIT 100),
{_TEXTS.format("pc")}, {_bm25([query])},
ks AS (SELECT chunk_id, score AS k FROM bm ORDER BY score DESC, chunk_id LIMIT 100),
ca AS (SELECT chunk_id, coalesce(s, 0.0) AS semantic_score, coalesce(k, 0.0) AS keyword_score FROM vs FULL JOIN ks USING (chunk_id)),
{_confidence("pc", time)},
sc AS (
  SELECT ca.*, lf.file_path, lf.absolute_path, lf.vault_name, pc.content, pc.content_type AS chunk_type, coalesce(nullif(pc.section_title, ''), 'Root') AS section, confidence_score, confidence_reason,
         ({alpha}::DOUBLE * semantic_score + {beta}::DOUBLE * ln(1 + greatest(0.0, keyword_score))) * confidence_score AS final_score
  FROM ca JOIN pc ON ca.chunk_id = pc.id JOIN lf ON pc.file_id = lf.id JOIN cw ON cw.chunk_id = ca.chunk_id WHERE {post}
), sh AS (SELECT * FROM sc ORDER BY final_score DESC, chunk_id LIMIT 50),{distinct}
be AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY final_score DESC, chunk_id) AS n FROM {short}),
rk AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, chunk_id) AS rank FROM be WHERE n = 1 QUALIFY rank <= 10)"""


def _hybrid(*args, **options) -> str:
    return _ranked(*args, **options) + """
SELECT rank, chunk_id, file_path, vault_name, section, round(semantic_score, 6) AS semantic_score, round(keyword_score, 6) AS keyword_score,
       round(confidence_score, 6) AS confidence_score, round(final_score, 6) AS final_score FROM rk"""


_IN = "(" + ", ".join(f"'{v}'" for v in VAULTS) + ")"
_HASH = r"regexp_replace(lower(file_hash), '[^\p{L}\p{N}]+', '', 'g')"
def _diff(within: str = "true") -> str:
    return rf"""{_FILES},
st AS (SELECT * REPLACE ({_HASH} AS file_hash) FROM f),
ac AS (SELECT * FROM st WHERE NOT coalesce(is_deleted, false) AND {within}),
d AS (SELECT absolute_path, s.* FROM (SELECT absolute_path, max(struct_pack(mtime, file_size, vault_name, rel_path)) AS s FROM disk_listing WHERE absolute_path IS NOT NULL AND {within} GROUP BY absolute_path)),
h AS (SELECT absolute_path, s.h AS new_hash FROM (SELECT absolute_path, max(struct_pack(snapshot_no, updated_at, h := {_HASH})) AS s FROM file_snapshots WHERE file_hash IS NOT NULL GROUP BY absolute_path)),
j AS (
  SELECT ac.id AS old_id, d.absolute_path IS NOT NULL AS seen, d.absolute_path IS NOT NULL AND (ac.id IS NULL OR coalesce(d.mtime <> ac.mtime OR d.file_size IS DISTINCT FROM ac.file_size, true)) AS asks,
         coalesce(d.vault_name, ac.vault_name) AS vault_name, coalesce(d.rel_path, ac.file_path) AS file_path, coalesce(d.absolute_path, ac.absolute_path) AS absolute_path,
         ac.file_hash AS old_hash, coalesce(d.mtime, ac.mtime) AS mtime, coalesce(d.file_size, ac.file_size) AS file_size
  FROM ac FULL JOIN d ON ac.absolute_path = d.absolute_path
), k AS (SELECT j.*, CASE WHEN asks THEN new_hash END AS new_hash FROM j LEFT JOIN h USING (absolute_path)),
mv AS (
  SELECT * FROM (SELECT old_hash AS new_hash, min(old_id) AS source_id FROM k WHERE old_id IS NOT NULL AND NOT seen AND old_hash IS NOT NULL GROUP BY 1)
  JOIN (SELECT new_hash, min(absolute_path) AS absolute_path FROM k WHERE old_id IS NULL AND new_hash IS NOT NULL GROUP BY 1) USING (new_hash)
), df AS (
  SELECT CASE WHEN old_hash = new_hash THEN 'touched' ELSE 'modified' END AS change_type, old_id, vault_name, file_path, absolute_path, new_hash AS file_hash, mtime, file_size FROM k WHERE old_id IS NOT NULL AND asks AND new_hash IS NOT NULL
  UNION ALL SELECT CASE WHEN source_id IS NULL THEN 'new' ELSE 'moved' END, source_id, vault_name, file_path, k.absolute_path, k.new_hash, mtime, file_size FROM k LEFT JOIN mv ON k.new_hash = mv.new_hash AND k.absolute_path = mv.absolute_path WHERE old_id IS NULL AND k.new_hash IS NOT NULL
  UNION ALL SELECT 'deleted', old_id, vault_name, file_path, absolute_path, old_hash, mtime, file_size FROM k WHERE old_id IS NOT NULL AND NOT seen AND old_id NOT IN (SELECT source_id FROM mv)
)"""


_DIFF = _diff()
_TIME = r"([0-9]{4})(?:-([0-9]{1,2})(?:-([0-9]{1,2}))?|年([0-9]{1,2})(?:月([0-9]{1,2})日)?)"
_STRIP = r"[\s\p{Z}]+"

#: CTEs t, the 100 nearest, and fold, which of them are kept.
_KEPT = f"""WITH RECURSIVE {_INDEX}, {_USABLE}, {_Q},
t AS (SELECT chunk_id, embedding::DOUBLE[] AS x, 1 / (1 + list_distance(embedding::DOUBLE[], e)) AS score, row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], e), chunk_id) AS rank FROM v, q QUALIFY rank <= 100),
s AS (SELECT a.rank AS i, b.rank AS j FROM t a JOIN t b ON a.rank < b.rank WHERE coalesce(list_inner_product(a.x, b.x) / nullif(sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x)), 0), 0.0) >= 0.85),
near AS (SELECT j, list(i) AS above FROM s GROUP BY j),
fold(i, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL SELECT fold.i + 1, CASE WHEN list_has_any(coalesce(above, []), kept) THEN kept ELSE list_append(kept, fold.i + 1) END FROM fold LEFT JOIN near ON near.j = fold.i + 1 WHERE fold.i < (SELECT count(*) FROM t)
)"""

SQL = {
    "p1_found": r"""
WITH s AS (
  SELECT snapshot_no, vault_name, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') AS file_path,
         coalesce(is_deleted, false) AS gone, regexp_replace(lower(file_hash), '[^\p{L}\p{N}]+', '', 'g') AS hash, updated_at
  FROM file_snapshots WHERE file_path IS NOT NULL AND snapshot_no IS NOT NULL
), l AS (
  SELECT *, row_number() OVER (PARTITION BY snapshot_no, vault_name, file_path ORDER BY updated_at DESC NULLS LAST, gone DESC, hash DESC NULLS LAST) AS rn FROM s
), p AS (SELECT * FROM l WHERE rn = 1 AND NOT gone),
n AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT snapshot_no FROM file_snapshots WHERE snapshot_no IS NOT NULL)),
c AS (SELECT p.*, n.before FROM p JOIN n USING (snapshot_no) WHERE n.before IS NOT NULL),
o AS (SELECT n.snapshot_no, p.vault_name, p.file_path, p.hash FROM p JOIN n ON p.snapshot_no = n.before)
SELECT coalesce(c.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(c.vault_name, o.vault_name) AS vault_name, coalesce(c.file_path, o.file_path) AS file_path,
       CASE WHEN o.snapshot_no IS NULL THEN 'added' WHEN c.snapshot_no IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM c FULL JOIN o ON c.snapshot_no = o.snapshot_no AND c.vault_name IS NOT DISTINCT FROM o.vault_name AND c.file_path = o.file_path
WHERE o.snapshot_no IS NULL OR c.snapshot_no IS NULL OR c.hash <> o.hash
""",
    "vector_topk": f"WITH {_INDEX}, {_USABLE}, {_Q} SELECT chunk_id, round(1 / (1 + list_distance(embedding::DOUBLE[], e)), 6) AS score FROM v, q ORDER BY 1 / (1 + list_distance(embedding::DOUBLE[], e)) DESC, chunk_id LIMIT 100",
    "bm25_topk": f"WITH {_INDEX}, {_TEXTS.format('ix')}, {_bm25([QUERY])} SELECT row_number() OVER (ORDER BY score DESC, chunk_id) AS rank, chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, chunk_id LIMIT 100",
    "bm25_multi_query": f"WITH {_INDEX}, {_TEXTS.format('ix')}, {_bm25(BATCH)} SELECT query_no, chunk_id, round(score, 6) AS score FROM bm",
    "term_statistics": f"WITH {_INDEX}, {_TEXTS.format('ix')} SELECT chunk_id, len(t) AS dl, len(list_distinct(t)) AS distinct_terms FROM tk",
    "confidence_decay": f"WITH {_CHUNKS}, {_confidence('c')} SELECT chunk_id, round(confidence_score, 6) AS confidence_score, confidence_reason FROM cw",
    "confidence_time_match": f"WITH {_CHUNKS}, {_confidence('c', (2024, 3, 5))} SELECT chunk_id, round(confidence_score, 6) AS confidence_score, confidence_reason FROM cw",
    "time_range_parse": rf"""WITH l AS (SELECT doc_id, text AS x FROM documents)
SELECT doc_id, try_cast(coalesce(nullif(regexp_extract(x, '{_TIME}', 1), ''), nullif(regexp_extract(x, '([0-9]{{4}})年(?:[^0-9]|$)', 1), '')) AS INT) AS year,
       try_cast(coalesce(nullif(regexp_extract(x, '{_TIME}', 2), ''), nullif(regexp_extract(x, '{_TIME}', 4), '')) AS INT) AS month,
       try_cast(coalesce(nullif(regexp_extract(x, '{_TIME}', 3), ''), nullif(regexp_extract(x, '{_TIME}', 5), '')) AS INT) AS day FROM l""",
    "hybrid_search": _hybrid(),
    "hybrid_timed": _hybrid(TIMED, time=(2024, 3, 5)),
    "hybrid_keyword_mode": _hybrid(alpha=0.0, beta=1.0),
    "hybrid_semantic_mode": _hybrid(alpha=1.0, beta=0.0),
    "hybrid_vault_postfilter": _hybrid(post=f"lf.vault_name IN {_IN}"),
    "hybrid_vault_prefilter": _hybrid(post=f"lf.vault_name IN {_IN}", pre=f"file_id IN (SELECT id FROM f WHERE vault_name IN {_IN})"),
    "cosine_matrix": f"""WITH {_INDEX}, {_USABLE}, {_Q},
t AS (SELECT chunk_id, embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], e), chunk_id) AS rank FROM v, q QUALIFY rank <= 100)
SELECT a.rank AS i, b.rank AS j, round(coalesce(list_inner_product(a.x, b.x) / nullif(sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x)), 0), 0.0), 5) AS similarity FROM t a CROSS JOIN t b""",
    "semantic_dedup": _KEPT + " SELECT rank, chunk_id FROM t WHERE list_contains((SELECT kept FROM fold ORDER BY i DESC LIMIT 1), rank)",
    "dedup_with_scores": _KEPT + " SELECT rank, chunk_id, round(score, 6) AS score FROM t WHERE list_contains((SELECT kept FROM fold ORDER BY i DESC LIMIT 1), rank)",
    "cosine_to_query": f"""WITH {_INDEX}, {_USABLE}, {_Q}, w AS (SELECT chunk_id, embedding::DOUBLE[] AS x, e FROM v, q)
SELECT chunk_id, round(coalesce(list_inner_product(x, e) / nullif(sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(e, e)), 0), 0.0), 5) AS similarity FROM w""",
    "search_by_filename": _hybrid(NAMED, 0.0, 1.0),
    "search_by_tag": _hybrid(TAGGED, 0.0, 1.0),
    "search_blank": _hybrid() + " WHERE false",
    "search_distinct": _hybrid(similar=0.85),
    "search_response": _ranked() + " SELECT rank, file_path AS file, absolute_path AS abs_path, substring(content, 1, 300) AS content, round(final_score, 4) AS score, round(confidence_score, 4) AS confidence, confidence_reason FROM rk",
    "search_csv": _ranked() + r""" SELECT rank, file_path, absolute_path, section, vault_name, chunk_type, regexp_replace(substring(content, 1, 200), '[\r\n]+', ' ', 'g') AS content,
       round(final_score, 6) AS final_score, round(confidence_score, 6) AS confidence_score, confidence_reason FROM rk""",
    "search_context": _ranked() + " SELECT coalesce(string_agg('【文档 ' || rank || '】' || file_path || chr(10) || '内容: ' || coalesce(substring(content, 1, 300), ''), chr(10) ORDER BY rank), '无结果') AS context FROM rk",
    "index_build": f"""WITH {_INDEX}, {_USABLE}, {_TEXTS.format('ix')} SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM c) AS chunks, (SELECT count(DISTINCT chunk_id) FROM v) AS vectors,
       (SELECT count(*) FROM tk) AS texts, (SELECT coalesce(sum(len(t)), 0)::BIGINT FROM tk) AS terms""",
    "scan_diff_two_vaults": f"WITH {_diff(f'vault_name IN {_IN}')} SELECT * FROM df",
    "chunks_after_scan": f"""WITH {_DIFF}, {_CHUNKS}, hit AS (SELECT old_id FROM df WHERE change_type IN ('modified', 'deleted'))
SELECT id, file_id, CASE WHEN file_id IN (FROM hit) THEN true ELSE is_deleted END AS is_deleted, CASE WHEN file_id IN (FROM hit) THEN {AS_OF_SECONDS} ELSE updated_at END AS updated_at FROM c""",
    "vectors_after_scan": f"""WITH {_DIFF}, {_CHUNKS}, hit AS (SELECT old_id FROM df WHERE change_type IN ('modified', 'deleted'))
SELECT DISTINCT chunk_id FROM vectors WHERE chunk_id IN (SELECT id FROM c WHERE NOT coalesce(is_deleted, false) AND coalesce(file_id NOT IN (FROM hit), true))""",
    "upsert_files": f"""WITH {_DIFF}, n AS (SELECT vault_name, file_path, s.* FROM (SELECT l.vault_name, rel_path AS file_path, max(struct_pack(mtime, h := h.new_hash, file_size, absolute_path := l.absolute_path)) AS s FROM disk_listing l LEFT JOIN h USING (absolute_path) GROUP BY ALL))
SELECT f.id AS known_id, coalesce(f.vault_name, n.vault_name) AS vault_name, coalesce(f.file_path, n.file_path) AS file_path, CASE WHEN n.file_path IS NULL THEN f.absolute_path ELSE n.absolute_path END AS absolute_path,
  CASE WHEN n.file_path IS NULL THEN f.file_hash ELSE n.h END AS file_hash, CASE WHEN n.file_path IS NULL THEN f.file_size ELSE n.file_size END AS file_size, CASE WHEN n.file_path IS NULL THEN f.mtime ELSE n.mtime END AS mtime,
  CASE WHEN n.file_path IS NULL THEN f.is_deleted ELSE false END AS is_deleted, CASE WHEN n.file_path IS NULL THEN f.updated_at ELSE {AS_OF_SECONDS} END AS updated_at
FROM f FULL JOIN n ON f.vault_name = n.vault_name AND f.file_path = n.file_path""",
    "file_by_hash": f"WITH {_FILES}, {_LIVE_F} SELECT id, vault_name, file_path FROM lf WHERE file_hash = (SELECT file_hash FROM lf WHERE file_hash IS NOT NULL ORDER BY id LIMIT 1) ORDER BY id LIMIT 1",
    "vault_files": r"""WITH w AS (SELECT doc_id, doc_id % 10 AS k, text FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN k = 2 THEN 'a/.hidden/_' ELSE 'c' || k || '/' END || doc_id || '.md' AS rel_path, octet_length(encode(text))::BIGINT AS file_size, sha256(text) AS file_hash, length(regexp_replace(text, '\r\n?', chr(10), 'g')) AS length
FROM w WHERE k NOT IN (1, 3, 4)""",
    "compacted": f"WITH {_FILES} SELECT id, file_path, updated_at FROM f",
    "document_hashes": "SELECT doc_id, sha256(text) AS hash, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d') AS day FROM documents",
    "frontmatter": r"""WITH x AS (SELECT doc_id, mtime, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
y AS (SELECT *, CASE WHEN regexp_matches(t, '^---[\s\p{Z}]*\n') THEN regexp_extract(t, '^(---[\s\p{Z}]*\n(?s:.*?)\n---[\s\p{Z}]*\n)', 1) ELSE '' END AS h FROM x),
z AS (SELECT *, regexp_extract(h, '(?m)^doc_type:[\t\p{Z}]*(.*?)[\t\p{Z}]*$', 1) AS k, regexp_extract(h, '(?m)^status:[\t\p{Z}]*(.*?)[\t\p{Z}]*$', 1) AS s, regexp_extract(h, '(?m)^date:[\t\p{Z}]*(.*?)[\t\p{Z}]*$', 1) AS dd FROM y)
SELECT doc_id, CASE WHEN k = '' THEN 'blog' ELSE k END AS doc_type, CASE WHEN s = '' THEN '已完成' ELSE s END AS status,
       CASE WHEN dd <> '' THEN dd ELSE strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d') END AS final_date, length(t) - length(h) AS body_length FROM z""",
    "markdown_fixture": "SELECT sample_id::BIGINT AS file_id, x.* FROM lang_samples, (VALUES " + ", ".join(f"({k}, '{kind}', '{path}', {a}, {b}, '{text}', '2024-03-05')".replace("\n", "' || chr(10) || '") for k, (kind, path, a, b, text) in enumerate(FIXTURE_CHUNKS)) + ") x(chunk_index, content_type, section_path, start_pos, end_pos, content, final_date)",
    "scan_diff": f"WITH {_DIFF} SELECT * FROM df",
    "scan_summary": f"WITH {_DIFF} SELECT " + ", ".join(f"count(*) FILTER (change_type = '{k}') AS {k}" for k in scan.KINDS) + " FROM df",
    "apply_scan": f"""WITH {_DIFF},
dead AS (SELECT absolute_path, min(id) AS dead_id FROM st WHERE is_deleted GROUP BY 1),
ch AS (SELECT df.*, CASE WHEN change_type = 'new' THEN dead_id ELSE old_id END AS id FROM df LEFT JOIN dead USING (absolute_path))
SELECT coalesce(st.id, ch.id) AS known_id,
  CASE WHEN change_type IN ('new', 'moved') THEN ch.vault_name ELSE st.vault_name END AS vault_name, CASE WHEN change_type IN ('new', 'moved') THEN ch.file_path ELSE st.file_path END AS file_path,
  CASE WHEN change_type IN ('new', 'modified') THEN ch.file_hash ELSE st.file_hash END AS file_hash,
  CASE WHEN change_type IN ('new', 'moved', 'modified', 'touched') THEN ch.file_size ELSE st.file_size END AS file_size,
  CASE WHEN change_type IN ('new', 'moved', 'modified', 'touched') THEN ch.mtime ELSE st.mtime END AS mtime,
  CASE WHEN change_type = 'deleted' THEN true WHEN change_type = 'new' THEN false ELSE st.is_deleted END AS is_deleted,
  CASE WHEN change_type IN ('new', 'moved', 'modified', 'deleted') THEN {AS_OF_SECONDS} ELSE st.updated_at END AS updated_at
FROM st FULL JOIN ch ON st.id = ch.id""",
    "missing_chunks_antijoin": f"WITH {_FILES}, {_CHUNKS}, {_LIVE_C}, {_LIVE_F} SELECT id, vault_name, file_path FROM lf WHERE NOT EXISTS (SELECT 1 FROM lc WHERE lc.file_id = lf.id)",
    "orphan_vectors": f"WITH {_CHUNKS}, {_LIVE_C} SELECT DISTINCT chunk_id FROM vectors WHERE NOT EXISTS (SELECT 1 FROM lc WHERE lc.id = chunk_id)",
    "cascade_delete": f"WITH {_FILES}, {_CHUNKS} SELECT c.id, c.file_id FROM c WHERE c.file_id IN (SELECT id FROM f)",
    "exclude_glob": "SELECT DISTINCT absolute_path, rel_path FROM disk_listing WHERE NOT (len(list_filter(list_append(string_split(rel_path, '/'), rel_path), lambda x: x SIMILAR TO 'q.' OR x LIKE '%draft%' OR x LIKE 'A-%' OR x LIKE '%.tmp')) > 0)",
    "skipped_dirs": "SELECT DISTINCT absolute_path, rel_path FROM disk_listing WHERE NOT list_has_any(string_split(rel_path, '/')[:-2], ['q1', 'misc'])",
    "stats_overview": f"""WITH {_FILES}, {_CHUNKS}, x AS (SELECT count(*) FILTER (NOT coalesce(is_deleted, false)) AS active_files, count(*) FILTER (coalesce(is_deleted, false)) AS deleted_files FROM f),
y AS (SELECT count(*) FILTER (NOT coalesce(is_deleted, false)) AS active_chunks, count(*) FILTER (coalesce(is_deleted, false)) AS deleted_chunks FROM c),
z AS (SELECT count(DISTINCT chunk_id) AS vectors FROM vectors WHERE embedding IS NOT NULL)
SELECT *, round(active_chunks / greatest(active_files, 1), 1) AS chunks_per_file FROM x, y, z""",
    "files_by_vault": f"WITH {_FILES}, {_CHUNKS}, {_LIVE_C}, {_LIVE_F} SELECT vault_name, count(DISTINCT lf.id) AS files, count(lc.id) AS chunks FROM lf LEFT JOIN lc ON lc.file_id = lf.id GROUP BY vault_name",
    "vault_recent": f"WITH {_FILES}, {_LIVE_F} SELECT vault_name, file_path, updated_at, id FROM lf ORDER BY updated_at DESC, id LIMIT 5",
    "soft_delete_ratio": f"""WITH {_FILES}, {_CHUNKS}, x AS (SELECT coalesce(count(*) FILTER (coalesce(is_deleted, false)) * 100.0::DOUBLE / nullif(count(*), 0), 0) AS file_ratio FROM f),
y AS (SELECT coalesce(count(*) FILTER (coalesce(is_deleted, false)) * 100.0::DOUBLE / nullif(count(*), 0), 0) AS chunk_ratio FROM c)
SELECT file_ratio, chunk_ratio, greatest(file_ratio, chunk_ratio) AS max_ratio, greatest(file_ratio, chunk_ratio) > 20 AS needed FROM x, y""",
    "purge_counts": f"WITH {_FILES}, {_CHUNKS} SELECT (SELECT count(*) FROM f WHERE is_deleted) AS files, (SELECT count(*) FROM c WHERE is_deleted) AS chunks, (SELECT count(DISTINCT chunk_id) FROM vectors WHERE chunk_id IN (SELECT id FROM c WHERE is_deleted)) AS vectors",
    "purge_deleted": f"""WITH {_FILES}, {_CHUNKS}, {_LIVE_C}, {_LIVE_F}, k AS (SELECT id FROM lc WHERE file_id IN (SELECT id FROM lf))
SELECT 'file' AS kind, id FROM lf UNION ALL SELECT 'chunk', id FROM k UNION ALL SELECT 'vector', chunk_id FROM (SELECT DISTINCT chunk_id FROM vectors WHERE chunk_id IN (SELECT id FROM k))""",
    "chunk_index_next": f"WITH {_CHUNKS} SELECT coalesce(max(chunk_index), -1)::BIGINT + 1 AS next_index FROM c",
    "file_chunks": f"WITH {_CHUNKS}, {_LIVE_C} SELECT id, chunk_index, content, content_type, section_title, section_path, start_pos, end_pos FROM lc WHERE file_id = 1",
    "file_by_path": f"WITH {_FILES} SELECT id, absolute_path FROM f WHERE absolute_path = '/elsewhere/STATION-journal.md' OR lower(absolute_path) LIKE '%station-journal.md' ORDER BY absolute_path <> '/elsewhere/STATION-journal.md', id LIMIT 1",
    "token_estimate": r"SELECT doc_id, floor(length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]+', '', 'g')) / 1.5::DOUBLE + (length(text) - length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]+', '', 'g'))) / 4.0::DOUBLE)::BIGINT AS tokens FROM documents",
    "query_cleaning": r"""WITH x AS (SELECT sample_id, trim(regexp_replace(regexp_replace(sample_text, '[^\p{L}\p{N}_\s\x{4e00}-\x{9fa5}\-]', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM lang_samples)
SELECT sample_id, cleaned, array_to_string(list_transform(list_filter(string_split(cleaned, ' '), lambda w: w <> ''), lambda w: '"' || w || '"'), ' OR ') AS expression FROM x""",
    "fts_weighted_text": f"WITH {_INDEX}, {_TEXTS.format('ix')} SELECT chunk_id, index_text FROM xt",
    "document_context": f"""WITH {_CHUNKS}, {_LIVE_C} SELECT file_id, substring(string_agg('### ' || coalesce(nullif(section_title, ''), '正文') || chr(10) || coalesce(content, ''), chr(10) ORDER BY chunk_index, id), 1, 8000) AS context FROM lc WHERE file_id IS NOT NULL GROUP BY file_id""",
    "dict_merge": rf"""WITH w AS (SELECT regexp_replace(word, '^{_STRIP}|{_STRIP}$', '', 'g') AS word, coalesce(freq, 100) AS freq, source FROM dictionary WHERE word IS NOT NULL)
SELECT word, max(freq) AS freq, arg_min(source, (-freq, source)) AS source FROM w WHERE word <> '' AND NOT starts_with(word, '#') GROUP BY word""",
    "dict_statistics": rf"""WITH w AS (SELECT regexp_replace(word, '^{_STRIP}|{_STRIP}$', '', 'g') AS word, coalesce(freq, 100) AS freq FROM dictionary WHERE word IS NOT NULL),
m AS (SELECT word, max(freq) AS freq FROM w WHERE word <> '' AND NOT starts_with(word, '#') GROUP BY word)
SELECT count(*) AS words, count(*) FILTER (freq >= 1000) AS freq_1000, count(*) FILTER (freq >= 500) AS freq_500, count(*) FILTER (freq >= 100) AS freq_100 FROM m""",
}
SQL["stream_changes"] = SQL["p1_found"]
