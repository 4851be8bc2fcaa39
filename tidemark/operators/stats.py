"""Statistics and upkeep of the stored tables; all take one row an id."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what a chunk without a title is headed by in a reassembled document.
UNTITLED = "正文"
#: Characters of a chunk in a reassembled document at least: the mark, a title and a line feed.
LEAST_PART = 6
SALTS = 32


def _live():
    return ~F.coalesce(F.col("is_deleted"), F.lit(False))


def beside(one: DataFrame, *others: DataFrame) -> DataFrame:
    """A single row with the columns of other single rows, as scalar subqueries."""
    return one.select("*", *(o.select(c).scalar().alias(c) for o in others for c in o.columns))


def overview(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: active and deleted files and chunks, vectors, active chunks per active file to one digit."""
    count = lambda df, a, b: df.agg(F.count_if(_live()).alias(a), F.count_if(~_live()).alias(b))
    f, c = count(files, "active_files", "deleted_files"), count(chunks, "active_chunks", "deleted_chunks")
    v = vectors.where(F.col("embedding").isNotNull()).select("chunk_id").distinct().agg(F.count("*").alias("vectors"))
    one = beside(f, c, v)
    return one.select("*", F.round(F.col("active_chunks") / F.greatest(F.col("active_files"), F.lit(1)), 1).alias("chunks_per_file"))


def by_vault(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(vault_name, files, chunks): active ones of each vault that has active files."""
    per_file = chunks.where(_live()).groupBy("file_id").agg(F.count("*").alias("n"))
    rows = files.where(_live()).join(per_file, F.col("id") == F.col("file_id"), "left")
    return rows.groupBy("vault_name").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def recent_files(files: DataFrame, n: int = 5, columns: Sequence[str] = ("vault_name", "file_path", "updated_at", "id")) -> DataFrame:
    """The files last updated."""
    return files.where(_live()).orderBy(F.desc("updated_at"), "id").limit(n).select(*columns)


def soft_deleted(files: DataFrame, chunks: DataFrame, threshold: float = 20.0) -> DataFrame:
    """One row: deleted shares of files and chunks in percent, the larger one, and whether it is above the threshold."""
    share = lambda df, name: df.agg(F.coalesce(F.try_divide(F.count_if(~_live()) * F.lit(100.0), F.count("*")), F.lit(0.0)).alias(name))
    one = beside(share(files, "file_ratio"), share(chunks, "chunk_ratio"))
    most = F.greatest("file_ratio", "chunk_ratio")
    return one.select("file_ratio", "chunk_ratio", most.alias("max_ratio"), (most > threshold).alias("needed"))


def purge(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without deleted rows: chunks of purged files and vectors of purged chunks go, too."""
    kept_files = files.where(_live())
    kept_chunks = chunks.where(_live()).join(kept_files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return kept_files, kept_chunks, vectors.join(kept_chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")


def purge_counts(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row, what a purge would remove: flagged files and chunks, vectors of flagged chunks."""
    f = files.agg(F.count_if(~_live()).alias("files"))
    c = chunks.agg(F.count_if(~_live()).alias("chunks"))
    flagged = chunks.where(~_live()).select(F.col("id").alias("chunk_id"))
    v = vectors.select("chunk_id").distinct().join(flagged, "chunk_id", "left_semi").agg(F.count("*").alias("vectors"))
    return beside(f, c, v)


def next_chunk_index(chunks: DataFrame) -> DataFrame:
    """One row: one more than the greatest chunk_index, 0 for an empty table."""
    return chunks.agg((F.coalesce(F.max("chunk_index"), F.lit(-1)) + 1).cast("long").alias("next_index"))


def file_chunks(chunks: DataFrame, file_id: int) -> DataFrame:
    """Active chunks of a file in order."""
    cols = ("id", "chunk_index", "content", "content_type", "section_title", "section_path", "start_pos", "end_pos")
    return chunks.where(_live() & (F.col("file_id") == file_id)).select(*cols).orderBy("chunk_index", "id")


def chunk_page(chunks: DataFrame, file_id: int, size: int, after: tuple[int, int] | None = None) -> DataFrame:
    """The next ``size`` active chunks of a file in order, after the one of that chunk_index and id."""
    rows = chunks if after is None else chunks.where((F.col("chunk_index") > after[0]) | ((F.col("chunk_index") == after[0]) & (F.col("id") > after[1])))
    return file_chunks(rows, file_id).limit(size)


def file_by_hash(files: DataFrame, file_hash: str, include_deleted: bool = False, vault: str | None = None) -> DataFrame:
    """The file of a hash with the smallest id."""
    rows = files.where(F.col("file_hash") == file_hash)
    rows = rows if include_deleted else rows.where(_live())
    rows = rows if vault is None else rows.where(F.col("vault_name") == vault)
    return rows.orderBy("id").limit(1)


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    """The file of an absolute path, else one whose path ends in its base name whatever the letter case; the smallest id."""
    name = path.rsplit("/", 1)[-1].lower()
    exact = F.when(F.col("absolute_path") == path, 0).when(F.lower("absolute_path").endswith(name), 1)
    return files.withColumn("_place", exact).where(F.col("_place").isNotNull()).orderBy("_place", "id").limit(1).drop("_place")


def document_context(chunks: DataFrame, length: int = 8000) -> DataFrame:
    """(file_id, context): each file's active chunks in order as ``### title`` and content, cut to ``length`` characters.

    A part has at least LEAST_PART characters and a line feed, so the first few chunks of a file reach the cut. They are
    found on ids and lengths alone, first within salts of each file, so that no task sorts all chunks of a large one;
    only their texts are gathered.
    """
    title = F.coalesce(F.nullif(F.col("section_title"), F.lit("")), F.lit(UNTITLED))
    part = F.concat(F.lit("### "), title, F.lit("\n"), F.coalesce("content", F.lit("")))
    rows = chunks.where(_live() & F.col("file_id").isNotNull())
    enough = length // (LEAST_PART + 1) + 2
    small = rows.select("file_id", "chunk_index", "id", F.char_length(part).alias("n"))
    for by in ([F.col("file_id"), F.pmod(F.xxhash64("id"), F.lit(SALTS))], [F.col("file_id")]):
        small = small.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("chunk_index", "id"))).where(F.col("_at") <= enough).drop("_at")
    before = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("file_id").orderBy("chunk_index", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = small.withColumn("_before", before).where(F.col("_before") <= length).select("id")
    texts = rows.select("file_id", "chunk_index", "id", part.alias("part")).join(near, "id", "left_semi")
    gathered = texts.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "part"))).alias("parts"))
    return gathered.select("file_id", F.substring(F.array_join(F.transform("parts", lambda x: x["part"]), "\n"), 1, length).alias("context"))


def search_context(results: DataFrame) -> DataFrame:
    """One row: the results as numbered blocks of path and first 300 characters, or 无结果."""
    block = F.concat(F.lit("【文档 "), F.col("rank").cast("string"), F.lit("】"), F.col("file_path"), F.lit("\n内容: "), F.substring("content", 1, 300))
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.agg(F.coalesce(F.nullif(F.array_join(F.transform(parts, lambda x: x["block"]), "\n"), F.lit("")), F.lit("无结果")).alias("context"))


def load_template(path: str | None, default: str) -> str:
    """The text of a template file; ``default`` if there is none or it can't be read."""
    try:
        return Path(path).read_text(encoding="utf-8") if path else default
    except (OSError, UnicodeDecodeError):
        return default


def render(template: str, values: dict[str, str]) -> str:
    """A template with each ``{{key}}`` replaced, in the order of ``values``."""
    for key, value in values.items():
        template = template.replace("{{" + key + "}}", str(value))
    return template
