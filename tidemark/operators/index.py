"""The stored index of chunks as plain tables: what they are found by, postings of its terms, and vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.segment import segment_texts
from tidemark.functions.text import index_text, terms
from tidemark.functions.vectors import usable
from tidemark.session import materialise
from tidemark.sources.tables import not_deleted

#: Chunks for which a bucket of terms is made, and for which its files are split once more.
BUCKET_CHUNKS, SALT_CHUNKS = 25_000, 1_000_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 4_096
#: How many ids of a list a scan checks against its pages: those of the largest search.
IN_LIST, IDS_TOLD = "spark.sql.parquet.pushdown.inFilterThreshold", 20_000


@dataclass(frozen=True)
class TextIndex:
    """``postings``: (bucket, term, chunk_id, dl, position) of every term of every text, stored in folders by bucket in order of
    the term; ``lengths``: (chunk_id, file_id, dl) of every text, empty ones too; ``totals``: one row (n, total, buckets)."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame

    def of(self, wanted: Iterable[str]) -> DataFrame:
        """The postings of some terms: only their buckets' folders are read, and there only the pages that hold them."""
        asked = sorted(set(wanted))
        head = self.totals.head()
        if not asked or head is None:
            return self.postings.where(F.lit(False))
        return self.postings.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % head.buckets for t in asked})) & F.col("term").isin(asked))


@dataclass(frozen=True)
class Index:
    """Everything a search reads. ``vectors`` has one row an id, of live chunks; ``chunks`` may hold flagged ones."""

    files: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    text: TextIndex


def of_ids(rows: DataFrame, column: str, ids: Sequence[int]) -> DataFrame:
    """The rows of a few ids, read from the pages that may hold them.

    The scan is told all ids: of a list longer than a setting of the session it would only know the least and the
    greatest, so the setting is raised to IDS_TOLD where it is lower.
    """
    conf = rows.sparkSession.conf
    if int(conf.get(IN_LIST)) < IDS_TOLD:
        conf.set(IN_LIST, str(IDS_TOLD))
    return rows.where(F.col(column).isin(list(ids)))


def weighted_texts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_id, content) of the live chunks of live files; content is what the chunk is found by.

    That is its file's name, its headings, and the tags and type of its metadata before its own content; broken JSON
    has no tags. Both tables have one row an id.
    """
    live = chunks.where(not_deleted()).select("id", "file_id", "content", "section_title", "section_path", "metadata")
    names = files.where(not_deleted()).select(F.col("id").alias("file_id"), "file_path")
    good = F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata"))
    raw = F.get_json_object(good, "$.tags")
    tags = F.coalesce(F.from_json(raw, "array<string>"), F.when(~raw.startswith("["), F.array(raw)))  # one tag may stand alone
    text = index_text(F.col("file_path"), F.col("section_path"), F.col("section_title"), tags, F.get_json_object(good, "$.doc_type"), F.col("content"))
    return live.join(names, "file_id").select(F.col("id").alias("chunk_id"), "file_id", text.alias("content"))


def tokenised(texts: DataFrame) -> DataFrame:
    """``texts`` with the terms of ``content`` in its place; a null content has none."""
    found = F.coalesce(terms(F.col("content")), F.array().cast("array<string>"))
    return texts.select(*(c for c in texts.columns if c not in ("content", "terms")), found.alias("terms"))


def text_tables(texts: DataFrame, words: Mapping[str, int] | None = None, mode: str = "precise", buckets: int | None = None) -> dict[str, DataFrame]:
    """The tables of a :class:`TextIndex` of (chunk_id, file_id, content), segmented first if there are ``words``.

    ``buckets``: those of a stored index that these texts are to join; else as many as their number calls for.

    Texts are read and cut into terms once. Postings are the one shuffle: by bucket and, within large ones, by a salt
    of the chunk, so a term that most texts hold is spread over many files.
    """
    tokens = materialise(tokenised(segment_texts(texts, words, mode)), "terms")
    n = tokens.count()
    buckets = buckets or min(max(n // BUCKET_CHUNKS, LEAST_BUCKETS), MOST_BUCKETS)
    salts = n // SALT_CHUNKS + 1
    spots = tokens.select("chunk_id", F.size("terms").alias("dl"), F.posexplode("terms").alias("position", "term"))
    placed = spots.select(F.pmod(F.crc32("term"), F.lit(buckets)).cast("int").alias("bucket"), "term", "chunk_id", "dl", "position")
    postings = placed.repartition(buckets * salts, "bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)))
    lengths = tokens.select("chunk_id", "file_id", F.size("terms").alias("dl"))
    return {"postings": postings, "lengths": lengths, "totals": totals_of(lengths, buckets)}


def totals_of(lengths: DataFrame, buckets: int) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.lit(buckets).alias("buckets"))


def text_index(texts: DataFrame, words: Mapping[str, int] | None = None, mode: str = "precise") -> TextIndex:
    """An index that is not stored, for a few texts: (chunk_id, content) and, if there is one, file_id."""
    given = texts if "file_id" in texts.columns else texts.withColumn("file_id", F.lit(None).cast("long"))
    return TextIndex(**text_tables(given.select("chunk_id", "file_id", "content"), words, mode))


def one_vector(vectors: DataFrame, width: int) -> DataFrame:
    """(chunk_id, embedding): the usable vector of each chunk; the smallest, should a chunk have several."""
    rows = vectors.where(F.col("chunk_id").isNotNull() & usable(F.col("embedding"), width))
    return rows.groupBy("chunk_id").agg(F.min("embedding").alias("embedding"))
