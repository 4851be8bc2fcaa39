"""Copies hidden by formatting: equal when folded, or the same fields in another order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.snapshots import folded
from tidemark.session import materialise, spread
from tidemark.sources.tables import current, not_deleted

#: At most so many keys are hot: each holds more than this share of the rows, so their number is proven.
HOT_KEYS = 1_000
#: A key with fewer rows than this is never hot.
HOT_ROWS = 10_000
SALTS = 64
BUCKETS = 1 << 16


def canonical_text(content: Column) -> Column:
    """What two copies have in common; null where nothing but formatting is there.

    A text of two or more fields (a name and a value with exactly one ``:`` or ``=`` between them; fields divided
    by line breaks, ``;`` or ``|``; blank ones don't count) becomes its sorted folded fields, any other text its
    letters and digits in lower case. A text with a field whose name or value folds to nothing is no text of fields.
    """
    field = r"[^:=\r\n;|]*+[:=][^:=\r\n;|]*+"
    blank = r"[\s\p{Z};|]*+"
    shaped = content.rlike(rf"^{blank}{field}(?:[\r\n;|]{blank}{field})++{blank}\z")
    parts = F.filter(F.split(content, r"[\r\n;|]+"), lambda x: x.contains(":") | x.contains("="))
    name = lambda x: folded(F.regexp_extract(x, r"^([^:=]*)", 1))
    value = lambda x: folded(F.regexp_extract(x, r"[:=]([^:=]*)$", 1))
    whole = F.forall(parts, lambda x: (name(x) != "") & (value(x) != ""))
    fields = F.transform(parts, lambda x: F.concat(name(x), F.lit("="), value(x)))
    plain = folded(content)
    # a folded text holds no "=", so fields never equal a plain text
    return F.when(plain == "", F.lit(None)).when(shaped & whole, F.array_join(F.array_sort(fields), "\n")).otherwise(plain)


def with_keys(rows: DataFrame, canonical: Column) -> DataFrame:
    """``rows`` with (k1, k2), 128 bits that stand for the canonical text; null for null. A column of its own lets it be made once a row."""
    known = F.col("_canonical").isNotNull()
    k1, k2 = F.xxhash64("_canonical"), F.xxhash64(F.lit("second"), F.col("_canonical"))
    return rows.withColumn("_canonical", canonical).select(*rows.columns, F.when(known, k1).alias("k1"), F.when(known, k2).alias("k2"))


def live_keys(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, id, k1, k2) of every live file with a hash and live chunk with content. Only hashes are shuffled."""
    gone = (~not_deleted()).alias("gone")
    file_keys = current(with_keys(files.select("id", "updated_at", gone, "file_hash"), F.nullif(folded(F.col("file_hash")), F.lit(""))), "gone", "k1", "k2")
    texts = spread(chunks.select("id", "updated_at", "is_deleted", "content")).select("id", "updated_at", gone, "content")
    chunk_keys = current(with_keys(texts, canonical_text(F.col("content"))), "gone", "k1", "k2")
    both = file_keys.withColumn("kind", F.lit("file")).unionByName(chunk_keys.withColumn("kind", F.lit("chunk")))
    return both.where(~F.col("gone") & F.col("k1").isNotNull()).select("kind", "id", "k1", "k2")


def _hot_keys(keys: DataFrame, hot: int) -> DataFrame:
    """Keys with more than ``hot`` rows, counted exactly.

    Rows are first counted by a coarse bucket of the key, which shrinks to at most BUCKETS partial counts a task;
    only rows of buckets that are large enough to hide a hot key are then counted by key.
    """
    bucket = F.pmod("k1", F.lit(BUCKETS)).alias("bucket")
    large = keys.groupBy(bucket).count().where(F.col("count") > hot).select("bucket")
    rows = keys.withColumn("bucket", bucket).join(F.broadcast(large), "bucket", "left_semi")  # at most BUCKETS rows
    return rows.groupBy("kind", "k1", "k2").count().where(F.col("count") > hot).select("kind", "k1", "k2")


def copies(keys: DataFrame, hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Each row with the smallest id of its group: (kind, id, keep_id, n_copies).

    ``keys`` has one row of each (kind, id) with the 128-bit key (k1, k2). Hot keys, those of more than
    max(hot_rows, rows / hot_keys) rows, are found exactly; there are at most ``hot_keys`` of them, so they are
    broadcast and their groups reduced by two-level aggregation over salts; their rows are never shuffled.
    All other rows take one shuffle by key, into groups of a bounded size. An empty table gives no rows.
    """
    keys = materialise(keys, "copy-keys")
    hot = max(hot_rows, keys.count() // hot_keys)
    hot_set = materialise(_hot_keys(keys, hot), "copy-hot")
    by = ["kind", "k1", "k2"]
    hot_rows_df = keys.join(F.broadcast(hot_set), by, "left_semi")
    partial = hot_rows_df.groupBy(*by, F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    kept = partial.groupBy(*by).agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n_copies"))
    heavy = keys.join(F.broadcast(kept), by).select("kind", "id", "keep_id", "n_copies")
    cold = keys.join(F.broadcast(hot_set), by, "left_anti")
    group = Window.partitionBy(*by)
    light = cold.select("kind", "id", F.min("id").over(group).alias("keep_id"), F.count("*").over(group).alias("n_copies"))
    return heavy.unionByName(light)


def duplicate_copies(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of each live file or chunk that is a copy of one with a smaller id: (kind, keep_id, copy_id)."""
    return copies(live_keys(files, chunks)).where(F.col("id") != F.col("keep_id")).select("kind", "keep_id", F.col("id").alias("copy_id"))


def collapsed(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One record of each group of live files or chunks, single ones included: (kind, keep_id, n_copies)."""
    return copies(live_keys(files, chunks)).where(F.col("id") == F.col("keep_id")).select("kind", "keep_id", "n_copies")
