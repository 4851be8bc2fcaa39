"""What a walk of the disk found against what is stored, and the stored tables after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("new", "modified", "moved", "deleted", "touched")


def _needs_hash() -> Column:
    changed = (F.col("d.mtime") != F.col("f.mtime")) | ~F.col("d.file_size").eqNullSafe(F.col("f.file_size"))
    return F.col("f.id").isNull() | F.coalesce(changed, F.lit(True))


def new_id() -> Column:
    """An id made from vault and path; from 2**62 on, where no counted id is."""
    return F.xxhash64("vault_name", "file_path").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))


def _joined(files: DataFrame, disk: DataFrame) -> DataFrame:
    seen = disk.where(F.col("absolute_path").isNotNull()).groupBy("absolute_path").agg(F.max(F.struct("mtime", "file_size", "vault_name", "rel_path")).alias("s"))
    seen = seen.select("absolute_path", "s.vault_name", "s.rel_path", "s.mtime", "s.file_size").withColumn("on_disk", F.lit(True))
    return files.alias("f").join(seen.alias("d"), F.col("f.absolute_path") == F.col("d.absolute_path"), "full")


def active_files(files: DataFrame, vaults: Sequence[str]) -> DataFrame:
    """Stored files that a scan of these vaults is compared with: files of other vaults were not looked for and can't be gone."""
    return files.where(~F.coalesce("is_deleted", F.lit(False)) & F.col("vault_name").isin(list(vaults)))


def to_hash(files: DataFrame, disk: DataFrame) -> DataFrame:
    """Paths on disk whose content must be read: unknown ones and those whose time or size differs. All others are unchanged."""
    return _joined(files, disk).where(F.col("d.on_disk") & _needs_hash()).select("d.absolute_path")


def diff_snapshots(files: DataFrame, disk: DataFrame, hashes: DataFrame) -> DataFrame:
    """Changes from stored to seen files: change_type, old_id, vault_name, file_path, absolute_path, file_hash, mtime, file_size.

    ``files``: stored files of ``active_files``, one row an id; ``disk``: the listing (repeated rows count once);
    ``hashes``: (absolute_path, file_hash) of the paths of ``to_hash``, those missing could not be read and are skipped.
    Known path, other hash: ``modified``; same hash: ``touched``. Of the unknown paths and the disappeared
    files with one hash, the smallest path and the smallest id are one ``moved`` file; the rest is ``new`` and ``deleted``.
    A stored file whose hash is unknown counts as modified and is never moved. Equal hashes, however many, meet
    as two aggregates, not as pairs.
    """
    hashes = hashes.where(F.col("file_hash").isNotNull()).groupBy("absolute_path").agg(F.min("file_hash").alias("new_hash"))
    rows = _joined(files, disk).withColumn("asks", F.col("d.on_disk") & _needs_hash())
    rows = rows.join(hashes.alias("h"), (F.col("d.absolute_path") == F.col("h.absolute_path")) & F.col("asks"), "left")
    rows = rows.select(
        F.col("f.id").alias("old_id"),
        F.coalesce("d.on_disk", F.lit(False)).alias("seen"),
        F.coalesce("asks", F.lit(False)).alias("asks"),
        F.coalesce("d.vault_name", "f.vault_name").alias("vault_name"),
        F.coalesce("d.rel_path", "f.file_path").alias("file_path"),
        F.coalesce("d.absolute_path", "f.absolute_path").alias("absolute_path"),
        F.col("f.file_hash").alias("old_hash"),
        F.col("h.new_hash").alias("new_hash"),
        F.coalesce("d.mtime", "f.mtime").alias("mtime"),
        F.coalesce("d.file_size", "f.file_size").alias("file_size"),
    )
    out = ["change_type", "old_id", "vault_name", "file_path", "absolute_path", "file_hash", "mtime", "file_size"]
    both = rows.where(F.col("old_id").isNotNull() & F.col("asks") & F.col("new_hash").isNotNull())
    kept = both.withColumn("change_type", F.when(F.col("old_hash") == F.col("new_hash"), "touched").otherwise("modified")).withColumn("file_hash", F.col("new_hash"))
    fresh = rows.where(F.col("old_id").isNull() & F.col("new_hash").isNotNull()).drop("old_id")
    gone = rows.where(F.col("old_id").isNotNull() & ~F.col("seen"))
    source = gone.where(F.col("old_hash").isNotNull()).groupBy(F.col("old_hash").alias("new_hash")).agg(F.min("old_id").alias("source_id"))
    target = fresh.groupBy("new_hash").agg(F.min("absolute_path").alias("absolute_path"))
    moves = source.join(target, "new_hash")
    fresh = fresh.join(moves, ["new_hash", "absolute_path"], "left").withColumn("old_id", F.col("source_id"))
    fresh = fresh.withColumn("change_type", F.when(F.col("source_id").isNull(), "new").otherwise("moved")).withColumn("file_hash", F.col("new_hash"))
    left = gone.join(moves.select(F.col("source_id").alias("old_id")), "old_id", "left_anti").withColumn("change_type", F.lit("deleted")).withColumn("file_hash", F.col("old_hash"))
    return kept.select(*out).unionByName(fresh.select(*out)).unionByName(left.select(*out))


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: the number of changes of each kind, 0 where there are none."""
    return changes.agg(*(F.count_if(F.col("change_type") == k).alias(k) for k in KINDS))


def apply_changes(files: DataFrame, changes: DataFrame, as_of: int) -> DataFrame:
    """The stored files after the changes, as a new snapshot; ``files`` has one row an id, deleted ones included.

    A new path that a deleted row holds restores that row; other new paths get an id made from vault and path.
    Modified, moved and deleted rows get ``as_of`` as updated_at, touched ones only time and size. A moved row
    keeps its id and hash. One full join on the id.
    """
    dead = files.where("is_deleted").groupBy("absolute_path").agg(F.min("id").alias("dead_id"))
    c = changes.join(dead, "absolute_path", "left")
    restored = F.when(F.col("change_type") == "new", F.coalesce("dead_id", new_id())).otherwise(F.col("old_id"))
    c = c.withColumn("id", restored).drop("dead_id", "old_id")
    f, n = files.alias("f"), c.alias("c")
    kind = F.col("c.change_type")
    moved_in = kind.isin("new", "moved", "modified")
    pick = lambda name, when: F.when(when, F.col(f"c.{name}")).otherwise(F.col(f"f.{name}")).alias(name)
    stamped = F.when(kind.isin("new", "modified", "moved", "deleted"), F.lit(as_of)).otherwise(F.col("f.updated_at"))
    return f.join(n, F.col("f.id") == F.col("c.id"), "full").select(
        F.coalesce("f.id", "c.id").alias("id"),
        pick("vault_name", kind.isin("new", "moved")),
        pick("file_path", kind.isin("new", "moved")),
        pick("absolute_path", kind.isin("new", "moved")),
        pick("file_hash", kind.isin("new", "modified")),
        pick("file_size", moved_in | (kind == "touched")),
        pick("mtime", moved_in | (kind == "touched")),
        F.when(kind == "deleted", True).when(kind == "new", False).otherwise(F.col("f.is_deleted")).alias("is_deleted"),
        F.coalesce("f.created_at", F.lit(as_of)).alias("created_at"),
        stamped.alias("updated_at"),
    )


def apply_to_chunks(chunks: DataFrame, changes: DataFrame, as_of: int) -> DataFrame:
    """The stored chunks after the changes: those of modified and deleted files are flagged. Moving a file leaves its chunks."""
    hit = changes.where(F.col("change_type").isin("modified", "deleted")).select(F.col("old_id").alias("file_id")).distinct().withColumn("_hit", F.lit(True))
    joined = chunks.join(hit, "file_id", "left")
    return joined.select(*(
        (F.coalesce("_hit", "is_deleted") if c == "is_deleted" else F.when(F.col("_hit"), F.lit(as_of)).otherwise(F.col(c)) if c == "updated_at" else F.col(c)).alias(c) for c in chunks.columns
    ))


def retired(chunks: DataFrame, changes: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(chunk_id) of the stored chunks of files that changed in these ways: as many as the changes, not the index, call for."""
    hit = changes.where(F.col("change_type").isin(list(kinds)) & F.col("old_id").isNotNull()).select(F.col("old_id").alias("file_id")).distinct()
    return chunks.select("file_id", F.col("id").alias("chunk_id")).join(hit, "file_id", "left_semi").select("chunk_id")


def without_deleted(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of a text or vector index whose chunk is there and not flagged."""
    return index.join(chunks.where(~F.coalesce("is_deleted", F.lit(False))).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")


def upsert_files(files: DataFrame, incoming: DataFrame, as_of: int) -> DataFrame:
    """Stored files with the incoming ones put in by (vault_name, file_path): hash, size, time, path, flag and updated_at are the incoming row's."""
    n = incoming.groupBy("vault_name", "file_path").agg(F.max(F.struct("mtime", "file_hash", "file_size", "absolute_path")).alias("n"))
    rows = files.join(n, ["vault_name", "file_path"], "full")
    new = F.col("n").isNotNull()
    pick = lambda c: F.when(new, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(
        F.coalesce("id", new_id()).alias("id"), "vault_name", "file_path", pick("absolute_path"), pick("file_hash"), pick("file_size"), pick("mtime"),
        F.when(new, False).otherwise(F.col("is_deleted")).alias("is_deleted"), F.coalesce("created_at", F.lit(as_of)).alias("created_at"), F.when(new, F.lit(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def files_without_chunks(files: DataFrame, chunks: DataFrame, known_empty: DataFrame | None = None) -> DataFrame:
    """Active files that have no active chunk and aren't known to be empty."""
    active = chunks.where(~F.coalesce("is_deleted", F.lit(False))).select(F.col("file_id").alias("id"))
    found = files.where(~F.coalesce("is_deleted", F.lit(False))).join(active, "id", "left_anti")
    return found.join(known_empty.select("id"), "id", "left_anti") if known_empty is not None else found
