"""What changed between consecutive full deliveries of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

KEYS = ("snapshot_no", "vault_name", "file_path")


def normal_path(path: Column) -> Column:
    """``/`` as separator, no leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")


def folded(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def snapshot_states(deliveries: DataFrame) -> DataFrame:
    """One row of each file present in each snapshot: its keys and folded hash.

    The row of greatest ``updated_at`` counts; between rows that tie on it, a row flagged deleted, then the
    greater hash. Rows without snapshot number or path name no file and are left out; a null vault is a vault
    of its own, a null flag means present.
    """
    rows = deliveries.select(
        "snapshot_no",
        "vault_name",
        normal_path(F.col("file_path")).alias("file_path"),
        F.struct(
            F.col("updated_at"),
            F.coalesce("is_deleted", F.lit(False)).alias("gone"),
            folded(F.col("file_hash")).alias("hash"),
        ).alias("state"),
    ).where(F.col("snapshot_no").isNotNull() & F.col("file_path").isNotNull())
    latest = rows.groupBy(*KEYS).agg(F.max("state").alias("state"))
    return latest.where(~F.col("state.gone")).select(*KEYS, F.col("state.hash").alias("hash"))


def snapshot_changes(deliveries: DataFrame) -> DataFrame:
    """Files added, removed or changed from each snapshot to the next one that exists.

    Every state is put once under its own number, as new, and once under its successor's, as old. EXCEPT ALL in
    both directions takes out what stayed the same; a full join of the two residues by key labels the rest:
    only new: ``added``, only old: ``removed``, both with known hashes: ``changed``. Both present with an unknown
    hash is no change. Numbers may have gaps; the first snapshot has nothing to be compared with. An empty table
    has no changes. Result: snapshot_no (the later one), vault_name, file_path, change.
    """
    numbers = F.array_sort(F.collect_set("snapshot_no"))
    known = deliveries.agg(numbers.alias("numbers")).scalar()
    states = materialise(snapshot_states(deliveries), "snapshot-states")  # read as new and as old, in both directions
    place = F.array_position(known, F.col("snapshot_no"))
    new = states.where(place > 1)
    old = states.withColumn("snapshot_no", F.try_element_at(known, (place + 1).cast("int"))).where(F.col("snapshot_no").isNotNull())
    arrived, left = new.exceptAll(old).alias("n"), old.exceptAll(new).alias("o")
    same = (F.col("n.snapshot_no") == F.col("o.snapshot_no")) & (F.col("n.file_path") == F.col("o.file_path")) & F.col("n.vault_name").eqNullSafe(F.col("o.vault_name"))
    both = F.col("n.snapshot_no").isNotNull() & F.col("o.snapshot_no").isNotNull()
    change = (
        F.when(F.col("o.snapshot_no").isNull(), "added")
        .when(F.col("n.snapshot_no").isNull(), "removed")
        .when(both & (F.col("n.hash") != F.col("o.hash")), "changed")
    )
    return (
        arrived.join(left, same, "full")
        .select(*(F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in KEYS), change.alias("change"))
        .where(F.col("change").isNotNull())
    )
