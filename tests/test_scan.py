"""Disk against stored files."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scan

FILES = "id long, vault_name string, file_path string, absolute_path string, file_hash string, mtime long, file_size long, is_deleted boolean, created_at long, updated_at long"
DISK = "absolute_path string, vault_name string, rel_path string, mtime long, file_size long, id long"


@pytest.fixture()
def world(spark):
    stored = [(1, "a", "h1", 10, 5), (2, "b", "h2", 10, 5), (3, "c", "h3", 10, 5), (4, "d", "h4", 10, 5), (5, "e", "h5", 10, 5), (6, "g", "h7", 10, 5), (7, "h", "h7", 10, 5), (8, "i", "h8", 10, 5), (9, "n", None, 10, 5)]
    seen = [("a", 10, 5), ("b", 11, 5), ("c", 10, 6), ("d2", 12, 5), ("f", 10, 5), ("g2", 10, 5), ("h2", 10, 5), ("i", 10, 5), ("n", 10, 7), ("locked", 1, 1), ("a", 10, 5)]
    hashes = [("b", "h2"), ("c", "h3x"), ("d2", "h4"), ("f", "h6"), ("g2", "h7"), ("h2", "h7"), ("n", "hn"), ("locked", None)]
    files = spark.createDataFrame([(i, "v", p, f"/{p}", h, m, s, False, 1, 1) for i, p, h, m, s in stored], FILES)
    disk = spark.createDataFrame([(f"/{p}", "v", p, m, s, 99) for p, m, s in seen], DISK)
    return files, disk, spark.createDataFrame([(f"/{p}", h) for p, h in hashes], "absolute_path string, file_hash string")


def test_diff(world):
    got = sorted((r.change_type, r.old_id, r.file_path, r.file_hash) for r in scan.diff_snapshots(*world).collect() if r.old_id) + sorted((r.change_type, r.file_path, r.file_hash) for r in scan.diff_snapshots(*world).collect() if not r.old_id)
    assert got == [
        ("deleted", 5, "e", "h5"), ("deleted", 7, "h", "h7"), ("modified", 3, "c", "h3x"), ("modified", 9, "n", "hn"), ("moved", 4, "d2", "h4"), ("moved", 6, "g2", "h7"), ("touched", 2, "b", "h2"),
        ("new", "f", "h6"), ("new", "h2", "h7"),
    ]
    assert scan.change_counts(scan.diff_snapshots(*world)).first().asDict() == {"new": 2, "modified": 2, "moved": 2, "deleted": 2, "touched": 1}
    assert {r[0] for r in scan.to_hash(*world[:2]).collect()} == {"/b", "/c", "/d2", "/f", "/g2", "/h2", "/n", "/locked"}


def test_empty(spark, world):
    files, disk, hashes = world
    assert scan.diff_snapshots(files.limit(0), disk.limit(0), hashes).count() == 0
    assert scan.change_counts(scan.diff_snapshots(files.limit(0), disk, hashes)).first().asDict()["new"] == 7
    assert scan.change_counts(scan.diff_snapshots(files, disk.limit(0), hashes)).first().asDict()["deleted"] == 9


def test_apply(spark, world):
    files, disk, hashes = world
    dead = spark.createDataFrame([(50, "v", "old", "/f", "hx", 1, 1, True, 1, 1)], FILES)
    changes = scan.diff_snapshots(files, disk, hashes)
    after = {r.file_path: r for r in scan.apply_changes(files.unionByName(dead), changes, 77).collect()}
    assert (after["f"].id, after["f"].is_deleted, after["f"].file_hash, after["f"].updated_at) == (50, False, "h6", 77)
    assert (after["d2"].id, after["d2"].file_hash, after["d2"].mtime) == (4, "h4", 12) and "d" not in after
    assert (after["b"].mtime, after["b"].updated_at) == (11, 1) and after["e"].is_deleted and after["a"].updated_at == 1
    assert after["h2"].id >= 1 << 62 and after["c"].file_hash == "h3x"
    chunks = spark.createDataFrame([(1, 3, False, 1), (2, 4, False, 1), (3, 5, None, 1)], "id long, file_id long, is_deleted boolean, updated_at long")
    flags = {r.id: (r.is_deleted, r.updated_at) for r in scan.apply_to_chunks(chunks, changes, 77).collect()}
    assert flags == {1: (True, 77), 2: (False, 1), 3: (True, 77)}
    kept = scan.without_deleted(chunks.select(F.col("id").alias("chunk_id")), scan.apply_to_chunks(chunks, changes, 77))
    assert [r[0] for r in kept.collect()] == [2]


def test_upsert_and_missing(spark, world):
    files = world[0]
    new = spark.createDataFrame([("v", "a", "/z/a", "hA", 20, 9), ("v", "z", "/z", "hz", 1, 1), ("v", "z", "/z", "hz", 1, 1)], "vault_name string, file_path string, absolute_path string, file_hash string, mtime long, file_size long")
    after = {r.file_path: r for r in scan.upsert_files(files, new, 77).collect()}
    assert len(after) == 10 and (after["a"].id, after["a"].absolute_path, after["a"].file_hash, after["a"].updated_at) == (1, "/z/a", "hA", 77) and after["z"].created_at == 77
    chunks = spark.createDataFrame([(1, False), (2, True), (3, None)], "file_id long, is_deleted boolean")
    assert sorted(r.id for r in scan.files_without_chunks(files, chunks).collect()) == [2, 4, 5, 6, 7, 8, 9]
    assert sorted(r.id for r in scan.files_without_chunks(files, chunks, files.where("id > 4")).collect()) == [2, 4]
