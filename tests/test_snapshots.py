"""Changes between full snapshots: every kind of row the deliveries hold."""

import pytest

from tidemark.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_no int, vault_name string, file_path string, file_hash string, is_deleted boolean, updated_at long, hash string, change string"


def rows(spark, *given):
    """Extra columns with the operator's own names must not matter."""
    return spark.createDataFrame([(*g, "x", "y") for g in given], SCHEMA)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_added_removed_changed(spark):
    df = rows(
        spark,
        (1, "v", "a", "H1", False, 1), (1, "v", "b", "H2", False, 1), (1, "v", "c", "H3", None, 1), (1, "v", "gone", "H4", False, 1),
        (4, "v", "a", "h1", False, 2), (4, "v", "b", "H2x", False, 2), (4, "v", "d", "H3", False, 2), (4, "v", "gone", "H4", True, 2),
        (9, "v", "a", "h-1", False, 3), (9, "v", "b", "H2x", False, 3), (9, "v", "c", "H3", False, 3), (9, "v", "gone", None, False, 3),
    )
    assert found(snapshot_changes(df)) == sorted(
        [(4, "v", "b", "changed"), (4, "v", "c", "removed"), (4, "v", "d", "added"), (4, "v", "gone", "removed"), (9, "v", "c", "added"), (9, "v", "d", "removed"), (9, "v", "gone", "added")], key=repr
    )


def test_paths_and_late_rows(spark):
    df = rows(
        spark,
        (1, "v", ".\\x\\y.md", "A", False, 1), (1, "v", "./x/y.md", "old", True, 0),
        (2, "v", "x/y.md", "a", False, 2), (2, "v", "x/y.md", "a", False, 2), (2, "v", "x\\y.md", "zz", False, 1),
    )
    assert found(snapshot_changes(df)) == []


def test_unknown_hash_is_no_change_and_nulls(spark):
    df = rows(
        spark,
        (1, "v", "a", None, False, 1), (1, None, "b", "1", False, 1), (1, "v", None, "1", False, 1), (None, "v", "q", "1", False, 1), (1, "v", "late", "1", False, None),
        (2, "v", "a", "1", False, 1), (2, None, "b", "2", False, 1), (2, "v", "late", "1", False, 5),
    )
    assert found(snapshot_changes(df)) == [(2, None, "b", "changed")]


@pytest.mark.parametrize("given", [[], [(1, "v", "a", "h", False, 1)]])
def test_nothing_to_compare(spark, given):
    assert found(snapshot_changes(rows(spark, *given))) == []


def test_one_vault_with_most_rows(spark):
    df = spark.range(3000).selectExpr("cast(1 + id % 2 as int) as snapshot_no", "'v' as vault_name", "concat('f', cast(id div 2 as string)) as file_path", "if(id % 2 = 1 and id % 30 = 1, 'b', 'a') as file_hash", "false as is_deleted", "id as updated_at")
    assert snapshot_changes(df).groupBy("change").count().collect() == [("changed", 100)]
