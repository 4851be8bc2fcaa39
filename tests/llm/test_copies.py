"""Copies: canonical forms, groups of all sizes, hot keys."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import copies as C

FILES = "id long, file_hash string, is_deleted boolean, updated_at long, k1 string, kind string"
CHUNKS = "id long, content string, is_deleted boolean, updated_at long, keep_id long, n_copies int"


def files(spark, *rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], FILES)


def chunks(spark, *rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], CHUNKS)


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Hello, World", "hello  WORLD!", True), ("ab c", "a bc", True), ("a", "b", False),
        ("a: 1\nb = 2", "B=2; A:1", True), ("a:1|b:2", "b:1|a:2", False), ("* **a** : x\n* **b** : y", "b=Y\n\na=X\n", True),
        ("a:1\nb", "b\na:1", False), ("a:b:1\nc:2", "c:2\na:b:1", False), ("a:1", "1:a", False), ("a:\nb:2", "b:2\na:", False),
        ("a=1;b=2;", ";b=2;a=1", True), ("a:1\nb:2", "a1b2", False), ("a:1;a:1;b:2", "a:1;b:2", False), ("é", "e", False),
    ],
)
def test_canonical(spark, a, b, same):
    rows = spark.createDataFrame([(a,), (b,)], "x string").select(C.canonical_text(F.col("x"))).collect()
    assert (rows[0] == rows[1]) is same


def test_groups(spark):
    f = files(spark, (1, "AB:cd", False, 1), (2, "abcd", None, 1), (3, "ab-CD", True, 1), (4, None, False, 1), (5, None, False, 1), (6, "", False, 1), (7, "-", False, 1), (2, "old", False, 0), (2, "abcd", None, 1), (None, "abcd", False, 1))
    c = chunks(spark, (1, "x y", False, 1), (2, "X-Y", None, 1), (3, "xy", True, 1), (4, "...", False, 1), (5, "", False, 1), (6, None, False, 1), (7, "xy", False, 2), (7, "old", False, 1), (8, "abcd", False, 1))
    assert found(C.duplicate_copies(f, c)) == [("chunk", 1, 2), ("chunk", 1, 7), ("file", 1, 2)]
    assert found(C.collapsed(f, c)) == [("chunk", 1, 3), ("chunk", 8, 1), ("file", 1, 2)]
    assert found(C.duplicate_copies(f.limit(0), c.limit(0))) == []


def test_hot_keys_like_the_rest(spark):
    keys = spark.range(6000).select(F.lit("chunk").alias("kind"), "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k1"), F.lit(1).cast("long").alias("k2")).withColumn("k1", F.col("k1").cast("long"))
    hot, cold = (sorted(map(tuple, C.copies(keys, hot_rows=n).collect())) for n in (100, 10**9))
    assert hot == cold and len(hot) == 6000
    assert max(r[3] for r in hot) > 2000


def test_long_text_is_quick(spark):
    assert found(C.duplicate_copies(files(spark, (1, "x", False, 1)), chunks(spark, (1, "word " * 100_000, False, 1), (2, "word\n" * 100_000, False, 1)))) == [("chunk", 1, 2)]
