"""Parquet tables of a data folder and the row that counts of each id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current(df: DataFrame, *columns: str) -> DataFrame:
    """The row of greatest ``updated_at`` of each ``id``, of ``id``, ``updated_at`` and ``columns`` only.

    Pass small columns: they are shuffled; for texts there is ``current_texts``. Rows without an id belong to nothing
    and are left out; a null ``updated_at`` counts as older than any other. Rows that tie are identical in these
    tables; should they differ, the greatest values are taken, so the result is the same in every run.
    """
    state = F.struct("updated_at", *columns)
    rows = df.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(state).alias("_state"))
    return rows.select("id", "_state.updated_at", *(F.col("_state")[c].alias(c) for c in columns))


def current_texts(df: DataFrame, *columns: str, where: Column | None = None) -> DataFrame:
    """The same for rows that hold texts, of those current rows for which ``where`` is true.

    Which row counts is decided on ids and times; only rows that may come out are shuffled with their texts, once.
    """
    known = df.where(F.col("id").isNotNull())
    newest = known.groupBy("id").agg(F.max("updated_at").alias("_newest"))
    rows = known if where is None else known.where(where)
    rows = rows.select("id", "updated_at", *columns).join(newest, "id").where(F.col("updated_at").eqNullSafe(F.col("_newest")))
    return current(rows, *columns)


def not_deleted(flag: str = "is_deleted"):
    """False or null flags are live."""
    return ~F.coalesce(F.col(flag), F.lit(False))
