"""Word lists with frequencies: reading, merging, writing."""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Fixed value: frequency of a word whose own is no number.
DEFAULT_FREQ = 100


def read_dictionary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(word, freq, source) of files of lines ``word freq [kind]``; blank lines, comments and lone words are dropped."""
    ranked = F.create_map(*(F.lit(x) for i, p in enumerate(paths) for x in (p.rsplit("/", 1)[-1], i)))
    name = F.url_decode(F.substring_index(F.input_file_name(), "/", -1))
    lines = spark.read.text(paths).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("line"), name.alias("source"))
    parts = F.split("line", r"(?U)\s+")
    rows = lines.where((F.col("line") != "") & ~F.col("line").startswith("#") & (F.size(parts) >= 2))
    return rows.select(parts[0].alias("word"), F.coalesce(parts[1].try_cast("int"), F.lit(DEFAULT_FREQ)).alias("freq"), "source", F.try_element_at(ranked, F.col("source")).alias("source_order"))


def merge_dictionary(words: DataFrame) -> DataFrame:
    """(word, freq, source): each word with its greatest frequency; between equal ones the earliest source counts.

    Sources are ordered by ``source_order`` if there is one, else by name. Null or unreadable frequencies count as
    DEFAULT_FREQ; blank words, comments (``#``) and null words are dropped; blanks around words go.
    """
    clean = F.regexp_replace("word", r"(?U)^\s+|\s+$", "")
    order = F.col("source_order").cast("string") if "source_order" in words.columns else F.col("source")
    rows = words.select(clean.alias("word"), F.coalesce(F.col("freq"), F.lit(DEFAULT_FREQ)).alias("freq"), F.col("source"), order.alias("_order"))
    rows = rows.where(F.col("word").isNotNull() & (F.col("word") != "") & ~F.col("word").startswith("#"))
    best = rows.groupBy("word").agg(F.min(F.struct((-F.col("freq")).alias("least"), F.col("_order"), F.col("source"))).alias("s"))
    return best.select("word", (-F.col("s.least")).alias("freq"), F.col("s.source").alias("source"))


def dictionary_statistics(merged: DataFrame) -> DataFrame:
    """One row: words, and those of at least 1000, 500 and 100."""
    at_least = lambda n: F.count_if(F.col("freq") >= n).alias(f"freq_{n}")
    return merged.agg(F.count("*").alias("words"), at_least(1000), at_least(500), at_least(100))


def write_dictionary(merged: DataFrame, path: str) -> None:
    """Lines ``word freq n``, the most frequent first, then by word."""
    merged.orderBy(F.desc("freq"), "word").select(F.concat_ws(" ", "word", F.col("freq").cast("string"), F.lit("n"))).write.mode("overwrite").text(path)


def words_of(spark: SparkSession, path: str) -> dict[str, int]:
    """A user dictionary's words with their frequencies, for a segmenter: a word list written by hand, which the driver holds.

    None at ``path`` is an empty one, with a warning.
    """
    if not path:
        return {}
    file = Path(path).expanduser()
    if not file.exists():
        log.warning("no dictionary at %s", file)
        return {}
    return {r.word: r.freq for r in merge_dictionary(read_dictionary(spark, [str(file.absolute())])).collect()}
