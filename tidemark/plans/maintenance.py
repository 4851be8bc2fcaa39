"""Upkeep of stored tables as new snapshot folders; a folder that is read is never written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import stats
from tidemark.operators.index import Index, TextIndex, totals_of
from tidemark.operators.scan import without_deleted

#: How the stored tables lie: folders by these columns.
FOLDERS = {"postings": ("bucket",)}
#: The order of rows in each file, so that a search by it reads single pages.
ORDER = {"postings": ("bucket", "term", "chunk_id", "position"), "chunks": ("id",)}
#: Tables of rows of deleted chunks, beside the chunks themselves.
BY_CHUNK = ("vectors", "postings", "lengths")


def cascade(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose file is stored, whatever its flag: what deleting files leaves of their chunks."""
    return chunks.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")


class Store:
    """Tables of an index in versioned folders ``<root>/v<n>/<table>``; a small file names the version that counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number that counts, 0 for an empty store."""
        found = [int(s.getPath().getName()[8:]) for s in self._fs.globStatus(self._path(f"{self.root}/CURRENT-*")) or []]
        return max(found, default=0)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{self.version()}/{name}")

    def names(self) -> list[str]:
        """The tables of the version that counts."""
        if not self.version():
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/v{self.version()}")))

    def index(self) -> Index:
        """What a search reads."""
        files, chunks, vectors, *text = (self.read(x) for x in ("files", "chunks", "vectors", "postings", "lengths", "totals"))
        return Index(files, chunks, vectors, TextIndex(*text))

    def bytes(self) -> int:
        """The size of the version that counts."""
        return self._fs.getContentSummary(self._path(f"{self.root}/v{self.version()}")).getLength() if self.version() else 0

    def put(self, number: int, name: str, df: DataFrame) -> DataFrame:
        """Write a table of a version that doesn't count yet, and read it back."""
        path = f"{self.root}/v{number}/{name}"
        df = df.sortWithinPartitions(*ORDER[name]) if name in ORDER else df
        df.write.mode("overwrite").partitionBy(*FOLDERS.get(name, ())).parquet(path)
        return self.spark.read.parquet(path)

    def count(self, number: int) -> int:
        """From now on this version counts."""
        self._fs.create(self._path(f"{self.root}/CURRENT-{number}"), False).close()
        return number

    def write(self, **tables: DataFrame) -> int:
        """All tables as one new version. It counts once the last one is written; before, nothing has changed."""
        number = self.version() + 1
        for name, df in tables.items():
            self.put(number, name, df)
        return self.count(number)

    def drop_old(self) -> None:
        """Delete versions before the one that counts."""
        now = self.version()
        for n in range(1, now):
            self._fs.delete(self._path(f"{self.root}/v{n}"), True)
            self._fs.delete(self._path(f"{self.root}/CURRENT-{n}"), False)

    def compact(self, files_per_table: int) -> int:
        """The same rows in fewer, larger files, as a new version."""
        return self.write(**{n: self.read(n).coalesce(files_per_table) for n in self.names()})

    def migrate(self, name: str, columns: list[str]) -> int:
        """A table with the given columns only, the others as they are; it must keep its number of rows."""
        before, names, number = self.read(name), self.names(), self.version() + 1
        for n in names:
            self.put(number, n, before.select(*columns) if n == name else self.read(n))
        if self.spark.read.parquet(f"{self.root}/v{number}/{name}").count() != before.count():
            self._fs.delete(self._path(f"{self.root}/v{number}"), True)
            raise ValueError(f"{name}: rows were lost")
        return self.count(number)

    def state(self, threshold: float = 20.0) -> dict:
        """Shares of deleted rows in percent, whether they call for upkeep, and the store's size in MB."""
        found = stats.soft_deleted(self.read("files"), self.read("chunks"), threshold).first().asDict()
        return {**found, "file_size_mb": round(self.bytes() / (1 << 20), 2)}

    def maintain(self, threshold: float = 20.0, force: bool = False, dry_run: bool = False, clean: bool = True, compact: bool = True, say: Callable[..., None] = lambda *_: None) -> dict:
        """Purge and compact if the share of deleted rows is above the threshold; what was, or would be, removed.

        ``clean`` and ``compact`` say which of the two is done. Compacting deletes older versions.
        """
        state = self.state(threshold)
        files, chunks, vectors = (self.read(x) for x in ("files", "chunks", "vectors"))
        removed = stats.purge_counts(files, chunks, vectors).first().asDict()
        say("deleted: %.1f %% of files, %.1f %% of chunks; %s MB", state["file_ratio"], state["chunk_ratio"], state["file_size_mb"])
        if dry_run or not (state["needed"] or force):
            return {**state, "would_remove": removed, "purged": False}
        if clean:
            kept = dict(zip(("files", "chunks", "vectors"), stats.purge(files, chunks, vectors), strict=True))
            for name in set(self.names()) & set(BY_CHUNK) - {"vectors"}:
                kept[name] = without_deleted(self.read(name), kept["chunks"])
            if "totals" in self.names():
                kept["totals"] = totals_of(kept["lengths"], self.read("totals").head().buckets)
            self.write(**kept)
        if compact:
            self.compact(max(1, -(-self.bytes() // FILE_BYTES)))
            self.drop_old()
        return {**state, **({"removed": removed} if clean else {}), "purged": clean, "compacted": compact, "file_size_after_mb": round(self.bytes() / (1 << 20), 2)}


#: Bytes of a file after compaction, roughly.
FILE_BYTES = 256 << 20
