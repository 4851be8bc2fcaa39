"""Markdown files of vault folders: listing, reading, hashing."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Excludes, Vault
from tidemark.functions.text import excluded

log = logging.getLogger(__name__)

#: Folders never entered.
SKIPPED_DIRS = (".git", ".obsidian", ".trash", ".Trash", "node_modules", "__pycache__", ".venv", "venv", ".idea", ".vscode")

LISTING = T.StructType(
    [T.StructField("absolute_path", T.StringType()), T.StructField("vault_name", T.StringType()), T.StructField("rel_path", T.StringType()), T.StructField("mtime", T.LongType()), T.StructField("file_size", T.LongType())]
)


def _walk(top: str, skipped: frozenset[str]) -> Iterable[tuple[str, str, int, int]]:
    for folder, dirs, names in os.walk(top):
        dirs[:] = sorted(d for d in dirs if d not in skipped)
        for name in sorted(names):
            if name.endswith(".md"):
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                except OSError:
                    continue
                yield path, os.path.relpath(path, top), int(stat.st_mtime), stat.st_size


def list_vault(spark: SparkSession, vaults: Iterable[Vault], excludes: Excludes = Excludes()) -> DataFrame:
    """Every ``.md`` file of the enabled vaults: absolute_path, vault_name, rel_path, mtime, file_size.

    Folders named in the skip set, the common or the vault's own dirs are not entered at any depth; files whose
    relative path or any part of it matches a pattern are left out. A vault whose folder is missing is an error:
    taking it as empty would mark all its files deleted. Files of one top folder are listed by one task, so a
    vault is walked in parallel; hidden files count like any other.
    """
    jobs, out = [], spark.createDataFrame([], LISTING)
    for vault in vaults:
        if not vault.enabled:
            continue
        if not os.path.isdir(vault.path):
            raise FileNotFoundError(f"vault {vault.name}: no folder {vault.path}")
        skipped = frozenset((*SKIPPED_DIRS, *excludes.dirs, *vault.exclude.dirs))
        patterns = tuple(dict.fromkeys((*excludes.patterns, *vault.exclude.patterns)))
        tops = sorted(d for d in os.listdir(vault.path) if os.path.isdir(os.path.join(vault.path, d)) and d not in skipped)
        jobs.append((vault, skipped, patterns, tops))
    for vault, skipped, patterns, tops in jobs:
        root = vault.path

        def walk(batches, root=root, skipped=skipped, name=vault.name):
            import pandas as pd

            for pdf in batches:
                rows = []
                for top in pdf["top"]:
                    base = os.path.join(root, top) if top else root
                    if top:
                        rows += [(path, name, os.path.join(top, rel), mtime, size) for path, rel, mtime, size in _walk(base, skipped)]
                    else:
                        flat = frozenset(d for d in os.listdir(root) if os.path.isdir(os.path.join(root, d)))
                        rows += [(path, name, rel, mtime, size) for path, rel, mtime, size in _walk(root, flat)]
                yield pd.DataFrame(rows, columns=LISTING.names)

        folders = spark.createDataFrame([("",), *((t,) for t in tops)], "top string").repartition(max(1, min(len(tops) + 1, 200)))
        listed = folders.mapInPandas(walk, LISTING)
        out = out.unionByName(listed.where(~excluded(F.col("rel_path"), patterns)))
    return out


def read_listed(listing: DataFrame) -> DataFrame:
    """(absolute_path, file_hash, text) of the files of a listing: SHA-256 of the bytes, and UTF-8 text with line feeds.

    Read where the listing's rows are, so no list of paths passes the driver; one row at a time leaves a task, as a file
    may be of any size. The text of a file that is no UTF-8 is null; files that can't be read are left out.
    """

    def read(batches):
        import hashlib

        import pandas as pd

        for pdf in batches:
            for path in pdf["absolute_path"]:
                try:
                    with open(path, "rb") as f:
                        raw = f.read()
                except OSError as error:
                    log.warning("left out %s: %s", path, error)
                    continue
                try:
                    text = raw.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
                except UnicodeDecodeError as error:
                    log.warning("no text in %s: %s", path, error)
                    text = None
                yield pd.DataFrame({"absolute_path": [path], "file_hash": [hashlib.sha256(raw).hexdigest()], "text": [text]})

    return listing.select("absolute_path").mapInPandas(read, "absolute_path string, file_hash string, text string")
