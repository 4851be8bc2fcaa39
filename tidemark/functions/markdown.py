"""Frontmatter and section-aware blocks of Markdown files, one Arrow pass over whole texts."""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Chunking
from tidemark.session import spread

#: The patterns of the file format.
HEADER = re.compile(r"^(#{1,6})\s+(.*)")
FENCE = re.compile(r"^(`{3,}|~{3,})\s*(\w*)")
LIST_ITEM = re.compile(r"^(\s*)([*+-]|\d+\.)\s+")
FRONTMATTER = re.compile(r"^---\s*\n(.*?)\n---\s*\n", re.DOTALL)
SENTENCE_END = re.compile(r"([。！？.!?]\s*|[；;]\s*|[\n])")
HAN = re.compile(r"[一-鿿]")
#: What a file without the key counts as when it is indexed.
DEFAULT_TYPE, DEFAULT_STATUS = "blog", "已完成"
#: The encoding tokens are counted by, and how texts are cut for a vocabulary of ranks.
ENCODING = "cl100k_base"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHUNKS = "file_id long, chunk_index int, content string, content_type string, section_title string, section_path string, start_pos int, end_pos int, metadata string, confidence_json string"


@dataclass(frozen=True)
class Piece:
    content: str
    content_type: str
    path: tuple[str, ...]
    start: int
    end: int


def frontmatter(text: str) -> tuple[dict, str]:
    """The mapping at the head of a file and the rest. YAML that is broken or no mapping is read line by line as ``key: value``."""
    m = FRONTMATTER.match(text)
    if not m:
        return {}, text
    try:
        import yaml

        found = yaml.safe_load(m.group(1))
    except Exception:  # noqa: BLE001 - any broken YAML
        found = None
    if not isinstance(found, dict):
        pairs = (line.partition(":") for line in m.group(1).split("\n"))
        found = {k.strip(): v.strip().strip("\"'") for k, colon, v in pairs if colon}
    return found, text[m.end() :]


def confidence_factors(meta: dict, mtime: float | None, as_of: dt.date) -> dict[str, Any]:
    """doc_type, status and final_date of a file: the last from final_date, date, its mtime (UTC; 0 is unknown) or ``as_of``."""
    date = meta.get("final_date") or meta.get("date")
    if not date:
        date = dt.datetime.fromtimestamp(mtime, dt.UTC).date() if mtime else as_of
    written = date.strftime("%Y-%m-%d") if isinstance(date, dt.date) else str(date).split(" ")[0]
    return {"doc_type": meta.get("doc_type", DEFAULT_TYPE), "status": meta.get("status", DEFAULT_STATUS), "final_date": written}


def token_counter(chunking: Chunking) -> Callable[[str], int]:
    """Tokens of a text as ``token_mode`` says: by its numbers of Han and other characters, or by the tiktoken library.

    With ``tiktoken`` the ranks come from ``vocabulary``, else from the library's own encoding. If the library or the
    encoding isn't there, that is an error: counting in another way would give other chunks.
    """
    if chunking.token_mode == "tiktoken":
        return _library_counter(chunking.vocabulary)
    if chunking.token_mode != "estimate":
        raise ValueError(f"unknown token mode {chunking.token_mode}")

    def count(text: str) -> int:
        han = len(HAN.findall(text))
        return int(han / chunking.chinese_chars_per_token + (len(text) - han) / chunking.english_chars_per_token)

    return count


@lru_cache(2)
def _library_counter(vocabulary: str) -> Callable[[str], int]:
    try:
        import tiktoken
    except ImportError as error:
        raise RuntimeError("token mode tiktoken needs the tiktoken library; estimate goes without") from error
    if vocabulary:
        lines = (line.split() for line in Path(vocabulary).expanduser().read_bytes().splitlines() if line)
        encoding = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})
    else:
        encoding = tiktoken.get_encoding(ENCODING)
    return lambda text: len(encoding.encode_ordinary(text))


@dataclass
class _Block:
    """Lines gathered so far, and where the first begins."""

    kind: str = "text"
    start: int = 0
    lines: list[str] = field(default_factory=list)
    size: int = 0

    def add(self, line: str) -> None:
        self.lines.append(line)
        self.size += len(line)


class Splitter:
    """Blocks of one kind under one path of headings, none above the token limit (but see ``oversized``).

    Prose right after a heading belongs to the heading's block. A table or list ends at the first line of another
    kind, which counts as text even if it begins a list or table; the next such line switches.
    """

    def __init__(self, chunking: Chunking, count: Callable[[str], int] | None = None):
        """``count``: the tokens of a text, if not by numbers of characters."""
        self.count = count or token_counter(chunking)
        self.limit, self.overlap = chunking.max_tokens, chunking.overlap
        self.max_chars = int(chunking.max_tokens * chunking.max_chars_multiplier)
        self.near_limit = int(chunking.max_tokens * 0.8 * chunking.english_chars_per_token)
        self.slice_chars = int(chunking.max_tokens * chunking.chinese_chars_per_token * 0.9)

    def split(self, body: str) -> list[Piece]:
        return list(self._blocks(body))

    def _blocks(self, body: str) -> Iterator[Piece]:
        path: tuple[str, ...] = ()
        block, at, code = _Block(), 0, False
        for line in body.splitlines(keepends=True):
            bare = line.strip()
            fence = FENCE.match(bare)
            end = at + len(line)
            if code:
                block.add(line)
                if fence:
                    yield from self._emit(block, path, end)
                    block, code = _Block(start=end), False
            elif fence:
                yield from self._emit(block, path, at)
                block, code = _Block("code", at), True
                block.add(line)
            elif header := HEADER.match(bare):
                yield from self._emit(block, path, at)
                path = (*path[: len(header.group(1)) - 1], header.group(2))
                block = _Block("header", at)
                block.add(line)
            else:
                kind = self._next_kind(block.kind, line, bare)
                if kind != block.kind:
                    if block.lines:
                        yield from self._emit(block, path, at)
                        block = _Block(start=at)
                    block.kind = kind
                block.add(line)
                if self._full(block):
                    yield from self._emit(block, path, end)
                    block = self._carried(block, end)
            at = end
        yield from self._emit(block, path, at)

    @staticmethod
    def _next_kind(open_kind: str, line: str, bare: str) -> str:
        found = "table" if bare.startswith("|") else "list" if LIST_ITEM.match(line) else "blank" if not bare else "text"
        if open_kind in ("table", "list"):
            return open_kind if found in (open_kind, "blank") else "text"
        return found if found in ("table", "list") else open_kind

    def _full(self, block: _Block) -> bool:
        if block.size > self.max_chars:
            return True
        return block.size > self.near_limit and self.count("".join(block.lines)) > self.limit

    def _carried(self, block: _Block, end: int) -> _Block:
        """What the next block begins with: trailing lines within the overlap, of prose only."""
        kept = 0
        if block.kind in ("text", "header") and self.overlap > 0:
            while kept < len(block.lines) and self.count("".join(block.lines[-kept - 1 :])) <= self.overlap:
                kept += 1
        lines = block.lines[len(block.lines) - kept :]
        size = sum(map(len, lines))
        return _Block(block.kind, end - size, lines, size)

    def _emit(self, block: _Block, path: tuple[str, ...], end: int) -> Iterator[Piece]:
        text = "".join(block.lines).strip()
        if text and self.count(text) > self.limit:
            yield from self.oversized(text, block.kind, path, block.start)
        elif text:
            yield Piece(text, block.kind, path, block.start, end)

    def oversized(self, text: str, kind: str, path: tuple[str, ...], start: int) -> list[Piece]:
        """Runs of sentences within the limit; slices of a fixed length of a sentence that is above it.

        Code, tables and lists below twice the limit stay whole. A run is placed where its first sentence occurs
        first in the text.
        """
        whole = [Piece(text, kind, path, start, start + len(text))]
        if kind in ("code", "table", "list") and self.count(text) < 2 * self.limit:
            return whole
        parts = SENTENCE_END.split(text)
        sentences = [a + b for a, b in zip(parts[::2], parts[1::2], strict=False)] + ([parts[-1]] if parts[-1].strip() else [])
        out: list[Piece] = []
        run, place = "", start

        def close() -> None:
            if run.strip():
                out.append(Piece(run.strip(), kind, path, place, place + len(run)))

        for sentence in sentences or [text]:
            if self.count(sentence) > self.limit:
                close()
                place += len(run) if run.strip() else 0
                for i in range(0, len(sentence), self.slice_chars):
                    part = sentence[i : i + self.slice_chars]
                    if part.strip():
                        out.append(Piece(part.strip(), kind, path, place + i, place + i + len(part)))
                run, place = "", start + text.find(sentence) + len(sentence)
            elif run.strip() and self.count(run + sentence) > self.limit:
                close()
                run, place = sentence, start + text.find(sentence)
            else:
                run += sentence
        close()
        return out or whole


def _json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, default=lambda x: x.isoformat() if isinstance(x, dt.date) else str(x))


def chars_for_tokens(tokens: int, chunking: Chunking = Chunking()) -> int:
    """Characters that so many tokens have at most, by the estimate."""
    return int(tokens * chunking.english_chars_per_token)


ABOUT = "doc_id long, doc_type string, status string, final_date string, tags string, body string"


def abouts(documents: DataFrame, as_of: dt.date = dt.date(2024, 6, 1)) -> DataFrame:
    """(doc_id, doc_type, status, final_date, tags, body) of (doc_id, text, mtime): what the frontmatter of each text says, and the rest.

    ``tags`` is JSON. A null text has neither; line ends of all kinds are one line feed.
    """
    names = [x.split()[0] for x in ABOUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, mtime in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "mtime")), strict=True):
                meta, body = frontmatter(text.replace("\r\n", "\n").replace("\r", "\n"))
                f = confidence_factors(meta, mtime, as_of)
                tags = meta.get("tags")
                rows.append((doc, *(None if f[k] is None else str(f[k]) for k in ("doc_type", "status", "final_date")), None if tags is None else _json(tags), body))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if k == 0 else pa.string()) for k, c in enumerate(columns)], names=names)

    rows = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("mtime").cast("double"))
    return spread(rows).mapInArrow(run, ABOUT)


def _chunker(chunking: Chunking, as_of: dt.date, make_counter: Callable[[], Callable[[str], int]] | None):
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.string()] * 4, pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(chunking, make_counter() if make_counter else None)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(lo, 256).to_pylist():
                    meta, body = frontmatter(r["text"].replace("\r\n", "\n").replace("\r", "\n"))
                    about, factors = _json(meta), _json(confidence_factors(meta, r["mtime"], as_of))
                    for k, p in enumerate(splitter.split(body)):
                        rows.append((r["file_id"], k, p.content, p.content_type, p.path[-1] if p.path else None, " / ".join(p.path) or "Root", p.start, p.end, about, factors))
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def split_markdown(files: DataFrame, chunking: Chunking = Chunking(), as_of: dt.date = dt.date(2024, 6, 1), make_counter: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """Chunks of whole files: ``files`` has file_id, text and mtime; chunk_index counts from 0 in each file.

    ``make_counter`` makes, in each Python worker, what counts the tokens of a text by a tokenizer of the caller's.

    Positions are code points of the body after the frontmatter. Null, empty and frontmatter-only texts have no
    chunks. Line ends of all three kinds are one line feed.
    """
    rows = files.where(F.col("text").isNotNull()).select(F.col("file_id").cast("long"), F.col("text").cast("string"), F.col("mtime").cast("double"))
    return spread(rows).mapInArrow(_chunker(chunking, as_of, make_counter), CHUNKS)
