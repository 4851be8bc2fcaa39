"""Text expressions, all on the JVM."""

from __future__ import annotations

import fnmatch
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def estimated_tokens(text: Column, han: float = 1.5, other: float = 4.0) -> Column:
    """Tokens by count of characters: Han ones and all others; 0 for an empty text, null for null."""
    wide = F.char_length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]+", ""))
    return F.floor(wide / F.lit(han) + (F.char_length(text) - wide) / F.lit(other)).cast("long")


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Letters that decompose into a base letter and marks, and those base letters; then the marks themselves."""
    single, base, marks = [], [], []
    for code in (*range(0xAC00), *range(0xD7A4, 0xF900)):  # Hangul composes letters, not accents
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        parts = unicodedata.normalize("NFD", c)
        if parts != c:
            rest = [x for x in parts if unicodedata.category(x) != "Mn"]
            if len(rest) == 1:
                single.append(c)
                base.append(rest[0])
    return "".join(single) + "".join(marks), "".join(base)


def fold_accents(text: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or marks of their own."""
    matching, replacement = _accents()
    return F.translate(F.lower(text), matching, replacement)


def terms(text: Column) -> Column:
    """Index terms in order: maximal runs of letters and digits, lower case, accents folded."""
    return F.regexp_extract_all(fold_accents(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def clean_query(text: Column) -> Column:
    """Only word characters, Han and hyphens, white space collapsed."""
    kept = F.regexp_replace(text, r"(?U)[^\w\s\x{4e00}-\x{9fa5}\-]", " ")
    return F.regexp_replace(strip(kept), r"(?U)\s+", " ")


def match_expression(text: Column) -> Column:
    """A full-text expression: every white-space separated word quoted, joined by OR."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    return F.array_join(F.transform(words, lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def index_text(path: Column, section_path: Column, section_title: Column, tags: Column, doc_type: Column, content: Column) -> Column:
    """What a chunk is found by: file name twice, section path, section title twice, tags, document type, content; empty parts dropped."""
    name = F.substring_index(path, "/", -1)
    hashed = F.array_join(F.transform(F.filter(tags, lambda x: strip(x) != ""), lambda x: F.concat(F.lit("#"), strip(x))), " ")
    parts = F.array(*(F.coalesce(x, F.lit("")) for x in (name, name, section_path, section_title, section_title, hashed, doc_type, content)))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def glob_pattern(pattern: str) -> str:
    """A shell pattern as a regular expression over a whole string; ``*`` crosses ``/``."""
    return fnmatch.translate(pattern).replace(r"\z", r"\Z").removesuffix(r"\Z").removeprefix("(?s:").removesuffix(")")


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern matches the whole relative path or one of its parts."""
    if not patterns:
        return F.lit(False)
    whole = "(?s)^(?:" + "|".join(glob_pattern(p) for p in patterns) + r")\z"
    return path.rlike(whole) | F.exists(F.split(path, "/"), lambda part: part.rlike(whole))


def in_skipped_dir(path: Column, dirs: tuple[str, ...]) -> Column:
    """Whether a directory above the file has one of the names, at any depth."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, dirs))) if dirs else F.lit(False)
