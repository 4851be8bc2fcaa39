"""Words of running text set apart, with dates kept whole."""

from __future__ import annotations

import logging
import math
import re
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)

#: The modes, of which ``search`` also gives the shorter words inside a long one.
MODES = ("precise", "search")
#: Fixed value: dates that segmentation must leave whole.
DATE = re.compile(r"\d{4}(?:-\d{2}(?:-\d{2})?|年(?:\d{1,2}(?:月(?:\d{1,2}日)?)?)?)")

_RUN = re.compile(r"[一-鿿]+|[^\s一-鿿]+")

Cut = Callable[[str], list[str]]


class DictionarySegmenter:
    """Cuts runs of Han characters along the most likely path over a dictionary's words; other runs are words.

    A word's probability is its share of all frequencies; a character in no word counts as seen once.
    """

    def __init__(self, words: Mapping[str, int], mode: str = "precise"):
        self.words = {w: max(int(n or 1), 1) for w, n in words.items() if w}
        self.longest = max(map(len, self.words), default=1)
        self.total = math.log(sum(self.words.values()) or 1)
        self.mode = mode

    def _path(self, run: str) -> list[str]:
        n = len(run)
        best = [(0.0, n)] * (n + 1)
        for i in range(n - 1, -1, -1):
            ends = [j for j in range(i + 1, min(n, i + self.longest) + 1) if j == i + 1 or run[i:j] in self.words]
            best[i] = max((math.log(self.words.get(run[i:j], 1)) - self.total + best[j][0], j) for j in ends)
        out, i = [], 0
        while i < n:
            out.append(run[i : best[i][1]])
            i = best[i][1]
        return out

    def __call__(self, text: str) -> list[str]:
        out: list[str] = []
        for m in _RUN.finditer(text):
            run = m.group()
            for word in self._path(run) if "一" <= run[0] <= "鿿" else [run]:
                if self.mode == "search":
                    out += [word[i : i + size] for size in (2, 3) if len(word) > size for i in range(len(word) - size + 1) if word[i : i + size] in self.words]
                out.append(word)
        return out


def segmenter(words: Mapping[str, int] | None = None, mode: str = "precise") -> Cut | None:
    """What cuts a text into words: the jieba library with ``words`` added if it is installed, else the dictionary alone.

    None without either: texts are then only stripped. An unknown mode is taken as ``precise``, with a warning.
    """
    if mode not in MODES:
        log.warning("unknown mode of segmentation %r, taking %r", mode, MODES[0])
        mode = MODES[0]
    try:
        import jieba
    except ImportError:
        return DictionarySegmenter(words, mode) if words else None
    own = jieba.Tokenizer()
    for word, freq in (words or {}).items():
        own.add_word(word, freq)
    return own.lcut if mode == "precise" else own.lcut_for_search


def segmented(text: str | None, cut: Cut | None = None) -> str:
    """Words set apart by blanks, dates kept whole, no blanks around dots; without ``cut`` the stripped text as it is."""
    if cut is None or not (text or "").strip():
        return (text or "").strip()
    words: list[str] = []
    for between, date in zip(DATE.split(text), [*DATE.findall(text), ""], strict=True):
        words += [w for w in cut(between) if w.strip()]
        words += [date] if date else []
    return re.sub(r"\s*\.\s*", ".", " ".join(words))


def segment_texts(texts: DataFrame, words: Mapping[str, int] | None, mode: str = "precise") -> DataFrame:
    """``texts`` with ``content`` segmented; as it is if nothing can segment. The dictionary is sent once to each executor."""
    if segmenter(words, mode) is None:
        return texts
    held = texts.sparkSession.sparkContext.broadcast(dict(words or {}))
    at = texts.columns.index("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = segmenter(held.value, mode)
        for batch in batches:
            done = pa.array([None if x is None else segmented(x, cut) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], done, *batch.columns[at + 1 :]], names=batch.schema.names)

    return texts.mapInArrow(run, texts.schema)
