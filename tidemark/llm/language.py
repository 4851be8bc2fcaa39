"""The language a text, and each segment of a mixed text, is written in: naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernel as K
from tidemark.session import spread

#: Labelled rows the model is fitted on at most; they reach the driver.
SAMPLE_ROWS = 20_000
#: Slots of the hashed n-grams, and the longest n-gram.
SLOTS, LONGEST = 1 << 16, 4
SMOOTHING = 0.1
HAN_WEIGHT = 3
#: The n-grams of a place overlap; their evidence counts as that of so many independent ones less.
OVERLAP = float(LONGEST)
#: A language is sure to be in a text if one sentence speaks for it by so much (in nats, after OVERLAP); others must
#: beat the sure ones by DOUBT to count.
SURE, DOUBT = 4.0, 2.0
#: A full sentence has so many letters at least, and so many words or Han characters.
LEAST_LETTERS, LEAST_WORDS, LEAST_HAN = 10, 3, 5

SEGMENTS = "doc_id long, label string, segment_no int, line_no int, lang string, confidence double, sentences int, mixed boolean"

#: Spellings of the six languages (ISO 639-1, 639-2, 639-3, English and own names), folded.
SPELLINGS = {
    "en": "en eng english anglais englisch ingles inglés inglês",
    "zh": "zh zho chi cmn chinese mandarin zhongwen 中文 汉语 漢語 chinois chinesisch",
    "de": "de deu ger german deutsch allemand aleman alemán alemão",
    "fr": "fr fra fre french français francais französisch francés francês",
    "es": "es spa spanish español espanol castellano castilian espagnol spanisch espanhol",
    "pt": "pt por portuguese português portugues brazilian portugais portugiesisch portugués",
}

_FENCE = re.compile(r"[ \t]*(?:>[ \t]?)*[ \t]*(?:[-*+]|\d+[.)])?[ \t]*(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]*(?:>[ \t]?)*[ \t]{0,3}#{1,6}(?:\s|$)")
_UNDERLINE = re.compile(r"[ \t]{0,3}=+\s*$")
_RULE = re.compile(r"[ \t]{0,3}(?:[-*_][ \t]*){3,}$")
_TABLE = re.compile(r"[ \t]*(?:>[ \t]?)*[ \t]*\||.*\|.*\|")
_MARK = re.compile(r"(?:[ \t 　]*>)*[ \t 　]*(?:(?:[-*+•]|\d{1,9}[.)])[ \t 　]+(?:\[[ xX]\][ \t 　]+)?)?")
_ITEM = re.compile(r"[ \t 　]*(?:[-*+•]|\d{1,9}[.)])[ \t 　]+")
#: Code spans, tags, images' and links' targets, bare addresses.
_NOISE = re.compile(r"(`+)[^`\n]*\1|<[^<>\n]{1,200}>|(?<=\])\([^()\n]*\)|(?<=\])\[[^\[\]\n]*\]|\bhttps?://[^\s)>\]]+|\[\^[^\[\]\n]*\]|&[a-z]+;")
#: Set-off phrases inside a sentence.
_ASIDE = re.compile(r"\([^()\n]*\)|（[^（）\n]*）|\*+[^*\n]+\*+|(?<!\w)_+[^_\n]+_+(?!\w)|«[^«»\n]*»|“[^“”\n]*”|„[^„“\n]*“|「[^「」\n]*」|《[^《》\n]*》|\"[^\"\n]*\"")
#: A line or sentence without any of these has no such spans or phrases.
NOISY, ASIDES = ("`", "<", "]", "http", "&"), tuple("(（*_«“„「《\"")
_STOP = re.compile(r"[.!?…]+[\"'”’»“)\]*_~`]*(?=\s|$)|[。！？]+[」』”’）)\]*_~`»\"]*")
_HAN = re.compile(r"[一-鿿]")
_WORD = re.compile(r"[^\W\d_]+")


def prose(text: str) -> Iterator[tuple[int, str, bool]]:
    """Lines of running text: number from 1, the line without marks, and whether it begins a new paragraph.

    Frontmatter, fenced code, headings, rules and table rows are left out.
    """
    if text[:1] == "﻿":
        text = text[1:]
    lines = text.split("\n")
    skip_to, fence, fresh = 0, "", True
    first = next((i for i, x in enumerate(lines) if x.strip()), 0)
    if lines[first].strip() == "---":
        skip_to = next((i + 1 for i in range(first + 1, len(lines)) if lines[i].strip() in ("---", "...")), 0)
    for i in range(skip_to, len(lines)):
        line = lines[i]
        if fence:
            m = _FENCE.match(line)
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence):
                fence = ""
            continue
        bare = line.strip()
        if not bare:
            fresh = True
            continue
        if ("```" in line or "~~~" in line) and (m := _FENCE.match(line)):
            fence, fresh = m.group(1), True
            continue
        if ("#" in line and _HEADING.match(line)) or ("|" in line and _TABLE.match(line)) or _RULE.match(bare) or _UNDERLINE.match(bare):
            fresh = True
            continue
        if i + 1 < len(lines) and lines[i + 1].startswith("==") and _UNDERLINE.match(lines[i + 1]):
            fresh = True
            continue
        if _ITEM.match(line):
            fresh = True
        line = line[_MARK.match(line).end() :]
        yield i + 1, _NOISE.sub(" ", line) if any(map(line.__contains__, NOISY)) else line, fresh
        fresh = False


def _full(sentence: str) -> bool:
    """Whether it has the letters and words of a full sentence."""
    if not sentence.isascii() and len(_HAN.findall(sentence)) >= LEAST_HAN:
        return True
    letters = 0
    for words, m in enumerate(_WORD.finditer(sentence), 1):
        letters += m.end() - m.start()
        if words >= LEAST_WORDS and letters >= LEAST_LETTERS:
            return True
    return False


def sentences(text: str) -> list[tuple[int, str]]:
    """(line, sentence) of every full sentence of running text; one may go on over lines of a paragraph."""
    out, held, line_of = [], "", 0
    for number, line, fresh in prose(text):
        if fresh:
            held = ""
        at = 0
        for m in _STOP.finditer(line):
            part = line[at : m.end()]
            at = m.end()
            if not held:
                line_of = number
            whole = f"{held} {part}" if held else part
            held = ""
            if _full(whole):
                out.append((line_of, whole))
        tail = line[at:]
        if _WORD.search(tail):
            if not held:
                line_of = number
            held = f"{held} {tail}" if held else tail
    return out


def essence(sentence: str) -> str:
    """A sentence without set-off phrases, if what is left still is a full sentence."""
    if not any(map(sentence.__contains__, ASIDES)):
        return sentence
    rest = _ASIDE.sub(" ", sentence)
    return rest if _full(rest) else sentence


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter or mark; and its script, roughly, as the block of 128 it is in (Latin as one)."""
    letter = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)
    script = (np.arange(0x110000) >> 7).astype(np.uint32)
    script[:0x250] = 0
    script[0x3400:0xA000] = 1
    return letter, script


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of n-grams: slots of all those of letters, words set apart by one blank; weights; and where each text's begin.

    Length 0 is the script of each letter. A Han character says as much as HAN_WEIGHT letters, so a phrase of
    either script weighs what it takes to say.
    """
    letter, script = _tables()
    codes, offsets = K.flatten([f" {x if x.isascii() else unicodedata.normalize('NFC', x)} ".lower() for x in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    blank = ~letter[codes]
    keep = np.ones(len(codes), bool)
    keep[1:] = ~blank[1:] | ~blank[:-1] | (owner[1:] != owner[:-1])
    codes, owner, blank = np.where(blank, np.uint32(32), codes)[keep], owner[keep], blank[keep]
    heavy = script[codes] == 1
    shift = np.uint32(32 - SLOTS.bit_length() + 1)
    scale = np.uint32(0x9E3779B1)

    def gathered(hashes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(hashes)
        weights = np.where(heavy[:n][inside], np.float32(HAN_WEIGHT), np.float32(1))
        return (hashes * scale >> shift)[inside].astype(np.int32), weights, np.searchsorted(owner[:n][inside], np.arange(len(texts) + 1))

    yield gathered((script[codes] + np.uint32(0x200000)) * scale, ~blank)
    running = np.zeros(len(codes), np.uint32)
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        running = (running[:m] + codes[n - 1 :] + np.uint32(n)) * scale
        running ^= running >> np.uint32(15)
        yield gathered(running, ~blank if n == 1 else owner[:m] == owner[n - 1 :])


def fit(texts: list[str], labels: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each slot in each, padded to 8 columns."""
    langs = sorted(set(labels))
    if not langs:
        return langs, np.zeros((SLOTS, 8), np.float32)
    number = np.array([langs.index(x) for x in labels], np.int64)
    counts = np.zeros((SLOTS, len(langs)))
    for slots, _, offsets in features(texts):
        np.add.at(counts, (slots, np.repeat(number, np.diff(offsets))), 1.0)
    share = counts / np.maximum(counts.sum(0), 1) * counts.sum() / max(len(langs), 1)  # languages with more sample text weigh no more
    log = np.log(share + SMOOTHING) - np.log((share + SMOOTHING).sum(0))
    wide = np.zeros((SLOTS, max(8, len(langs))), np.float32)
    wide[:, : len(langs)] = log - log.max(1, keepdims=True)
    return langs, wide


def scores(texts: list[str], matrix: np.ndarray, langs: int) -> np.ndarray:
    """Log likelihood, up to a constant and after OVERLAP, of each text in each language."""
    out = np.zeros((len(texts), langs))
    for lo, hi in K.slices(texts, 100_000):
        for slots, weights, offsets in features(texts[lo:hi]):
            if len(slots):
                found = np.add.reduceat(matrix[slots] * weights[:, None], np.minimum(offsets[:-1], len(slots) - 1), axis=0)
                found[offsets[1:] == offsets[:-1]] = 0
                out[lo:hi] += found[:, :langs] / OVERLAP
    return out


def settle(found: np.ndarray) -> np.ndarray:
    """The language of each sentence of one text: the best one, but for sentences that are in doubt one of those the text surely has."""
    best = found.argmax(1)
    if len(found) < 2 or (best == best[0]).all():
        return best
    ordered = np.sort(found, axis=1)
    margin = ordered[:, -1] - ordered[:, -2]
    sure = np.unique(best[margin >= SURE])
    if not len(sure):
        return np.full(len(found), found.sum(0).argmax())
    among = sure[found[:, sure].argmax(1)]
    behind = found.max(1) - found[np.arange(len(found)), among]
    return np.where(behind <= DOUBT, among, best)


def _confidence(total: np.ndarray, lang: int) -> float:
    weight = np.exp(total - total.max())
    return float(weight[lang] / weight.sum())


def _labeller(model):
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_()]

    def rows_of(docs: list[tuple[int, str, str | None]], langs: list[str], matrix: np.ndarray) -> Iterator[tuple]:
        parts = [sentences(text) if text else [] for _, _, text in docs]
        # texts without a sentence are judged by all their letters
        units = [[essence(s) for _, s in p] or ([t] if t and _WORD.search(t) else []) for p, (_, _, t) in zip(parts, docs, strict=True)]
        found = scores([x for u in units for x in u], matrix, len(langs))
        at = 0
        for (doc, label, _), part, unit in zip(docs, parts, units, strict=True):
            own = found[at : at + len(unit)]
            at += len(unit)
            if not len(own):
                yield doc, label, 0, 0, None, 0.0, 0, False
                continue
            lang = settle(own)
            cuts = np.flatnonzero(np.r_[True, lang[1:] != lang[:-1]])
            mixed = len(cuts) > 1
            for k, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(lang)), strict=True)):
                yield doc, label, k, part[a][0] if mixed else 0, langs[lang[a]], _confidence(own[a:b].sum(0), lang[a]), int(b - a) if part else 0, mixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = model.value
        for batch in batches:
            docs = list(zip(*(batch.column(x).to_pylist() for x in ("doc_id", "lang", "text")), strict=True))
            for lo, hi in K.slices([t or "" for _, _, t in docs], 1_000_000):
                rows = list(rows_of(docs[lo:hi], langs, matrix))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def train(samples: DataFrame, rows: int = SAMPLE_ROWS):
    """The model as a broadcast: SLOTS * 8 floats (2 MB), whatever the samples; from at most ``rows`` of them, in the order of a hash."""
    known = samples.where(F.col("lang").isNotNull() & F.col("sample_text").isNotNull()).select("lang", "sample_text")
    drawn = known.orderBy(F.xxhash64("sample_text"), "lang", "sample_text").limit(rows).collect()
    return samples.sparkSession.sparkContext.broadcast(fit([r.sample_text for r in drawn], [r.lang for r in drawn]))


def segments(documents: DataFrame, samples: DataFrame, model=None) -> DataFrame:
    """Languages of every row: (doc_id, label, segment_no, line_no, lang, confidence, sentences, mixed).

    A text in one language has one row with line_no 0. A text with full sentences in several has one for each
    maximal run of sentences in one language, with the line of its first sentence, from 1. A text without a full
    sentence is judged by all its letters and has ``sentences`` 0; one without letters, an empty or a null one has
    a null language and confidence 0. Headings, frontmatter, tables and code make no segment; set-off foreign
    phrases inside a sentence don't count. ``label`` is the row's ``lang`` as it came. Without samples no row has a
    language. The model is fitted while the plan is built, unless one from ``train`` is given.
    """
    model = model or train(samples)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    if not model.value[0]:
        return rows.selectExpr("doc_id", "lang as label", "0 as segment_no", "0 as line_no", "cast(null as string) as lang", "0d as confidence", "0 as sentences", "false as mixed")
    return spread(rows).mapInArrow(_labeller(model), SEGMENTS)


def label_code(label: Column, langs: Iterable[str], spellings: Mapping[str, str] = SPELLINGS) -> Column:
    """The code of ``langs`` a label means: the code itself or one of its spellings, blank-separated by code; else null."""
    first = F.regexp_extract(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), r"^([^\-_.,;/( ]+)", 1)
    pairs = {name: code for code in langs for name in (*spellings.get(code, "").split(), code.lower())}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), first) if pairs else F.lit(None).cast("string")


def mislabelled(documents: DataFrame, samples: DataFrame, spellings: Mapping[str, str] = SPELLINGS) -> DataFrame:
    """Missing or wrong labels and the segments of mixed texts: (doc_id, line_no, lang), distinct rows.

    A text in one language is a case if its label is null, names no language or another one. A mixed text is a
    case whatever its label, a row for each segment. Texts without a full sentence are no case. The languages are
    those of the samples; a label may be a language's code or one of its ``spellings``.
    """
    model = train(samples)
    found = segments(documents, samples, model).where(F.col("sentences") > 0)
    wrong = ~F.coalesce(label_code(F.col("label"), model.value[0], spellings) == F.col("lang"), F.lit(False))
    return found.where(F.col("mixed") | wrong).select("doc_id", "line_no", "lang").distinct()
