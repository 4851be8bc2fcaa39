"""Pieces of oversized texts: within the limit, covering, overlapping, and cut as a plain loop would."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import kernel as K
from tidemark.llm import split as S

CHUNKS = "id long, content string, content_type string, section_path string, start_pos int, end_pos int, is_deleted boolean, updated_at long, max_tokens int"
LIMITS = "content_type string, max_tokens int, overlap_tokens int, content string"
PARTS = ["a", "word ", "中", "。", "\n", "\r\n", "\n\n", ". ", "e\u0301", "x" * 30, "！", "，", "  ", "👩\u200d🚀"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=120).map("".join), st.integers(3, 40), st.integers(0, 60))
def test_any_text(text, limit, overlap):
    if overlap >= limit:
        with pytest.raises(ValueError):
            S.pieces(text, limit, overlap)
        return
    found = S.pieces(text, limit, overlap)
    if not text:
        assert found == []
        return
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(S.size(text[a:b]) <= limit for a, b in found)
    for (a, b), (c, d) in zip(found[:-1], found[1:], strict=True):
        assert a < c <= b < d and S.size(text[c:b]) <= overlap


def test_doubling_finds_what_a_loop_finds():
    rng = random.Random(5)
    text = "".join(rng.choice(PARTS) for _ in range(5000))
    end, following = S.successors(K.flatten([text])[0], 50, 10)
    at, cuts = 0, []
    while at < len(text):
        cuts.append(at)
        at = int(following[at])
    assert S.greedy_cuts(following).tolist() == cuts
    assert (following[:-1] > np.arange(len(text))).all() and (end[:-1] > np.arange(len(text))).all()


@pytest.mark.parametrize("overlap", [10, 30, 49])
def test_overlap_beyond_half_the_limit(overlap):
    text = "some words of a plain text that goes on " * 60
    found = S.pieces(text, 50, overlap)
    shared = [S.size(text[c:b]) for (_, b), (c, _) in zip(found, found[1:], strict=False)]
    assert max(shared) <= overlap and min(shared) >= 0.6 * overlap and sorted(shared)[len(shared) // 2] >= 0.85 * overlap
    with pytest.raises(ValueError):
        S.pieces(text, 0, 0)


def test_natural_places():
    text = "One two three four five. Six seven eight nine ten. Eleven twelve thirteen. Fourteen fifteen sixteen."
    assert [text[a:b] for a, b in S.pieces(text, 13, 0)] == ["One two three four five. Six seven eight nine ten. ", "Eleven twelve thirteen. Fourteen fifteen sixteen."]
    assert S.size("  中文ab ") == 1 and S.size("") == 0 and S.size(" \n") == 0
    words = "alpha beta gamma delta " * 40
    assert all(words[b - 1] == " " for _, b in S.pieces(words, 20, 5))


def test_table(spark):
    long = "Some words here. " * 400
    rows = [(1, long, "text", "A / B", 100, 200, False, 1), (2, long, "text", None, None, 5, None, 1), (3, long, "text", "R", 0, 1, True, 1), (4, long, "none", "R", 0, 1, False, 1), (5, None, "text", "R", 0, 1, False, 1), (6, "", "text", "R", 0, 1, False, 1), (7, "x", "text", "R", 0, 1, False, 1), (8, long, "text", "R", 0, 1, False, 1), (8, "now short", "text", "R", 0, 1, False, 2), (9, long, None, "R", 0, 1, False, 1), (1, long, "text", "A / B", 100, 200, False, 1), (10, " " * 9000 + "x", "text", "R", 0, 1, False, 1), (11, long, "open", "R", 0, 1, False, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], CHUNKS)
    limits = spark.createDataFrame([("text", 100, 20, "q"), (None, 1, 1, "q"), ("open", None, 3, "q")], LIMITS)
    found = S.oversized_pieces(df, limits).orderBy("chunk_id", "piece_no").collect()
    assert {r.chunk_id for r in found} == {1, 2}
    one = [r for r in found if r.chunk_id == 1]
    assert [r.piece_no for r in one] == list(range(len(one))) and one[0].start_pos == 100 and one[-1].end_pos == 100 + len(long)
    assert all(long[r.start_pos - 100 : r.end_pos - 100] == r.content and r.n_tokens <= 100 and r.section_path == "A / B" for r in one)
    assert [r.start_pos for r in found if r.chunk_id == 2][0] == 0
    assert {tuple(r) for r in S.checked(df, limits).collect()} == {(1, True, True, True), (2, True, True, True)}
    with pytest.raises(ValueError):
        S.oversized_pieces(df, spark.createDataFrame([("text", 10, 10, "q")], LIMITS))
    assert S.oversized_pieces(df.limit(0), limits).count() == 0 and S.oversized_pieces(df, limits.limit(0)).count() == 0
