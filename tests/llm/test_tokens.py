"""The transducer against the library's own encoding, and back."""

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tokens as T

pytestmark = pytest.mark.skipif(not Path(T.VOCABULARY).exists(), reason="vocabulary is not here")
TEXT = st.text(st.sampled_from("ab zZ09'!.\n\t 水泵灯é\u0301ñß🚀👩\u200d\u3000s"), max_size=400)


@pytest.fixture(scope="module")
def vocabulary():
    return Path(T.VOCABULARY).read_bytes()


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 40))
def test_any_blocks_give_the_same_ids(text, block):
    machine = T.transducer(Path(T.VOCABULARY).read_bytes(), 1, block)
    expected = machine.core.encode_ordinary(text)
    assert machine.encode(text) == expected
    assert "".join(machine.decode(expected, block=3)) == text


@pytest.mark.parametrize("piece", ["a" * 60_000, " " * 40_000 + "x", "中文字符" * 9_000, "x" * 10 + "\n" * 30_000 + "1234567890" * 3_000, "''" * 9_000 + "'s't" * 300, "=-" * 20_000])
@pytest.mark.parametrize("block", [64, 10_000])
def test_pieces_longer_than_the_window(vocabulary, piece, block):
    machine = T.transducer(vocabulary, 1, block)
    assert machine.encode(piece) == machine.core.encode_ordinary(piece)
    raw = piece.encode()
    assert [i for ids in machine.merge_stream(raw) for i in ids] == machine._merge(raw)


def test_random_letters_in_windows(vocabulary):
    rng = random.Random(0)
    machine = T.transducer(vocabulary, 1)
    assert 1_000 < machine.lookahead < machine.window < 4 * machine.lookahead
    for alphabet in ("abcdefghij", "ab", "theandingion"):
        raw = "".join(rng.choice(alphabet) for _ in range(60_000)).encode()
        runs = list(machine.merge_stream(raw))
        assert len(runs) > 5 and [i for ids in runs for i in ids] == machine._merge(raw)


def merges(rng, size):
    """A made-up merge list: every token is two earlier ones put together."""
    tokens = [b"a", b"b", b"c"]
    while len(tokens) < size:
        new = rng.choice(tokens) + rng.choice(tokens)
        if new not in tokens and len(new) < 9:
            tokens.append(new)
    return {t: i for i, t in enumerate(tokens)}


def merged(raw, ranks):
    """Merging by the book: the pair of least rank first, the leftmost of equal ones."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_lookahead_of_made_up_merge_lists(seed):
    rng = random.Random(seed)
    ranks = merges(rng, 40)
    machine = object.__new__(T.Transducer)
    machine.bytes_of = {i: t for t, i in ranks.items()}
    machine.lookahead = T.sufficient_lookahead(ranks)
    machine.window = machine.lookahead + 2 * max(map(len, ranks))
    machine._merge = lambda raw: merged(raw, ranks)
    assert machine.lookahead >= max(map(len, ranks))
    for _ in range(6):
        raw = bytes(rng.choice(b"abc") for _ in range(machine.window * 3))
        assert [i for ids in machine.merge_stream(raw) for i in ids] == merged(raw, ranks)


def test_lookahead_of_chains():
    # "ab" waits for "bc", which waits for "cd", each of a higher priority than the one before
    assert T.sufficient_lookahead({b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"cd": 4, b"bc": 5, b"ab": 6}) == 4
    assert T.sufficient_lookahead({b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"ab": 4, b"bc": 5, b"cd": 6}) == 2
    assert T.sufficient_lookahead({b"a": 0}) == 1


def test_memory_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 10)
    machine = T.Transducer(dict(T.transducer(vocabulary).core._mergeable_ranks))
    text = " ".join(f"word{i} {i * 7}" for i in range(300)) + "z" * 100
    assert machine.encode(text) == machine.core.encode_ordinary(text) and len(machine.pieces) <= 10


def test_table(spark):
    rows = [(1, "Hello world", [5]), (2, None, None), (3, "", None), (4, "<|endoftext|>", None), (1, "Hello world", None), (None, "x", None), (5, "词 " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = T.token_ids(df).collect()
    assert len(got) == 7 and dict(got[0].asDict()) == {"doc_id": 1, "ids": [15496, 995]}
    assert [r.ids for r in got if r.doc_id in (2, 3)] == [[], []] and 50256 not in got[3].ids
    assert all(r.same for r in T.round_trip(df).collect())
    assert T.token_ids(df.limit(0)).count() == 0
