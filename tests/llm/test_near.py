"""Near-duplicates against all pairs compared one by one."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tidemark.llm import kernel as K
from tidemark.llm import near as N

SCHEMA = "id long, content string, is_deleted boolean, updated_at long, a string, text_class string"
TOKEN = regex.compile(r"[\u4E00-\u9FFF]|(?:(?![\u4E00-\u9FFF])[\p{L}\p{N}])+")
FOLD = regex.compile(r"[^\p{L}\p{N}]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows, words=3, threshold=0.5, least=40):
    now = {}
    for i, text, gone, at in rows:
        if i is not None and (i not in now or (at or -1) > (now[i][2] or -1)):
            now[i] = (text, gone, at)
    sets, folds = {}, {}
    for i, (text, gone, _) in now.items():
        if gone or text is None:
            continue
        t = TOKEN.findall(text.lower())
        if len(t) >= least:
            sets[i], folds[i] = {tuple(t[k : k + words]) for k in range(len(t) - words + 1)}, FOLD.sub("", text.lower())
    return {(a, b) for a in sets for b in sets if a < b and folds[a] != folds[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed=3, families=25):
    rng, rows, number = random.Random(seed), [], 0
    vocabulary = [f"w{i}" for i in range(400)] + list("水泵灯塔书架转轮管道温室")
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            number += 1
            rows.append((number, rng.choice([" ", ", ", "\n"]).join(words), rng.random() < 0.05, 1))
    return rows


def test_like_all_pairs(spark):
    rows = corpus()
    rows += [(1, rows[0][1] + " late", False, 0), (2, rows[1][1], rows[1][2], 1), (900, None, False, 1), (901, "", False, 1), (902, "short text", None, 1), (903, rows[5][1].upper(), None, 1), (904, rows[5][1].replace(" ", "; "), False, 1), (None, rows[5][1], False, 1)]
    expected = brute(rows)
    got = {tuple(r) for r in N.similar_pairs(table(spark, rows)).collect()}
    assert len(expected) > 30 and got <= expected and len(got) >= 0.98 * len(expected)


def test_no_rows(spark):
    assert N.similar_pairs(table(spark, [])).count() == 0
    assert N.similarity_classes(table(spark, [(1, "short", False, 1)])).count() == 0


def test_many_copies_cost_no_pairs(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base + "." * (i % 7), False, 1) for i in range(600)] + [(1000, base + " more words at the end", False, 1), (1001, base.replace("w30", "other"), False, 1)]
    got = {tuple(r) for r in N.similar_pairs(table(spark, rows)).collect()}
    assert got == {(i, j) for i in range(600) for j in (1000, 1001)} | {(1000, 1001)}
    classes = {r.chunk_id: (r.class_id, r.n_links) for r in N.similarity_classes(table(spark, rows)).collect()}
    assert classes[599] == (0, 2) and classes[1001] == (1001, 2) and len(classes) == 602


def test_same_shingles_in_other_texts(spark):
    part = " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"{part} {part} {part}", False, 1), (2, f"{part} {part}", False, 1)]
    assert [tuple(r) for r in N.similar_pairs(table(spark, rows)).collect()] == [(1, 2)] and brute(rows) == {(1, 2)}


def test_exact_finds_all(spark):
    rows = corpus(8, 60)
    assert {tuple(r) for r in N.similar_pairs(table(spark, rows), exact=True).collect()} == brute(rows)


def test_links_of_classes(spark):
    rows = corpus(9, 40)
    sets = {i: frozenset(zip(*(TOKEN.findall(x.lower())[k:] for k in range(3)), strict=False)) for i, x, gone, _ in rows if not gone and len(TOKEN.findall(x.lower())) >= 40}
    first = {s: min(i for i, o in sets.items() if o == s) for s in sets.values()}
    links = {i: sum(o != s and len(s & o) >= 0.5 * len(s | o) for o in first) for i, s in sets.items()}
    got = {r.chunk_id: (r.class_id, r.n_links) for r in N.similarity_classes(table(spark, rows)).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: first[s] for i, s in sets.items()}
    assert all(n <= links[i] for i, (_, n) in got.items()) and sum(n for _, n in got.values()) >= 0.98 * sum(links.values()) > 0


def test_every_two_entries_meet_once():
    rng = np.random.default_rng(0)
    tasks = N.Tasks.of(4, {1: 100, 3: 41}, 20)
    assert tasks.parts.tolist() == [1, 5, 1, 3] and tasks.first.tolist() == [0, 1, 16, 17]
    bucket, classes = rng.integers(0, 4, 300), np.arange(300)
    met: dict = {}
    for at, task, cross, side in tasks.spread(bucket, classes):
        for i, t, c, s in zip(at.tolist(), task.tolist(), cross.tolist(), side.tolist(), strict=True):
            met.setdefault(t, []).append((i, c, s))
    pairs = [(min(i, j), max(i, j)) for m in met.values() for i, c, s in m for j, _, o in m if i < j and (not c or s != o)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, j) for i in range(300) for j in range(i + 1, 300) if bucket[i] == bucket[j]}
    assert all(len({c for _, c, _ in m}) == 1 for m in met.values())


def hot(n, run):
    """Band entries of n texts, those of the first ``run`` texts with one key in band 0; every tenth has the bits of the one before."""
    rng = np.random.default_rng(0)
    bands = rng.integers(0, 2**32, (n, N.BANDS), dtype=np.uint32).astype("<u4")
    bands[:run, 0] = 7
    bits = rng.integers(0, 2**63, n, dtype=np.int64)
    bits[9::10] = bits[8::10][: len(bits[9::10])]
    words = np.stack([bits, bits, bits], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([x.tobytes() for x in bands], pa.binary()), pa.array([x.tobytes() for x in words], pa.binary())], names=["text_class", "bands", "bits"])


def test_one_band_of_fifty_thousand_texts():
    n, buckets = 50_000, 64
    batch = hot(n, n)
    sizes = next(N._counter(buckets, True)([batch]))
    large = {b: k for b, k in zip(sizes.column("bucket").to_pylist(), sizes.column("n").to_pylist(), strict=True) if k > 2 * (n * N.BANDS // buckets) // 2 + n // 2}
    assert len(large) == 1
    tasks = N.Tasks.of(buckets, large, N.HOT // 8)
    (bucket,) = large
    own = range(int(tasks.first[bucket]), int(tasks.first[bucket] + tasks.parts[bucket] * (tasks.parts[bucket] + 1) // 2))
    rows = [pa.Table.from_batches([x]) for x in N._banded(tasks, True)([batch])]
    mine = pa.concat_tables(rows).sort_by("task")
    mine = mine.filter(pc.is_in(mine["task"], pa.array(own, pa.int32())))
    held = pc.sum(pc.binary_length(mine["entries"])).as_py() / N.ENTRY.itemsize
    assert held == sum(large.values()) * tasks.parts[bucket] and len(own) > 10
    # every pair of equal bits comes out, whichever parts its texts are in
    got = set()
    for out in N._matcher(0.95, 0.01)(mine.select(["task", "is_cross", "side", "entries"]).to_batches()):
        got |= set(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
    assert {(i, i + 1) for i in range(8, n - 1, 10)} <= got


def test_split_buckets_lose_nothing(spark, monkeypatch):
    rows = corpus(4, 30)
    monkeypatch.setattr(N, "HOT", 8)
    monkeypatch.setattr(N, "BUCKET", 1 << 20)
    real = N.Tasks.of
    seen = []
    monkeypatch.setattr(N.Tasks, "of", classmethod(lambda cls, buckets, large, part: seen.append(buckets) or real(buckets, {b: 60 for b in range(buckets)}, 20)))
    got = {tuple(r) for r in N.similar_pairs(table(spark, rows)).collect()}
    assert seen and got <= brute(rows) and len(got) >= 0.98 * len(brute(rows))


def test_pruning_keeps_what_can_reach_the_threshold():
    rng = np.random.default_rng(1)

    def kept(similarity, n=20_000):
        same = rng.random((n, 192)) < similarity
        left = rng.integers(0, 2, (n, 192), dtype=np.uint8)
        right = np.where(same, left, rng.integers(0, 2, (n, 192), dtype=np.uint8))
        x, y = (np.packbits(v, axis=1, bitorder="little").view("<u8") for v in (left, right))
        near = N.prune(x[:, 0].copy(), y[:, 0].copy(), 0.5, N.TOLERANCE)
        return len(near) / n, len(N.prune_further(x[near], y[near], 0.5, N.TOLERANCE)) / n

    assert kept(0.5)[1] > 0.98 and kept(0.7)[1] > 0.9999 and kept(0.02)[0] < 0.2 and kept(0.02)[1] < 0.001


def test_shingles():
    texts = ["a b c d", "", "水 b水c", "x"]
    hashes, owner = K.token_hashes(*K.flatten(texts))
    assert owner.tolist() == [0, 0, 0, 0, 2, 2, 2, 2, 3]
    assert hashes[4] == hashes[6] and hashes[1] == hashes[5] and hashes[2] == hashes[7]
    assert K.shingles(hashes, owner, 3)[1].tolist() == [0, 0, 2, 2]
