"""Languages: held-out samples, segments, labels, and texts that are no prose."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import language as L

DATA = Path("/root/testdata/sf0.001/lang_samples.parquet")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
EN = "The old sensor covered the bridge near the harbor."
DE = "Die alte Lampe stand neben dem Hafen und der Brücke."
ZH = "冰冷罗盘的向量和空置抽屉都需要部分连接。"
FR = "Le vieux capteur a couvert le pont près du port."


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(str(DATA))


def found(spark, samples, *rows):
    df = spark.createDataFrame([(i, t, lang, "x", 1) for i, lang, t in rows], "doc_id long, text string, lang string, label string, line_no int")
    return sorted(map(tuple, L.mislabelled(df, samples).collect()))


def test_held_out(samples):
    rows = sorted(map(tuple, samples.select("lang", "sample_text").collect()), key=lambda r: hash(r[1]) % 1009)
    langs, matrix = L.fit([t for _, t in rows[::2]], [lang for lang, _ in rows[::2]])
    best = L.scores([t for _, t in rows[1::2]], matrix, len(langs)).argmax(1)
    assert sum(langs[b] == lang for b, (lang, _) in zip(best, rows[1::2], strict=True)) / len(best) >= 0.98


def test_labels(spark, samples):
    good = ["en", "EN", " en", "en_US", "en-GB", "eng", "English"]
    assert found(spark, samples, *((i, x, EN) for i, x in enumerate(good))) == []
    bad = [None, "", "??", "n/a", "und", "de", "zh-CN", "xx", "Klingon"]
    assert found(spark, samples, *((i, x, EN) for i, x in enumerate(bad))) == [(i, 0, "en") for i in range(len(bad))]
    codes = spark.createDataFrame([("zh_Hans",), ("Chinese",), ("pt-BR",), ("deu",), ("de-AT",), (None,)], "x string").select(L.label_code(F.col("x"), list(L.SPELLINGS))).collect()
    assert [r[0] for r in codes] == ["zh", "zh", "pt", "de", "de", None]


def test_a_language_of_the_samples_is_no_wrong_label(spark, samples):
    finnish = ["Vanha anturi peitti sillan sataman lähellä.", "Jokainen lamppu seisoi hyllyn vieressä koko yön.", "Kukaan ei huomannut, että venttiili oli suljettu aamulla.", "Korjasimme hitaasti kaikki pumput ennen talvea."]
    more = samples.select("lang", "sample_text").unionByName(spark.createDataFrame([("fi", x) for x in finnish for _ in range(15)], "lang string, sample_text string"))
    rows = [(1, "fi", finnish[0]), (2, "Suomi", finnish[1]), (3, "en", finnish[2]), (4, "en", EN)]
    assert found(spark, more, *rows) == [(2, 0, "fi"), (3, 0, "fi")]
    df = spark.createDataFrame([(2, finnish[1], "Suomi")], "doc_id long, text string, lang string")
    assert L.mislabelled(df, more, {"fi": "suomi finnish"}).count() == 0


def test_segments(spark, samples):
    text = f"\ufeff---\ntitle: {DE}\n---\n# {DE}\n{EN} {EN}\r\n\n- [ ] {DE}\n> {ZH}{ZH}\n\n| {FR} | {FR} |\n```\n{FR}\n```\n{ZH}\n1. {EN} 🚀\n{FR}"
    assert found(spark, samples, (1, "en", text)) == [(1, 5, "en"), (1, 7, "de"), (1, 8, "zh"), (1, 15, "en"), (1, 16, "fr")]


def test_foreign_phrases_make_no_segment(spark, samples):
    assert found(spark, samples, (1, "zh", f"审核期间，灰色清单连夜连接了备用货架 (la cale de la passerelle)。\n{ZH}"), (2, "en", f"The kiln stood «{ZH}» near the old harbor. {EN}"), (3, "en", f"# {DE}\n{EN}\n## {FR}\n")) == []


def test_no_sentence(spark, samples):
    rows = [(1, None, None), (2, None, ""), (3, None, " \n"), (4, None, "```\ncode here. And more of it.\n```"), (5, None, "12 34 5.6 ???"), (6, None, "# Only a heading"), (7, "de", "---"), (8, None, "a: b\n")]
    assert found(spark, samples, *rows) == []
    df = spark.createDataFrame([(i, x, t) for i, x, t in rows], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in L.segments(df, samples).collect()}
    assert len(got) == 8 and got[1].lang is None and got[1].confidence == 0.0 and got[6].lang == "en" and got[6].sentences == 0


def test_confidence_long_and_empty_tables(spark, samples):
    df = spark.createDataFrame([(1, "en", f"{EN} " * 5000), (1, "en", EN)], "doc_id long, lang string, text string")
    got = L.segments(df, samples).collect()
    assert [(r.lang, r.mixed, r.line_no) for r in got] == [("en", False, 0)] * 2 and all(0.9 < r.confidence <= 1 for r in got)
    assert L.segments(df.limit(0), samples).count() == 0
    assert [r.lang for r in L.segments(df, samples.limit(0)).collect()] == [None, None]


def test_sentence_over_lines():
    assert [x[0] for x in L.sentences("The old sensor covered\nthe bridge near the harbor.\nAnother line of words here.\n\nno end of it")] == [1, 3]
