"""Scalar functions against values worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.config import Confidence, load_config
from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.functions.segment import DictionarySegmenter, segmented, segmenter
from tidemark.functions.confidence import QueryTime, confidence, query_time, query_time_columns, time_match


def column(spark, expression, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("query", "time"),
    [
        ("2024-03-05 report", (2024, 3, 5)), ("2024年3月5日", (2024, 3, 5)), ("2024年3月", (2024, 3, None)), ("2024年项目", (2024, None, None)),
        ("2024", None), ("hello", None), ("1234-5678", (1234, 56, None)), ("12024-01", (2024, 1, None)),
    ],
)
def test_query_time(spark, query, time):
    assert query_time(query) == (QueryTime(*time) if time else None)
    row = spark.createDataFrame([(query,)], "q string").select(*query_time_columns(F.col("q"))).first()
    assert tuple(row) == (time or (None, None, None))


@pytest.mark.parametrize(("time", "score"), [((2024, 3, 5), 2.0), ((2024, 3, 6), 1.8), ((2024, 4, None), 1.5), ((2022, None, None), 0.4), ((2020, None, None), 0.2)])
def test_time_match(spark, time, score):
    got = column(spark, lambda x: time_match(x, QueryTime(*time)), "2024-03-05", "2024-3-5", "soon")
    assert got == pytest.approx([score, score, 1.0])


def conf(spark, json, as_of=dt.date(2024, 6, 1), time=None):
    df = spark.createDataFrame([(json,)], "j string")
    return df.select(*confidence(F.col("j"), Confidence.shipped(), as_of, time)).first()


@pytest.mark.parametrize(
    ("json", "days", "score"),
    [
        ('{"doc_type":"project","status":"draft","final_date":"%s"}', 730, 0.3382563584147143),
        ('{"doc_type":"official","status":"published","final_date":"%s"}', 0, 0.8919980393051105),
        ('{"doc_type":"blog","status":"已完成","final_date":"%s"}', 365, 0.40212620684264977),
        ('{"doc_type":"blog","status":"已完成","final_date":"%s"}', 100, 0.5981597244906633),
        ("{}", 0, 0.6881346387364011), ("", 0, 0.6881346387364011), ("{broken", 0, 0.6881346387364011), (None, 0, 0.6881346387364011), ("[1]", 0, 0.6881346387364011),
        ('{"doc_type":"blog","status":"已完成","final_date":"2024/01/01"}', 0, 0.40212620684264977),
        ('{"doc_type":null,"status":null}', 0, math.log(2)), ('{"doc_type":["a"],"status":{}}', 0, math.log(2)),
    ],
)
def test_confidence(spark, json, days, score):
    day = dt.date(2024, 6, 1) - dt.timedelta(days)
    assert conf(spark, json % day if json and "%s" in json else json).confidence_score == pytest.approx(score, abs=1e-12)


def test_confidence_of_a_time(spark):
    row = conf(spark, '{"doc_type":"technical","status":"active","final_date":"2024-03-05"}', time=QueryTime(2024, 3, 5))
    assert row.confidence_score == pytest.approx(1.0919233005173132)
    assert row.confidence_reason == "Type:technical(1.1) | Status:active(0.9) | TimeMatch"


def test_text(spark):
    assert column(spark, T.estimated_tokens, "中文ab", "", None) == [1, 0, None]
    assert column(spark, T.clean_query, "网络-优化é!x  y", "", None) == ["网络-优化é x y", "", None]
    assert column(spark, T.match_expression, 'a"b c', "") == ['"a""b" OR "c"', ""]
    assert column(spark, T.terms, "ÉTÉ_x, été 中国联通 2024-01", None) == [["ete", "x", "ete", "中国联通", "2024", "01"], None]
    assert column(spark, T.strip, "　 a b \n") == ["a b"]
    args = ["n.md", "A / B", "B", "project", "x"]
    path, section, title, kind, content = map(F.lit, args)
    assert column(spark, lambda _: T.index_text(path, section, title, F.array(F.lit("net"), F.lit(" "), F.lit("ops")), kind, content), "") == ["n.md n.md A / B B B #net #ops project x"]
    assert segmented("  am 2024-01-05 hier. los ", str.split) == "am 2024-01-05 hier.los"
    assert segmented(" a b ") == "a b"


def test_segmentation(spark):
    words = {"中国": 50, "联通": 40, "中国联通": 1000, "网络": 10, "优化": 10}
    assert DictionarySegmenter(words)("中国联通网络优化 ab-c") == ["中国联通", "网络", "优化", "ab-c"]
    assert DictionarySegmenter({**words, "中国联通": 1})("中国联通x") == ["中国", "联通", "x"]
    assert DictionarySegmenter(words, "search")("中国联通") == ["中国", "联通", "中国联通"]
    assert DictionarySegmenter(words)("") == [] and DictionarySegmenter({"": 1, "甲": 0})("甲乙") == ["甲", "乙"]
    assert segmented("中国联通2024年3月5日网络 . md", segmenter(words)) == "中国联通 2024年3月5日 网络.md"
    assert segmenter(words, "other")("网络优化") == ["网络", "优化"]


def test_globs(spark):
    assert column(spark, lambda x: T.excluded(x, (".*",)), "a/.hidden/x.md", "a/b.md") == [True, False]
    assert column(spark, lambda x: T.excluded(x, ("*.tmp", "d?[ab]*")), "a/b.md", "x/b.tmp", "dxb1/x.md", "dxc/x.md") == [False, True, True, False]
    assert column(spark, lambda x: T.excluded(x, ()), "a") == [False]
    assert column(spark, lambda x: T.in_skipped_dir(x, ("q1",)), "q1/a.md", "a/q1", "a/q1/b.md") == [True, False, True]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [0.5, 0.5]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = df.select(V.l2(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == 5.0 and got[0][1] == 0.0
    assert got[1][1] == pytest.approx(math.sqrt(0.5))
    assert got[2][0] is None


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("vaults:\n  - {path: ~/x, name: ' a ', ex clude: {dirs: [' keep ']}}\nretrieval: {alpha: 0.6, beta: 0.4}\nchunking: {max_tokens: 99}\n")
    c = load_config(str(path))
    assert c.vaults[0].name == "a" and "~" not in c.vaults[0].path and c.vaults[0].exclude.dirs == (" keep ",)
    assert c.chunking.max_tokens == 99 and c.chunking.overlap == 50 and c.retrieval["alpha"] == 0.6
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none"))
    path.write_text("vaults: [")
    with pytest.raises(ValueError):
        load_config(str(path))
