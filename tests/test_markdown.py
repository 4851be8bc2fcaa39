"""The splitter against a file worked out by hand, and what must hold for any text."""

import datetime as dt
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.config import Chunking
from tidemark.functions.markdown import Splitter, confidence_factors, frontmatter, split_markdown, token_counter

FILE = """---
doc_type: project
status: draft
date: 2024-03-05
tags: [net, ops]
---
# A
intro
## B
- one
- two

after
| h |
|---|
- x
- y
```py
1
```
tail
"""
EXPECTED = [
    ("header", "A", 0, 10, "# A\nintro"), ("header", "A / B", 10, 15, "## B"), ("list", "A / B", 15, 28, "- one\n- two"), ("text", "A / B", 28, 34, "after"), ("table", "A / B", 34, 46, "| h |\n|---|"),
    ("text", "A / B", 46, 50, "- x"), ("list", "A / B", 50, 54, "- y"), ("code", "A / B", 54, 66, "```py\n1\n```"), ("text", "A / B", 66, 71, "tail"),
]


def pieces(text, **options):
    return [(p.content_type, " / ".join(p.path) or "Root", p.start, p.end, p.content) for p in Splitter(Chunking(**options)).split(text)]


def test_file():
    meta, body = frontmatter(FILE)
    assert pieces(body) == EXPECTED
    assert confidence_factors(meta, None, dt.date(2024, 1, 1)) == {"doc_type": "project", "status": "draft", "final_date": "2024-03-05"}


def test_small_cases():
    assert pieces("") == [] and pieces(" \n") == []
    assert pieces("x") == [("text", "Root", 0, 1, "x")]
    assert [p[1] for p in pieces("# A\n### C\n")] == ["A", "A / C"]
    assert pieces("```\n# no\n") == [("code", "Root", 0, 9, "```\n# no")]
    assert frontmatter("---\n---\nx") == ({}, "---\n---\nx")
    assert frontmatter("---\na: [\nb: 'c'\n---\nx") == ({"a": "[", "b": "c"}, "x")
    assert confidence_factors({}, 86400.0, dt.date(2024, 1, 1)) == {"doc_type": "blog", "status": "已完成", "final_date": "1970-01-02"}
    assert confidence_factors({"date": "2024-1-2 10:00"}, 0, dt.date(2024, 1, 1))["final_date"] == "2024-1-2"


def test_long_prose_overlaps_and_long_code_stays():
    text = "".join(f"line {i} of the text.\n" for i in range(200))
    found = Splitter(Chunking(overlap=50)).split(text)
    assert len(found) > 2 and all(a.start < b.start < a.end for a, b in zip(found[:-1], found[1:], strict=True) if b.end > a.end)
    code = "```\n" + "x = 1\n" * 500 + "```\n"
    assert [p.content_type for p in Splitter(Chunking()).split(code)] == ["code"]


def test_other_counter():
    words = Splitter(Chunking(max_tokens=3, overlap=0), lambda x: len(x.split())).split("a b c. d e f. g h.")
    assert [p.content for p in words] == ["a b c.", "d e f.", "g h."]


def test_long_sentence_is_sliced():
    found = Splitter(Chunking()).split("字" * 2000)
    assert [(p.start, p.end) for p in found] == [(0, 691), (691, 1382), (1382, 2000)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# h\n", "text. more\n", "- a\n", "| t |\n", "```\n", "\n", "长" * 90 + "。\n", "w" * 200 + "\n"]), max_size=60))
def test_any_text(lines):
    chunking = Chunking(max_tokens=64, overlap=10)
    count = token_counter(chunking)
    for p in Splitter(chunking).split("".join(lines)):
        assert p.content and p.content_type in ("text", "header", "code", "table", "list") and 0 <= p.start < p.end
        assert count(p.content) <= (64 if p.content_type in ("text", "header") else 128)


def test_table(spark):
    rows = [(1, FILE.replace("\n", "\r\n"), 5.0, "x"), (2, None, None, "x"), (3, "", 1.0, "x"), (4, "---\na: 1\n---\n", 1.0, "x")]
    df = split_markdown(spark.createDataFrame(rows, "file_id long, text string, mtime double, content string")).orderBy("chunk_index")
    got = df.collect()
    assert [(r.content_type, r.section_path, r.start_pos, r.end_pos, r.content) for r in got] == EXPECTED
    assert [r.chunk_index for r in got] == list(range(9)) and {r.file_id for r in got} == {1}
    assert json.loads(got[0].metadata)["tags"] == ["net", "ops"] and got[0].section_title == "A"
