"""Text, link and front matter functions."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import frontmatter as M
from pagewright.functions import links as L
from pagewright.functions import text as X


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in rows.select(f(F.col("v"))).collect()]


def test_tokens(spark):
    got = column(spark, ["Hello, World! 42-times", "注意力", "混合BM25检索", None, "", "你好，世界。！？"], X.tokens)
    assert got == [["hello", "world", "42", "times"], ["注", "意", "力"], ["混", "合", "bm25", "检", "索"], [], [], ["你", "好", "世", "界"]]
    for text, want in zip(["Hello, World! 42-times", "注意力", "混合BM25检索"], got):
        assert X.query_tokens(text) == want


def test_tokenizer_names():
    assert X.mode("auto") == "dictionary" and X.mode("en_stem") == "unigrams"
    with pytest.raises(ValueError):
        X.mode("porter")


def test_dictionary_segmentation(spark):
    freq = dict.fromkeys(["混合", "文本", "检索", "与", "注意力", "机制", "注意", "集群", "容错"], 10.0)
    # fixed values: conformance sentences and their tokens
    assert X.Segmenter(freq)("混合文本BM25检索与注意力机制") == ["混合", "文本", "bm25", "检索", "与", "注意", "注意力", "机制"]
    assert set(X.Segmenter(freq)("集群容错")) <= set(X.Segmenter(freq)("服务器集群容错与故障恢复"))
    assert column(spark, ["注意力", None], X.dictionary_tokens({})) == [["注", "意", "力"], []]


def test_slugs(spark):
    bad = ["../escape", "a/../../escape", "/abs", ".hidden", "file.md", "", None, "a//b"]
    assert column(spark, bad, X.valid_slug) == [False] * len(bad)
    assert column(spark, ["a", "a/b-c", "v1.", "x.y/z"], X.valid_slug) == [True] * 4
    assert column(spark, ["a/b.md", "a/b/index.md", "index.md"], X.slug_of_path) == ["a/b", "a/b", None]
    assert column(spark, ["mixture-of-experts", "a"], X.title_case) == ["Mixture Of Experts", "A"]


def test_scores_and_uris(spark):
    assert column(spark, [-0.256, 0.256, 2.0], X.round2, "double") == [-0.25, 0.26, 2.0]
    got = column(spark, ["wiki://w/a/b", "a/b"], lambda c: X.parse_uri(c, "d"))
    assert [(r.wiki, r.slug) for r in got] == [("w", "a/b"), ("d", "a/b")]
    assert column(spark, ["high", "medium", "low", "7", "-1", "NaN", "x", None], X.confidence) == [0.9, 0.5, 0.2, 1.0, 0.0, None, None, None]


def test_secrets(spark):
    text = "key: ghp_" + "a" * 36 + "\nmail a@b.co and c@d.org\nAKIA" + "A" * 16
    row = X.redact_secrets(spark.createDataFrame([(1, text), (2, "")], "id int, body string"), "id", "body").collect()
    assert row[0].redacted == "key: [REDACTED:github-pat]\nmail [REDACTED:email] and [REDACTED:email]\n[REDACTED:aws-access-key]"
    assert [(m.pattern_name, m.line_number) for m in row[0].matches] == [("github-pat", 1), ("email", 2), ("aws-access-key", 3)]
    assert row[1].matches == []


def test_excerpt():
    body = "x" * 300 + " Router <b> " + "é" * 200
    out = X.excerpt(body, ["router"])
    assert out.startswith("…") and out.endswith("…") and "<b>Router</b>" in out and "&lt;b&gt;" in out
    assert X.excerpt("plain", ["none"]) == "plain" and X.excerpt("", ["a"]) == ""


def test_links(spark):
    body = "[[a/b]] [[ a/b ]] [[c|d]] [x](../concepts/rnn.md) ![i](pic.png) [y](https://e.org) [z](wiki://o/p#q) [m](mailto:a@b.c) [[]]"
    assert L.body_links(body, "concepts") == ["a/b", "c|d", "concepts/rnn", "p"]
    assert L.body_links(None) == [] and L.body_links("[[open") == []
    assert column(spark, [body], L.wikilinks) == [["a/b", "c|d"]]
    assert [L.relative(d, s) for d, s in (("./x.md", "a/b"), ("../x", "a/b"), ("../../../x", "a"), ("..", "a/b"), ("x.md", "a"))] == ["a/b/x", "a/x", "x", "a", "x"]
    got = column(spark, ["wiki://w/a/b", "a/b"], L.classify)
    assert [(r.wiki, r.slug, r.cross) for r in got] == [("w", "a/b", True), (None, "a/b", False)]


def test_frontmatter(spark):
    content = ["---\ntitle: T\n---\n\nBody", "no block", "---\nopen", "---\n---\nempty", "﻿---\r\na: 1\n---\r\nB"]
    assert column(spark, content, M.strip) == ["\nBody", "no block", "---\nopen", "empty", "B"]
    assert column(spark, content, M.error)[:3] == [None, "no frontmatter block found", "no closing --- found"]
    assert M.parse("a: [") == {} and M.parse("- x") == {} and M.parse("d: 2024-01-02") == {"d": "2024-01-02"}
    kinds = {"read_when": "text", "sources": "keyword", "year": "numeric", "flag": "keyword"}
    v = M.page_values({"title": 3, "tags": ["a", 1], "confidence": 2, "sources": ["s", "", 4], "year": 2020, "flag": True, "unknown": "x", "when": "now"}, kinds, {"when": "read_when"})
    assert (v["title"], v["tags"], v["confidence"], v["fields"], v["numeric_vals"], v["text_vals"]) == ("", ["a"], 1.0, {"sources": ["s"], "flag": ["true"]}, {"year": 2020.0}, {"read_when": "now"})
    assert [M.confidence(x) for x in (True, float("nan"), "high", "?", -1, None)] == [None, None, 0.9, None, 0.0, None]
