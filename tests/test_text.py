"""Goldens of the text and JSON scalars, worked out by hand from their rules."""

import pytest
from pyspark.sql import functions as F

from querykiln.functions import judging as J
from querykiln.functions import text as T


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("topic, want", [
    ("law of cosines", ["law cosines"]),
    ("weighted mean inequality proof", ["weighted mean", "weighted mean inequality", "mean inequality", "inequality proof"]),
    ("x axis", []),
    ("x axis reflection", ["axis reflection"]),
    ("", []),
])
def test_split_candidates(spark, topic, want):
    assert one(spark, T.split_candidates("t"), t=topic) == want


@pytest.mark.parametrize("keywords, want", [
    ('"Document Key Topics": "a b, c , a b"', ["a b", "c"]),
    ('"Document Key Topics": a b, c , a b', ["a b", "c"]),
    ('"Document Key Topics": "abc', []),
    ("Document Key Topics: ratio 3:4", ["ratio 3:4"]),
    ("ratio 3:4, x", ["ratio 3:4", "x"]),
])
def test_topics(spark, keywords, want):
    assert one(spark, T.topics_from_keywords("k"), k=keywords) == want


def test_parsers_differ(spark):
    k = '"Document Key Topics": ratio 3:4'
    assert one(spark, T.leakage_terms("k", F.array().cast("array<string>")), k=k) == []
    assert one(spark, T.keyword_phrases("k"), k=k) == ["ratio 3:4"]


def test_leakage(spark):
    assert one(spark, T.has_leakage("q", "t"), q="an outlawofcosines case?", t=["law of cosines"])
    assert not one(spark, T.has_leakage("q", "t"), q="what ratio is it", t=["ratio"])
    assert one(spark, T.phrase_hits("q", "t"), q="What RATIO is it?", t=["ratio"]) == ["ratio"]
    assert one(spark, T.phrase_hits("q", "t"), q="learn c++ now", t=["c++"]) == []


@pytest.mark.parametrize("text, want", [
    ("Question: what is  the mean of two numbers? Explain.", "what is the mean of two numbers?"),
    ("Find the mean of two numbers.", "Find the mean of two numbers?"),
    ("What is it?", None),
    ("", None),
])
def test_clean_query(spark, text, want):
    assert one(spark, T.clean_query("q"), q=text) == want


def test_structure_and_spaces(spark):
    assert one(spark, T.abstract_structure("q"), q="What is 3.5 of x in total?") == "what V NUM V V V total?"
    assert one(spark, T.normalize_ws("q"), q=" a  b\x1cc ") == "a b c"
    assert one(spark, T.strip_quotes("q"), q=' "\'a\'" ') == "a"
    assert one(spark, T.normalize_ws("q"), q=None) == ""


@pytest.mark.parametrize("raw, score", [
    ("84.5", 84), ("85.5", 86), ('" 70.6 "', 71), ("true", 0), ("null", 0), ("150", 100), ("-3", 0), ('"inf"', 0), ("[1]", 0),
])
def test_coerce_int(spark, raw, score):
    v = F.parse_json(F.lit(f'{{"connectivity_score": {raw}}}'))
    assert spark.range(1).select(v.alias("v")).select(J.coerce_int("v")).first()[0] == score


@pytest.mark.parametrize("raw, want", [('"0.7"', 0.7), ("2", 1.0), ('"nan"', 0.5), ("false", 0.5)])
def test_coerce_float(spark, raw, want):
    v = F.parse_json(F.lit(f'{{"confidence": {raw}}}'))
    assert spark.range(1).select(v.alias("v")).select(J.coerce_float("v")).first()[0] == want


@pytest.mark.parametrize("raw, want", [
    ("{}", True), ("nothing", True), ('{"connectivity_score": 0, "reason": ""}', True), ('{"connectivity_score": 0, "reason": "x"}', False),
    ('{"label": "low"}', False), ('{"connectivity_score": "0", "reason": ""}', False), ('{"connectivity_score": false}', True),
])
def test_failure(spark, raw, want):
    assert one(spark, J.is_failure(J.parse_judgement("r")), r=raw) is want


def test_final_score(spark):
    assert round(one(spark, J.final_score(F.lit(70), F.lit(80))), 6) == 78.0
    assert round(one(spark, J.final_score(F.lit(100), F.lit(72))), 6) == 77.6
