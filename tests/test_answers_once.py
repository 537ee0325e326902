"""Answers are parsed once each, by as many tasks as there are cores."""

from pyspark.sql import functions as F

from querykiln.functions import judging as J
from querykiln.operators import synthesis
from querykiln.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_an_answer_is_parsed_once(spark):
    rows = spark.createDataFrame([('x {"items": [{"query": "What is in the red box?", "type": "causal"}, {"query": "What is in the red box?"}]}',)], "raw string")
    got = rows.select(synthesis.accept(J.parse_output("raw"), F.array(F.lit("blue"))).alias("ok"))
    assert [(q["query"], q.reasoning_type) for q in got.first().ok] == [("What is in the red box?", "causal")]
    plan = got._jdf.queryExecution().analyzed().toString()
    assert 1 <= plan.count("parse_json") <= 4 and 1 <= plan.count("$.items") <= 4, plan  # of the whole text and of its braces


def test_answers_are_dealt_to_all_cores(spark):
    assert QUERIES["collect_queries"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
