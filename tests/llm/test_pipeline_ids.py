"""Stages decide by row: ids that are null or repeated don't save, lose or mix up rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from querykiln.llm import linerules, toxicity

SF = "/root/testdata/sf0.01"


def odd_ids(spark):
    """Documents of which a third have no id and a third share the id 5."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    m = F.col("doc_id") % 3
    return d, d.withColumn("doc_id", F.when(m == 1, F.lit(5)).when(m == 2, F.col("doc_id")).cast("long"))


def texts(df):
    return Counter(r.text for r in df.select("text").collect())


def test_filters_decide_by_row(spark, monkeypatch):
    d, odd = odd_ids(spark)
    field = linerules.learn(odd)
    kept = {r.doc_id for r in linerules.judge(d, field).where("kept").collect()}
    one = P.quality_rules(spark, odd, SF)
    assert texts(one) == texts(d.where(F.col("doc_id").isin(*kept))) and one.columns == d.columns
    model = toxicity.learn(d, spark.read.parquet(f"{SF}/labels.parquet"))
    monkeypatch.setattr(toxicity, "learn", lambda *_: model)
    low = {r.doc_id for r in toxicity.score(d, model).where(F.col("score") < toxicity.THRESHOLD).collect()}
    assert 0 < len(low) < d.count()
    assert texts(P.toxicity_filter(spark, odd, SF)) == texts(d.where(F.col("doc_id").isin(*low)))


def test_dedup_compares_rows_without_ids(spark):
    rng = random.Random(3)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    a, b, c = ("\n".join(line() for _ in range(3)) for _ in range(3))
    rows = [(None, a), (None, a), (None, b), (7, b), (7, c), (7, c), (8, c), (None, None), (None, ""), (9, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.line_dedup(spark, docs, SF)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(9, a), (None, ""), (None, ""), (7, b), (None, ""), (7, c), (7, ""), (8, ""), (None, None), (None, "")])
    got = P.minhash_dedup(spark, docs, SF)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(9, a), (7, b), (7, c), (None, None), (None, "")]) and got.columns == docs.columns
