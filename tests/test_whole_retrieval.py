"""Queries on retrieval cover all rows (mining: the stated query set) and whole texts, and so does their SQL."""

import duckdb
from pyspark.sql import functions as F

from querykiln.functions.text import STOP_TOPIC, tokens_topic
from querykiln.operators import bm25
from querykiln.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def by_sql(sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con.sql(sql).fetchall()


def rounded(rows):
    return {(q, d, r): round(s, 5) for q, d, s, r in rows}


def test_queries_by_whole_texts_get_negatives(spark):
    got = rounded(map(tuple, QUERIES["hard_negatives"](spark, SF).collect()))
    want = rounded(by_sql(ORACLE["hard_negatives"], "documents"))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want)
    asked = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 20 = 0 and trim(text) <> ''").select("doc_id").collect()}
    assert {q for q, _, _ in got} == asked


def test_index_reads_its_corpus_once(spark):
    texts = spark.createDataFrame([(i, f"red apples and {i} green pears{i}") for i in range(9)], "doc_idx long, text string")
    index = bm25.Index(texts)
    plan = index.terms._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan and "postings" not in plan and plan.count("Generate") == 0
    assert index.stats.first()["n"] == 9 and abs(index.stats.first()["avgdl"] - 4) < 1e-12
    assert bm25.corpus_stats(texts).first()[:] == index.stats.first()[:]


def test_split_takes_the_whole_text(spark):
    texts = {r[0]: " ".join(r[1].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()}
    rows = spark.createDataFrame(list(texts.items()), "item_id long, t string").select("item_id", tokens_topic(F.col("t"))).collect()
    got = {r.item_id: r for r in QUERIES["split_candidates"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for item, tokens in rows:
        c = [w for w in tokens if w not in STOP_TOPIC]
        raw = [" ".join(c[:n]) for n in (2, 3, 4) if len(c) >= n] + [" ".join(p) for p in zip(c, c[1:])]
        fine = [t for t in dict.fromkeys(raw) if t != texts[item].lower() and all(len(w) > 1 for w in t.split())]
        assert got[item].topic == texts[item] and got[item].candidates == "|".join(fine[:8])
    assert max(len(t.split()) for t in texts.values()) > 8
