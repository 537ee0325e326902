import json

import pytest
from pyspark.sql import functions as F

from querykiln.functions import judging as J
from querykiln.functions.sqlfuncs import register
from querykiln.operators import bm25, graph, selection, synthesis
from querykiln.sources import jsonl, providers
from querykiln.streaming.incremental import run_incremental


def corpus(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string")


@pytest.mark.parametrize("query, want", [("gamma alpha", {1: 1.097666383, 0: 0.200353359}), ("gamma gamma alpha", {1: 2.028065283, 0: 0.200353359})])
def test_bm25(spark, query, want):
    index = bm25.Index(corpus(spark, "alpha beta", "alpha gamma gamma"))
    got = bm25.top_k(index, spark.createDataFrame([(0, query)], "qid long, query string"))
    assert {r.doc_idx: round(r.score, 9) for r in got.collect()} == want


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(500).select((F.col("id") * 7 % 1000).alias("row_ord"), F.concat(F.lit("t"), (F.col("id") % 300).cast("string")).alias("text"))
    got = bm25.number_corpus(bm25.dedup_corpus(df)).orderBy("doc_idx").collect()
    assert [r.doc_idx for r in got] == list(range(300))
    assert [r.first_ord for r in got] == sorted(r.first_ord for r in got)
    assert bm25.number_corpus(bm25.dedup_corpus(df.limit(0))).count() == 0


def test_mining_excludes_the_positive_and_keeps_rows(spark):
    rows = spark.createDataFrame([(i, f"topic{i % 3} word", f"topic{i % 3} word text number{i}") for i in range(9)] + [(9, "zzz", "unique"), (10, "", "empty query")], "row_ord long, query string, pos string")
    got = {r.row_ord: r for r in bm25.mine(rows, top=50, n_neg=4).collect()}
    assert len(got) == 11
    for r in got.values():
        assert r.pos not in [n.text for n in r.negative_passages or []]
        assert len(r.negative_passages or []) <= 4
    assert got[9].negative_passages is None and got[10].negative_passages is None


def test_candidate_cap_plans_without_cartesian(spark):
    index = bm25.Index(corpus(spark, "alpha beta", "alpha gamma"))
    plan = bm25.top_k(index, spark.createDataFrame([(0, "alpha")], "qid long, query string"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "WindowGroupLimit" in plan and "BatchEvalPython" not in plan


def evals(spark, *rows):
    """rows: (id, connectivity, hits, failed)."""
    e = spark.createDataFrame([("r", i, f"q{i}", c, h, f) for i, c, h, f in rows], "row_uid string, candidate_id int, query string, connectivity_score int, n_hits int, judge_failed boolean")
    from querykiln.functions.text import score_of_hits

    return selection.flags(e.withColumns({"keyword_score": score_of_hits("n_hits"), "clean": F.col("n_hits") == 0, "confidence": F.lit(0.5)}))


@pytest.mark.parametrize("rows, note, chosen", [
    ([(0, 80, 1, False), (1, 72, 0, False)], "clean", 1),
    ([(0, 80, 1, False), (1, 69, 0, False)], "usable", 0),
    ([(0, 44, 1, False), (1, 40, 0, False)], "all_candidates_weak", None),
    ([(0, 90, 0, True), (1, 80, 0, True)], "no_candidates", None),
    ([(0, 80, 0, False), (1, 80, 0, False)], "clean", 0),
])
def test_decision(spark, rows, note, chosen):
    e = evals(spark, *rows)
    r = selection.finalize(e, e).first()
    assert (r.note, r.selected_candidate_id, len(r.candidate_evaluations)) == (note, chosen, len(rows))


def test_accept_caps_types(spark):
    raw = json.dumps([{"query": f"Find the {w} effect on the {w} result"} for w in ("solar", "lunar", "tidal", "magnetic", "thermal")])
    got = spark.range(1).select(synthesis.accept(J.parse_output(F.lit(raw)), F.array().cast("array<string>"))).first()[0]
    assert len(got) == 3 and all(q.reasoning_type == "analytical" for q in got)


def test_reverse_edges(spark):
    claim = spark.createDataFrame([("A", "P527", 0, "item", "B"), ("B", "P361", 0, "item", "A"), ("C", "P361", 0, "item", "A"), ("A", "P31", 1, "text", "x")], "src string, prop string, claim_ord long, value_type string, dst string")
    entity = spark.createDataFrame([(q, q.lower(), "", [], False) for q in "ABC"], "qid string, label string, description string, aliases array<string>, missing boolean")
    seed = spark.createDataFrame([("A",)], "qid string")
    near = graph.neighbours(seed, claim)
    node = graph.nodes(seed, near, entity)
    got = {(r.src, r.dst, r.direction) for r in graph.edges(seed, near, node, claim).collect()}
    assert got == {("A", "B", "outgoing"), ("B", "A", "incoming")}
    assert [(r.qid, r.relation, r.arrow) for r in graph.relations(node, graph.edges(seed, near, node, claim)).collect()] == [("B", "has part", "→")]
    picks = graph.sample_neighbours(graph.relations(node, graph.edges(seed, near, node, claim)), 5)
    assert picks.count() == 1


def test_candidates_keep_first_ids(spark):
    rows = spark.createDataFrame([("r", [" ", "A b", "a  B", None, "c", "d"])], "row_uid string, queries array<string>")
    assert [(r.candidate_id, r.query) for r in selection.candidates(rows).orderBy("candidate_id").collect()] == [(1, "A b"), (4, "c")]


def test_jsonl_modes_and_positives(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    lines = [{"query": "a", "positives": [{"text": "x"}]}, {"query": "b", "positive": "y"}, {"query": "c", "positive passages": [["i", "z"]]}, {"query": "d", "positive_passages": {"text": "w"}}, {"query": "e"}]
    path.write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n")
    got = jsonl.records(jsonl.read_jsonl(spark, str(path))).orderBy("row_ord").collect()
    assert [(r.query, r.pos, r.error) for r in got] == [("a", "x", None), ("b", "y", None), ("c", "z", None), ("d", "w", None), ("e", None, "positive")]
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(path), "strict").collect()
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, str(path), "other")


def test_write_resume(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(0, "r1", None), (1, "r2", "ü"), (2, "r2", "b"), (3, "r3", "c")], "row_ord long, _row_uid string, x string")
    jsonl.write_jsonl(rows.limit(1), out)
    assert json.loads(spark.read.text(out).first()[0]) == {"_row_uid": "r1", "x": None}
    fresh = jsonl.unprocessed(rows, jsonl.processed_uids(spark, out))
    assert [r.row_ord for r in fresh.orderBy("row_ord").collect()] == [1, 3]
    jsonl.write_jsonl(fresh, out, mode="append")
    assert jsonl.unprocessed(rows, jsonl.processed_uids(spark, out)).count() == 0


def test_providers(spark):
    rows = spark.createDataFrame([("u", "some text", ["x"], ["a → b"], [])], "row_uid string, pos string, terms array<string>, graph_lines array<string>, labels array<string>")
    answer = json.dumps({"queries": [{"query": "What is the reason for this text?"}]})

    def make():
        return lambda prompts, attempt: [answer if attempt else "junk" for _ in prompts]

    got = synthesis.synthesize(rows, providers.FunctionProvider(make)).first()
    assert [q.query for q in got.generated_queries] == ["What is the reason for this text?"]
    table = spark.createDataFrame([("h", 0, "r")], "prompt_hash string, attempt int, raw string")
    assert providers.TableProvider(table).answer(spark.createDataFrame([("p",)], "prompt string")).first().raw is None
    calls = iter([(503, None), (200, "ok")])
    assert providers.with_retries(lambda: next(calls), sleep=lambda _: None) == "ok"
    with pytest.raises(RuntimeError):
        providers.with_retries(lambda: (404, None), sleep=lambda _: None)


def test_incremental_runs_once(spark, tmp_path):
    src, ck, out = (str(tmp_path / x) for x in ("src", "ck", "out"))
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "_row_uid string, x int")
    df.write.parquet(src)
    for _ in range(2):
        run_incremental(spark, src, "_row_uid string, x int", ck, out, lambda b: b.withColumn("y", F.col("x") * 2))
    df.write.mode("append").parquet(src)
    run_incremental(spark, src, "_row_uid string, x int", ck, out, lambda b: b.withColumn("y", F.col("x") * 2))
    assert sorted((r._row_uid, r.y) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 4)]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT qk_compact('A b-1'), qk_norm_lower('  A\tB ')").first()[:] == ("ab1", "a b")


def test_partitions_do_not_matter(spark):
    docs = corpus(spark, *(f"word{i % 7} common text{i}" for i in range(60)))
    q = spark.createDataFrame([(0, "word3 common"), (1, "text5")], "qid long, query string")
    got = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted((r.qid, r.doc_idx, r.rank) for r in bm25.top_k(bm25.Index(docs.repartition(n)), q, 5).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1]
