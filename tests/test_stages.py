"""The command line's stages, end to end on a few rows with table-backed providers."""

import hashlib
import json

from pyspark.sql import functions as F

from querykiln.__main__ import parser, run
from querykiln.operators import stages, synthesis

KINDS = "prompt_hash string, attempt int, raw string"


def lines(spark, path):
    return [json.loads(r.value) for r in spark.read.text(str(path)).collect()]


def answers(spark, path, prompts, raw):
    spark.createDataFrame([(hashlib.sha256(p.encode()).hexdigest(), 0, raw) for p in prompts], KINDS).write.mode("overwrite").parquet(str(path))


def test_stages_chain(spark, tmp_path):
    p = {n: str(tmp_path / n) for n in ("in", "keys", "graph", "synth", "verify", "mine", "answers", "entity", "search", "claim")}
    texts = [f"Tidal waves move sand number{i} along the coast." for i in range(4)]
    (tmp_path / "in").write_text("\n".join(json.dumps({"query": f"why do waves move sand number{i}", "positives": [t]}) for i, t in enumerate(texts)))
    go = lambda *a: run(spark, parser().parse_args(list(a)))
    prompt = lambda c: [r[0] for r in spark.createDataFrame([(t,) for t in texts], "pos string").select(c).collect()]

    answers(spark, p["answers"], prompt(synthesis.keyphrase_prompt("pos")), "Document Key Topics: blue coast")
    go("keys", "--input", p["in"], "--output", p["keys"], "--responses", p["answers"])
    assert [r["keywords"] for r in lines(spark, p["keys"])] == ["Document Key Topics: blue coast"] * 4

    spark.createDataFrame([("Q1", "blue coast", "", [], False), ("Q2", "sand", "", [], False)], "qid string, label string, description string, aliases array<string>, missing boolean").write.parquet(p["entity"])
    spark.createDataFrame([("blue coast", "Q1", "label", 1)], "text_norm string, qid string, match_type string, rank int").write.parquet(p["search"])
    spark.createDataFrame([("Q1", "P361", 0, "item", "Q2")], "src string, prop string, claim_ord long, value_type string, dst string").write.parquet(p["claim"])
    go("subgraph", "--input", p["keys"], "--output", p["graph"], "--entity", p["entity"], "--search", p["search"], "--claim", p["claim"])
    got = lines(spark, p["graph"])[0]["subgraphs"][0]
    assert got["status"] == "ok" and got["seed"] == "Q1" and [e["dst"] for e in got["edges"]] == ["Q2"]

    seen = F.array(F.lit("- blue coast, hidden (never name it): blue coast"), F.lit("  - hidden → is part of sand"))
    answer = [{"query": "Why do waves carry sand along?", "used_neighbors": ["Sand", "stone"], "used_edge_ids": [0, "0", 7]}]
    answers(spark, p["answers"], prompt(synthesis.generation_prompt(F.col("pos"), seen, F.array(F.lit("blue coast")))), json.dumps(answer))
    go("synth", "--input", p["graph"], "--output", p["synth"], "--responses", p["answers"])
    made = [r["generated_queries"][0] for r in lines(spark, p["synth"])]
    assert all(g["query"] == "Why do waves carry sand along?" and g["used_neighbors"] == ["Sand"] and g["used_edge_ids"] == [0] for g in made)
    assert all(g["used_edges"] == [{"src": "blue coast", "prop": "P361", "dst": "sand", "label": "part of"}] for g in made)
    assert stages.synthesis_counters(spark.read.json(p["graph"])).first()[:] == (4, 4, 4, 0)
    assert stages.synthesis_counters(spark.read.json(p["graph"]), extra=0).first()[:] == (4, 0, 4, 0)

    answers(spark, p["answers"], prompt(synthesis.judging_prompt(F.col("pos"), F.lit("Why do waves carry sand along?"))), '{"connectivity_score": 90, "reason": "fits"}')
    for _ in range(2):  # the second run finds all rows done
        go("verify", "--input", p["synth"], "--output", p["verify"], "--responses", p["answers"])
    done = lines(spark, p["verify"])
    assert len(done) == 4 and all(r["selected_query"] and r["note"] == "clean" for r in done)

    go("mine", "--input", p["verify"], "--output", p["mine"], "--n-neg", "2")
    mined = lines(spark, p["mine"])
    assert all(len(r["negative_passages"]) == 2 and r["pos"] not in [n["text"] for n in r["negative_passages"]] for r in mined)
    rows = spark.read.json(p["mine"])
    assert stages.counters(rows).first()[:] == (4, 4, 0)
