"""Candidate synthesis: prompts, acceptance of generated queries, rounds of retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querykiln.functions.judging import edge_ids, parse_output, reasoning_type
from querykiln.functions.text import abstract_structure, bound, clean_query, has_leakage, normalize_compact, one_line, truncate_sentence

CAP = 5


def keyphrase_prompt(text: str | Column) -> Column:
    return F.concat(F.lit("Name the main topics of this document, most specific first, as one comma-separated line after 'Document Key Topics:'.\n\nDocument:\n"), truncate_sentence(text, 12_000))


def generation_prompt(pos, graph_lines, forbidden) -> Column:
    """graph_lines: array of lines about linked concepts; forbidden: terms a query must not name (six shown)."""
    graph = F.when(F.size(graph_lines) > 0, F.concat(F.lit("\nLinked concepts (arrow from subject to object):\n"), F.array_join(graph_lines, "\n"))).otherwise("")
    names = F.when(F.size(forbidden) > 0, F.concat(F.lit("\nDo not use these names: "), F.array_join(F.slice(forbidden, 1, 6), "; "))).otherwise("")
    ask = F.lit('\nWrite five questions of mixed length and type (analytical, causal, deductive, analogical) that this document answers. Answer with one line of JSON: {"queries": [{"query": "", "type": "", "used_neighbors": [], "used_edge_ids": []}]}')
    return F.concat(F.lit("Document:\n"), truncate_sentence(pos, 800), graph, names, ask)


def judging_prompt(pos, query) -> Column:
    return F.concat(F.lit("Document:\n"), truncate_sentence(pos, 800), F.lit("\nQuery: "), F.coalesce(query, F.lit("")), F.lit('\nHow well does the document answer the query? Answer with JSON: {"connectivity_score": 0 to 100, "confidence": 0 to 1, "label": "", "reason": ""}'))


def accept(items: Column, terms: Column, labels: Column | None = None, edges: int | Column = 0, cap: int = CAP) -> Column:
    """The accepted queries of one answer, in order: array of (query, reasoning_type, used_edge_ids, used_neighbors).

    A sequential fold: what is malformed, leaks, repeats a compact form or a shape,
    exceeds its type's share ((cap + 1) // 2) or the cap is passed over; only accepted
    queries count as seen.
    """
    known = F.transform(labels if labels is not None else F.array().cast("array<string>"), normalize_compact)
    asked = F.transform(items, lambda v: F.struct(v.alias("v"), clean_query(F.try_variant_get(v, "$.query", "string")).alias("query")))
    usable = F.filter(asked, lambda p: p["query"].isNotNull() & ~has_leakage(p["query"], terms))
    keyed = F.transform(usable, lambda p: F.struct(p["v"].alias("v"), p["query"].alias("query"), normalize_compact(p["query"]).alias("n"), abstract_structure(p["query"]).alias("s"), reasoning_type(p["v"]).alias("t")))
    share = max(1, (cap + 1) // 2)

    def fold(acc: Column, x: Column) -> Column:
        seen = F.exists(acc, lambda a: (a["n"] == x["n"]) | (a["s"] == x["s"]))
        full = F.size(F.filter(acc, lambda a: a["t"] == x["t"])) >= share
        return F.when((F.size(acc) >= cap) | seen | full, acc).otherwise(F.concat(acc, F.array(x)))

    taken = bound(keyed, lambda all_: F.aggregate(all_, F.filter(all_, lambda _: F.lit(False)), fold))
    neighbors = lambda v: F.filter(F.coalesce(F.try_variant_get(v, "$.used_neighbors", "array<string>"), F.array().cast("array<string>")), lambda n: n.isNotNull() & F.array_contains(known, normalize_compact(n)))
    return F.transform(taken, lambda k: F.struct(k["query"].alias("query"), k["t"].alias("reasoning_type"), edge_ids(k["v"], edges).alias("used_edge_ids"), neighbors(k["v"]).alias("used_neighbors")))


def synthesize(rows: DataFrame, provider, retries: int = 2) -> DataFrame:
    """rows (row_uid, pos, terms, graph_lines, labels, and graph_edges if any) with generated_queries.

    Rows without an accepted query are asked again, at most ``retries`` times more.
    Each round is written to the checkpoint folder, so a lost executor costs a round.
    """
    edges = F.size("graph_edges") if "graph_edges" in rows.columns else 0
    todo = rows.withColumn("prompt", generation_prompt(F.col("pos"), F.col("graph_lines"), F.col("terms")))
    done = None
    for attempt in range(retries + 1):
        raw = provider.answer(todo.select("prompt").distinct(), attempt)
        got = todo.join(raw, "prompt", "left").withColumn("generated_queries", accept(parse_output("raw"), F.col("terms"), F.col("labels"), edges)).drop("raw")
        got = got.checkpoint() if attempt < retries else got
        ready = got.where(F.size("generated_queries") > 0) if attempt < retries else got
        done = ready if done is None else done.unionByName(ready)
        todo = got.where(F.size("generated_queries") == 0).drop("generated_queries")
    return done.drop("prompt")


def keyphrases(rows: DataFrame, provider) -> DataFrame:
    """rows (…, pos) with keywords: the provider's answer on one line."""
    asked = rows.withColumn("prompt", keyphrase_prompt("pos"))
    raw = provider.answer(asked.select("prompt").distinct(), 0)
    return asked.join(raw, "prompt", "left").withColumn("keywords", one_line("raw")).drop("prompt", "raw")


def judge(cands: DataFrame, provider, retry: bool = True) -> DataFrame:
    """cands (…, pos, query) with raw: each prompt is sent once; unreadable answers are asked for once more."""
    from querykiln.functions.judging import is_failure, parse_judgement

    asked = cands.withColumn("prompt", judging_prompt("pos", F.col("query")))
    raw = provider.answer(asked.select("prompt").distinct(), 0)
    if retry:
        raw = raw.checkpoint()
        again = provider.answer(raw.where(is_failure(parse_judgement("raw"))).select("prompt"), 1).where(~is_failure(parse_judgement("raw"))).select("prompt", F.col("raw").alias("raw2"))
        raw = raw.join(again, "prompt", "left").select("prompt", F.coalesce("raw2", "raw").alias("raw"))
    return asked.join(raw, "prompt", "left").drop("prompt")
