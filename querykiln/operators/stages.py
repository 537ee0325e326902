"""The five stages as DataFrame transforms over whole rows; other columns pass through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querykiln.functions import text as T
from querykiln.operators import bm25, context, graph, selection, synthesis


def _column(df: DataFrame, name: str, kind: str):
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def keys(rows: DataFrame, provider) -> DataFrame:
    """Adds keywords by a provider's answer for each positive."""
    return synthesis.keyphrases(rows, provider)


def topics_of(rows: DataFrame) -> Column:
    return T.topics_from_list("keywords") if dict(rows.dtypes).get("keywords", "").startswith("array") else T.topics_from_keywords("keywords")


def subgraphs(rows: DataFrame, entity: DataFrame, search: DataFrame, claim: DataFrame, max_topics: int = 5, **how) -> DataFrame:
    """Adds center_topics and subgraphs: per topic its status, seed and the attempt that won."""
    rows = rows.withColumn("center_topics", F.slice(topics_of(rows), 1, max_topics))
    asked = rows.select(F.col("row_ord").alias("row_uid"), F.posexplode(F.when(F.size("center_topics") == 0, F.array(F.lit(""))).otherwise(F.col("center_topics"))).alias("topic_ord", "topic"))
    got = graph.subgraphs(asked, entity, search, claim, **how)
    seeds = got.where("seed is not null").select(F.col("seed").alias("qid")).distinct()
    near = graph.neighbours(seeds, claim, **{k: how[k] for k in ("props", "most") if k in how})
    node = graph.nodes(seeds, near, entity)
    edge = graph.edges(seeds, near, node, claim, **{k: how[k] for k in ("reverse",) if k in how})
    packed_nodes, packed_edges = graph.packed(node, edge)
    full = got.join(packed_nodes, "seed", "left").join(packed_edges, "seed", "left")
    parts = full.groupBy("row_uid").agg(F.array_sort(F.collect_list(F.struct("topic_ord", "topic", "status", "seed", "refined", "chosen_text", "n_attempts", "num_nodes", "num_edges", "nodes", "edges"))).alias("subgraphs"))
    return rows.join(parts, rows["row_ord"] == parts["row_uid"], "left").drop("row_uid")


def synthesize(rows: DataFrame, provider, retries: int = 2, extra: int = 2, seed: int = 0, most: int = 8) -> DataFrame:
    """Adds generated_queries; terms that would leak the topic are kept out of them.

    Prompts show ``extra`` sampled neighbours of each row's subgraphs, else up to ``most``
    useful edges; each accepted query carries those neighbours and edges that its answer
    names (used_neighbors, used_edge_ids and the edges themselves as used_edges).
    """
    terms = T.leakage_terms(_column(rows, "keywords", "string") if not dict(rows.dtypes).get("keywords", "").startswith("array") else F.lit(""), _column(rows, "center_topics", "array<string>"))
    asked = context.with_context(rows, extra=extra, seed=seed, most=most).withColumns({"row_uid": F.col("row_ord"), "terms": terms})
    done = synthesis.synthesize(asked, provider, retries)
    named = F.transform("generated_queries", lambda g: g.withField("used_edges", F.transform(g["used_edge_ids"], lambda i: F.get(F.col("graph_edges"), i))))
    return done.withColumn("generated_queries", named).drop("row_uid", "terms", "graph_lines", "labels", "graph_edges")


def synthesis_counters(rows: DataFrame, extra: int = 2) -> DataFrame:
    """One row: how many rows there are, by what their prompts show (neighbours, edges, the text alone)."""
    seen = context.with_context(rows, extra=extra)
    node, edge = F.size("labels") > 0, F.size("graph_edges") > 0
    return seen.agg(F.count(F.lit(1)).alias("rows"), F.count_if(node).alias("with_neighbors"), F.count_if(edge).alias("with_edges"), F.count_if(~node & ~edge).alias("text_only"))


def verify(rows: DataFrame, provider, most: int = 5, policy: dict = selection.POLICY, **weights) -> DataFrame:
    """Adds the evaluations, the selection and all good queries of each row (by _row_uid)."""
    phrases = T.keyword_phrases_list("keywords") if dict(rows.dtypes).get("keywords", "").startswith("array") else T.keyword_phrases(_column(rows, "keywords", "string"))
    kind = dict(rows.dtypes)["generated_queries"]
    queries = F.col("generated_queries") if kind == "array<string>" else F.transform("generated_queries", lambda g: g["query"])
    base = rows.select(F.col("_row_uid").alias("row_uid"), "pos", phrases.alias("phrases"), queries.alias("queries"))
    cands = selection.candidates(base, most).join(base.select("row_uid", "pos", "phrases"), "row_uid")
    e = selection.evaluate(synthesis.judge(cands, provider), policy, **weights)
    final = selection.finalize(e, base, policy)
    return rows.join(final, rows["_row_uid"] == final["row_uid"], "left").drop("row_uid")


def counters(rows: DataFrame) -> DataFrame:
    """One row: how many rows there are, with and without negatives."""
    found = F.coalesce(F.size("negative_passages"), F.lit(0)) > 0
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(found).alias("found"), F.count_if(~found).alias("skipped"))


mine = bm25.mine
