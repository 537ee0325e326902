"""Scoring and selection of judged candidates, one row per candidate in, one per row out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querykiln.functions.judging import coerce_float, coerce_int, final_score, is_failure, parse_judgement
from querykiln.functions.text import norm_lower, phrase_hits, score_of_hits, strip_ws

POLICY = {"good": 70, "ok": 60, "min_select": 45, "clean": 65, "clean_margin": 10, "good_save": 65}


def candidates(rows: DataFrame, most: int = 5, dedup: bool = True) -> DataFrame:
    """rows (row_uid, queries array<string>) to (row_uid, candidate_id, query).

    The list is cut first; then blanks go, and later ones that are equal when
    lower-cased with white space normalised. Ids are places in the list.
    """
    cut = F.slice("queries", 1, most)
    norms = F.transform(cut, norm_lower)
    keep = F.filter(F.transform(cut, lambda q, i: F.struct(i.cast("int").alias("candidate_id"), strip_ws(q).alias("query"))), lambda c: (c["query"] != "") & (F.lit(not dedup) | (F.array_position(norms, norm_lower(c["query"])) == c["candidate_id"] + 1)))
    return rows.select("row_uid", F.inline(keep))


def evaluate(judged: DataFrame, policy: dict = POLICY, kw_weight: float = 0.2, conn_weight: float = 0.8) -> DataFrame:
    """judged (row_uid, candidate_id, query, phrases, raw) to evaluations with scores and flags."""
    e = judged.withColumns({"hits": phrase_hits("query", "phrases"), "v": parse_judgement("raw")})
    e = e.withColumns({"n_hits": F.size("hits"), "judge_failed": is_failure("v"), "connectivity_score": coerce_int("v"), "confidence": coerce_float("v")})
    return flags(e.withColumns({"keyword_score": score_of_hits("n_hits"), "clean": F.col("n_hits") == 0}).drop("v"), policy, kw_weight, conn_weight)


def flags(e: DataFrame, policy: dict = POLICY, kw_weight: float = 0.2, conn_weight: float = 0.8) -> DataFrame:
    conn = F.col("connectivity_score")
    return e.withColumns({
        "final_score": final_score("keyword_score", "connectivity_score", kw_weight, conn_weight),
        "is_good": conn >= policy["good"],
        "is_ok": conn >= policy["ok"],
        "meets_min": conn >= policy["min_select"],
        "meets_clean": conn >= policy["clean"],
    })


def best(e: DataFrame, clean_only: bool) -> DataFrame:
    """The best candidate of each row among those judged: of the clean ones, or of all; ties to the lowest id."""
    keys = [F.desc("connectivity_score")] + ([] if clean_only else [F.desc("clean")]) + [F.desc("final_score"), F.asc("n_hits"), F.asc("candidate_id")]
    pool = e.where(~F.col("judge_failed") & (F.col("clean") if clean_only else F.lit(True)))
    return pool.withColumn("_r", F.row_number().over(W.partitionBy("row_uid").orderBy(*keys))).where("_r = 1").drop("_r")


def select(e: DataFrame, rows: DataFrame, policy: dict = POLICY) -> DataFrame:
    """(row_uid, selected_candidate_id, selected_query, note, and the two best) of every row."""
    cols = ("candidate_id", "query", "connectivity_score", "keyword_score", "final_score")
    side = lambda clean, name: best(e, clean).select("row_uid", F.struct(*cols).alias(name))
    both = rows.select("row_uid").distinct().join(side(True, "top_clean"), "row_uid", "left").join(side(False, "top_usable"), "row_uid", "left")
    c, u = F.col("top_clean.connectivity_score"), F.col("top_usable.connectivity_score")
    take_clean = (c >= policy["clean"]) & (c >= u - policy["clean_margin"])
    note = F.when(u.isNull(), "no_candidates").when(u < policy["min_select"], "all_candidates_weak").when(take_clean, "clean").otherwise("usable")
    out = both.withColumn("note", note).withColumn("chosen", F.when(F.col("note") == "clean", F.col("top_clean")).when(F.col("note") == "usable", F.col("top_usable")))
    gap = F.when(F.col("top_clean").isNotNull() & F.col("top_usable").isNotNull(), F.struct((u - c).alias("connectivity_gap"), c.alias("clean_connectivity"), u.alias("usable_connectivity")))
    return out.select("row_uid", F.col("chosen.candidate_id").alias("selected_candidate_id"), F.col("chosen.query").alias("selected_query"), "chosen", "note", "top_clean", "top_usable", gap.alias("diagnostics"))


def good_queries(e: DataFrame, policy: dict = POLICY) -> DataFrame:
    """(row_uid, rank, ...) clean candidates strong enough to keep, by connectivity, ties by id."""
    w = W.partitionBy("row_uid").orderBy(F.desc("connectivity_score"), "candidate_id")
    return e.where(F.col("clean") & ~F.col("judge_failed") & (F.col("connectivity_score") >= policy["good_save"])).withColumn("rank", F.row_number().over(w)).select("row_uid", "rank", "candidate_id", "query", "connectivity_score", "keyword_score", "final_score")


def finalize(e: DataFrame, rows: DataFrame, policy: dict = POLICY) -> DataFrame:
    """One row per input row: selection, the evaluations by (final, connectivity, clean) and all good queries."""
    order = F.struct((-F.col("final_score")).alias("a"), (-F.col("connectivity_score")).alias("b"), (~F.col("clean")).alias("c"), "candidate_id", "query", "keyword_score", "connectivity_score", "confidence", "final_score", "clean", "judge_failed", "is_good", "is_ok", "meets_min", "meets_clean")
    evals = e.groupBy("row_uid").agg(F.array_sort(F.collect_list(order)).alias("candidate_evaluations"))
    good = good_queries(e, policy).groupBy("row_uid").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "query", "connectivity_score", "keyword_score", "final_score"))).alias("all_good_queries"))
    return select(e, rows, policy).join(evals, "row_uid", "left").join(good, "row_uid", "left")


def mining_bridge(final: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_uid, query, pos) to mine with: every good query, or else the selected one."""
    good = final.select("row_uid", F.explode("all_good_queries.query").alias("query"))
    chosen = final.where(F.coalesce(F.size("all_good_queries"), F.lit(0)) <= 0).where("selected_query is not null").select("row_uid", F.col("selected_query").alias("query"))
    return good.unionByName(chosen).join(rows.select("row_uid", "pos"), "row_uid")
