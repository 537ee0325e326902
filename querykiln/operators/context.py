"""What a row's subgraphs add to its prompt: sampled neighbours, else useful edges.

A row holds a few topics with at most some dozen neighbours each, so all of it is
array expressions within the row: no shuffle, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querykiln.functions.text import normalize_compact, tokens_alnum
from querykiln.operators.graph import NOISY, PHRASES, PROPERTY_NAMES, TAXONOMY

#: What is read of subgraphs, whatever else their structs hold or lack.
SHAPE = "array<struct<topic:string,seed:string,nodes:array<struct<qid:string,label:string,description:string>>,edges:array<struct<src:string,prop:string,dst:string>>>>"
_EDGE = "array<struct<src:string,prop:string,dst:string,label:string>>"


def _named(code: Column, side: int | None = None) -> Column:
    """A property's name, or its phrase out of (0) or into (1) the centre."""
    out = code
    for table in (PROPERTY_NAMES, {} if side is None else {k: v[side] for k, v in PHRASES.items()}):
        for k, v in table.items():
            out = F.when(code == k, v).otherwise(out)
    return out


def _trimmed(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def read_subgraphs(column: str) -> Column:
    """Subgraphs of any struct as ``SHAPE``; null, malformed and other types give an empty array."""
    read = F.from_json(F.to_json(F.col(column)), SHAPE)
    return F.filter(F.coalesce(read, F.array().cast(SHAPE)), lambda g: g.isNotNull())


def centred(subgraphs: Column) -> Column:
    """Each subgraph as (topic, edges, named, center): its labelled nodes, and its seed or else the first of them."""
    def of(g: Column) -> Column:
        named = F.filter(F.coalesce(g["nodes"], F.array()), lambda n: n["qid"].isNotNull() & (_trimmed(n["label"]) != ""))
        return F.struct(g["topic"].alias("topic"), g["seed"].alias("seed"), F.coalesce(g["edges"], F.array()).alias("edges"), named.alias("named"))

    own = lambda g: F.filter(g["named"], lambda n: n["qid"] == g["seed"])
    return F.transform(F.transform(subgraphs, of), lambda g: g.withField("center", F.get(F.concat(own(g), g["named"]), F.lit(0))))


def sampled(centres: Column, extra: int = 2, seed: int = 0) -> Column:
    """Per subgraph (topic, center, description, neighbors): ``extra`` neighbours, picked by a hash (md5) of the ids.

    Each neighbour has its relation by the first edge with the centre; subgraphs without a neighbour go.
    """
    def related(n: Column, g: Column) -> Column:
        c, q = g["center"]["qid"], n["qid"]
        touching = F.filter(g["edges"], lambda e: ((e["src"] == c) & (e["dst"] == q)) | ((e["dst"] == c) & (e["src"] == q)))
        side = F.transform(F.slice(touching, 1, 1), lambda e: F.when(e["src"] == c, F.struct(_named(e["prop"], 0).alias("relation"), F.lit("→").alias("arrow"))).otherwise(F.struct(_named(e["prop"], 1).alias("relation"), F.lit("←").alias("arrow"))))
        first = F.get(F.concat(side, F.array(F.struct(F.lit("related to").alias("relation"), F.lit("↔").alias("arrow")))), F.lit(0))
        return F.struct(_trimmed(n["label"]).alias("label"), _trimmed(n["description"]).alias("description"), first["relation"].alias("relation"), first["arrow"].alias("arrow"))

    def of(g: Column) -> Column:
        c = g["center"]
        others = F.filter(g["named"], lambda n: n["qid"] != c["qid"])
        dealt = F.array_sort(F.transform(others, lambda n: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), c["qid"], n["qid"])).alias("h"), n["qid"].alias("q"), n.alias("n"))))
        picked = F.transform(F.slice(dealt, 1, max(0, extra)), lambda x: related(x["n"], g))
        return F.struct(g["topic"].alias("topic"), _trimmed(c["label"]).alias("center"), _trimmed(c["description"]).alias("description"), picked.alias("neighbors"))

    return F.filter(F.transform(centres, of), lambda s: F.size(s["neighbors"]) > 0)


def ranked_edges(subgraphs: Column, pos: Column) -> Column:
    """All edges worth showing by words shared with the text, best first, then in their order.

    Taxonomic edges need two shared words, noisy ones a shared word of the target.
    """
    words = tokens_alnum(pos)

    def label(g: Column, qid: Column) -> Column:
        return F.coalesce(F.get(F.filter(F.coalesce(g["nodes"], F.array()), lambda n: n["qid"] == qid), F.lit(0))["label"], qid, F.lit(""))

    def scored(e: Column, g: Column, place: Column) -> Column:
        src, dst = label(g, e["src"]), label(g, e["dst"])
        shared = F.size(F.array_intersect(F.array_union(tokens_alnum(src), tokens_alnum(dst)), words))
        return F.struct((-shared).alias("worse"), place.alias("place"), F.size(F.array_intersect(tokens_alnum(dst), words)).alias("target"), src.alias("src"), e["prop"].alias("prop"), dst.alias("dst"), _named(e["prop"]).alias("label"))

    all_ = F.flatten(F.transform(subgraphs, lambda g, i: F.transform(F.coalesce(g["edges"], F.array()), lambda e, k: scored(e, g, i * 1_000_000 + k))))
    fine = F.filter(all_, lambda x: ~(F.coalesce(x["prop"].isin(*TAXONOMY), F.lit(False)) & (x["worse"] > -2)) & ~(F.coalesce(x["prop"].isin(*NOISY), F.lit(False)) & (x["target"] < 1)))
    return F.array_sort(fine)


def first_of_pairs(ranked: Column, most: int = 8) -> Column:
    """The best edge of each pair of compact labels, at most ``most``."""
    pair = lambda x: F.concat_ws("|", normalize_compact(x["src"]), normalize_compact(x["dst"]))
    keys = F.transform(ranked, pair)
    once = F.filter(ranked, lambda x, i: F.array_position(keys, pair(x)) == i + 1)
    return F.transform(F.slice(once, 1, most), lambda x: F.struct(x["src"].alias("src"), x["prop"].alias("prop"), x["dst"].alias("dst"), x["label"].alias("label")))


def _about(label: Column, description: Column) -> Column:
    return F.concat(label, F.when(description != "", F.concat(F.lit(": "), description)).otherwise(""))


def prompt_lines(sample: Column, edges: Column) -> Column:
    """Lines on each hidden centre and its neighbours; where no subgraph has any, lines on the useful edges."""
    def of(s: Column) -> Column:
        head = F.concat(F.lit("- "), F.coalesce(s["topic"], F.lit("")), F.lit(", hidden (never name it): "), _about(s["center"], s["description"]))
        each = F.transform(s["neighbors"], lambda n: F.concat(F.lit("  - hidden "), n["arrow"], F.lit(" "), n["relation"], F.lit(" "), _about(n["label"], n["description"])))
        return F.concat(F.array(head), each)

    plain = F.transform(edges, lambda e: F.concat(F.lit("- "), e["src"], F.lit(" → "), F.coalesce(e["label"], F.lit("")), F.lit(" → "), e["dst"]))
    return F.when(F.size(sample) > 0, F.flatten(F.transform(sample, of))).otherwise(plain)


def with_context(rows: DataFrame, subgraphs: str = "subgraphs", pos: str = "pos", extra: int = 2, seed: int = 0, most: int = 8) -> DataFrame:
    """Adds graph_lines, labels (of the sampled neighbours) and graph_edges (the useful edges, best first).

    Rows without the column, with null or with empty subgraphs get empty arrays.
    """
    if subgraphs not in rows.columns or not dict(rows.dtypes)[subgraphs].startswith("array"):
        none = F.array().cast("array<string>")
        return rows.withColumns({"graph_lines": none, "labels": none, "graph_edges": F.array().cast(_EDGE)})
    read = rows.withColumn("_graphs", read_subgraphs(subgraphs))
    read = read.withColumn("_centres", centred(F.col("_graphs")))
    ranked = read.withColumns({"_sample": sampled(F.col("_centres"), extra, seed), "_ranked": ranked_edges(F.col("_graphs"), F.col(pos))})
    cut = ranked.withColumn("graph_edges", first_of_pairs(F.col("_ranked"), most))
    labels = F.flatten(F.transform("_sample", lambda s: F.transform(s["neighbors"], lambda n: n["label"])))
    return cut.withColumns({"graph_lines": prompt_lines(F.col("_sample"), F.col("graph_edges")), "labels": labels}).drop("_graphs", "_centres", "_sample", "_ranked")
