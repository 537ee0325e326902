"""Graph context of prompts: sampled neighbours, useful edges, odd subgraphs."""

import hashlib

from querykiln.operators import context

KIND = "row_ord long, pos string, subgraphs array<struct<topic:string,seed:string,nodes:array<struct<qid:string,label:string,description:string>>,edges:array<struct<src:string,prop:string,dst:string,direction:string>>>>"


def made(spark, graphs, pos="red sand moves", **how):
    df = spark.createDataFrame([(0, pos, graphs)], KIND)
    return context.with_context(df, **how).first()


def test_neighbours_by_hash_with_relation_from_the_centre(spark):
    nodes = [("Q1", " Coast ", "edge of land")] + [(f"Q{i}", f"thing{i}", None) for i in range(2, 7)] + [("Q9", " ", "unlabelled")]
    edges = [("Q1", "P361", "Q2", "outgoing"), ("Q3", "P279", "Q1", "incoming"), ("Q1", "P999", "Q4", "outgoing"), ("Q2", "P31", "Q1", "incoming")]
    got = made(spark, [("shore", "Q1", nodes, edges)], extra=5, seed=3)
    order = sorted((f"Q{i}" for i in range(2, 7)), key=lambda q: hashlib.md5(f"3|Q1|{q}".encode()).hexdigest())
    relation = {"Q2": "→ is part of", "Q3": "← has subclass", "Q4": "→ P999", "Q5": "↔ related to", "Q6": "↔ related to"}
    assert got.labels == ["thing" + q[1] for q in order]
    assert got.graph_lines == ["- shore, hidden (never name it): Coast: edge of land"] + [f"  - hidden {relation[q]} thing{q[1]}" for q in order]
    assert made(spark, [("shore", "Q1", nodes, edges)], extra=2, seed=3).labels == got.labels[:2]


def test_centre_falls_back_to_the_first_labelled_node(spark):
    got = made(spark, [("t", "Q8", [("Q7", "", None), ("Q1", "a", None), ("Q2", "b", None)], [("Q2", "P31", "Q1", "incoming")])])
    assert got.graph_lines == ["- t, hidden (never name it): a", "  - hidden ← has instance b"]


def test_edges_only_where_no_neighbour_is(spark):
    lone = [("Q1", "red sand", None)]
    edges = [("Q1", "P31", "red rock", "outgoing"), ("Q1", "P31", "blue", "outgoing"), ("Q1", "P366", "glass", "outgoing"), ("Q1", "P361", "beach", "outgoing"), ("Q1", "P361", "Beach!", "outgoing"), ("x", "P31", "y", "outgoing")]
    got = made(spark, [("t", "Q1", lone, edges)])
    assert got.labels == [] and [(e.prop, e.dst) for e in got.graph_edges] == [("P31", "red rock"), ("P31", "blue"), ("P361", "beach")]
    assert got.graph_lines == ["- red sand → instance of → red rock", "- red sand → instance of → blue", "- red sand → part of → beach"]
    assert len(made(spark, [("t", "Q1", lone, edges)], most=1).graph_edges) == 1


def test_rows_without_graph(spark):
    for graphs in (None, [], [None], [("t", None, None, None)], [("t", "Q1", [], [])], [("t", "Q1", [("Q1", None, None)], None)]):
        got = made(spark, graphs, pos=None)
        assert got.graph_lines == [] and got.labels == [] and got.graph_edges == []
    odd = spark.createDataFrame([(0, "p", ["x"])], "row_ord long, pos string, subgraphs array<string>")
    assert context.with_context(odd).first().graph_lines == []
    assert context.with_context(odd.drop("subgraphs")).first().graph_lines == []
    assert context.with_context(odd.limit(0)).count() == 0
