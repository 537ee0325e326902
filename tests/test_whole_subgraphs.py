"""Attached nodes and edges are those that were counted."""

from querykiln.operators import stages


def test_attached_as_counted(spark):
    entity = spark.createDataFrame([(f"Q{i}", "hub" if i == 0 else f"leaf{i}", "", [], False) for i in range(101)], "qid string, label string, description string, aliases array<string>, missing boolean")
    search = spark.createDataFrame([("hub", "Q0", "label", 1)], "text_norm string, qid string, match_type string, rank int")
    claim = spark.createDataFrame([("Q0", "P527", i, "item", f"Q{i}") for i in range(1, 101)] + [("Q1", "P361", 0, "item", "Q0"), ("Q0", "P31", 0, "item", "Q2")], "src string, prop string, claim_ord long, value_type string, dst string")
    rows = spark.createDataFrame([(0, ["hub"])], "row_ord long, keywords array<string>")
    for how in ({"most": 100}, {"most": 10}, {"props": ("P31",)}, {"reverse": ("P279",)}, {}):
        got = stages.subgraphs(rows, entity, search, claim, **how).first().subgraphs[0]
        assert (got.num_nodes, got.num_edges) == (len(got.nodes), len(got.edges)), how
