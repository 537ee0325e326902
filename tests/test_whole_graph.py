"""Queries on the graph cover all topics and all entities, and so does their SQL."""

import duckdb
import pytest

from querykiln.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "supplier", "customer", "part")


def by_sql(sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return sorted(con.sql(sql).fetchall(), key=repr)


def rows_of(spark, name):
    return sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=repr)


def ids(spark, table, key, letter):
    return {f"{letter}{r[0]}" for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}


@pytest.mark.parametrize("name", ["kg_outgoing", "kg_incoming"])
def test_all_entities_are_seeds(spark, name):
    got = rows_of(spark, name)
    assert got == by_sql(ORACLE[name])
    assert {r[0] for r in got if r[0][0] == "S"} >= {s for s in ids(spark, "supplier", "s_suppkey", "S")} - seven(spark)


def seven(spark):
    """Suppliers and customers whose only neighbour, N7, is missing."""
    return {f"{k}{r[0]}" for t, c, k in (("supplier", "s", "S"), ("customer", "c", "C")) for r in spark.read.parquet(f"{SF}/{t}.parquet").where(f"{c}_nationkey = 7").select(f"{c}_{'supp' if c == 's' else 'cust'}key").collect()}


def test_all_parts_are_topics(spark):
    got = rows_of(spark, "kg_fallback")
    assert got == by_sql(ORACLE["kg_fallback"])
    assert len(got) == spark.read.parquet(f"{SF}/part.parquet").count() > 400


def test_relations_of_all_entities(spark):
    got = rows_of(spark, "neighbor_relations")
    assert got == by_sql(ORACLE["neighbor_relations"])
    facets = []
    for table, c, key in (("supplier", "s", "s_suppkey"), ("customer", "c", "c_custkey")):
        names = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/nation.parquet").select("n_nationkey", "n_name").collect()}
        for k, n in spark.read.parquet(f"{SF}/{table}.parquet").select(key, f"{c}_nationkey").collect():
            if n != 7:
                facets.append((f"{c.upper()}{k}", f"N{n}", names[n], "is a facet of", "→"))
    assert [r for r in got if r[0][0] in "SC"] == sorted(facets, key=repr)
    sample = rows_of(spark, "neighbor_sample")
    assert sample == by_sql(ORACLE["neighbor_sample"])
    assert set(sample) <= set(got) and {r[0] for r in sample} == {r[0] for r in got}
    per = [sum(r[0] == s for r in sample) for s in {"R0", "N0", facets[0][0]}]
    assert max(per) <= 2
