"""The graph_context query against its SQL."""

import duckdb

from querykiln.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_context_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer", "part"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = sorted(tuple(r) for r in QUERIES["graph_context"](spark, SF).collect())
    assert got == sorted(con.sql(ORACLE["graph_context"]).fetchall())
    assert sum(1 for _, lines, _ in got if "hidden →" in lines) > 20
