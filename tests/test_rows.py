"""Rows keep their numbers over files and splits; positives and stale negatives of any shape."""

import json

from pyspark.sql import functions as F

from querykiln.functions.judging import parse_output
from querykiln.operators import bm25
from querykiln.sources import jsonl


def test_uids_are_dense_over_files_and_splits(spark, tmp_path):
    for name, n in (("a", 50), ("b", 3), ("c", 400)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"q": f"{name}{i}", "pad": "x" * 50}) + "\n" + "\n" * (i % 3 == 0) for i in range(n)))
    want = [f"{name}{i}" for name, n in (("a", 50), ("b", 3), ("c", 400)) for i in range(n)]
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = jsonl.read_jsonl(spark, str(tmp_path)).select("row_ord", F.try_variant_get("v", "$.q", "string").alias("q"))
            got = {r["_row_uid"]: r.q for r in jsonl.with_uid(rows).collect()}
            read = jsonl.numbered(jsonl.placed(spark.read.json(str(tmp_path))))
            also = {r.row_ord: r.q for r in read.collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {f"row_{i + 1}": q for i, q in enumerate(want)}
        assert also == dict(enumerate(want))


def test_first_key_present_decides(spark):
    lines = [{"positive_passages": [], "positive": "x"}, {"positive": "x"}, {"positives": [["t", "y"]]}, {"positive passages": {"text": "z"}, "positive": "x"}, {}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "line string").select(F.parse_json("line").alias("v"))
    assert [r[0] for r in df.select(jsonl.first_positive()).collect()] == [None, "x", "y", "z", None]


def test_mine_rows_of_any_shape(spark):
    words = ["red apple tart", "green pear cake", "blue plum pie", "red plum jam"]
    rows = spark.createDataFrame([(i, f"{w.split()[0]} {w.split()[1]}", [(w,)], "stale") for i, w in enumerate(words)], "row_ord long, query string, positive_passages array<struct<text:string>>, negative_passages string")
    got = {r.row_ord: r for r in bm25.mine(rows).collect()}
    assert [p["text"] for p in got[0].negative_passages] == ["red plum jam"] and got[0].negative_passages_before is None
    assert got[1].negative_passages is None and got[1].negative_passages_before == "stale"
    odd = rows.withColumn("negative_passages", F.array(F.struct(F.lit(1).alias("x"))))
    assert {r.row_ord: r.negative_passages_before for r in bm25.mine(odd).collect()}[1] == '[{"x":1}]'
    plain = rows.select("row_ord", "query", F.col("positive_passages")[0]["text"].alias("pos"))
    assert {r.row_ord: len(r.negative_passages or []) for r in bm25.mine(plain).collect()} == {0: 1, 1: 0, 2: 1, 3: 2}


def test_fence_in_any_case(spark):
    df = spark.createDataFrame([('```JSON\n[{"query": "a"}]\n```',)], "t string")
    assert df.select(F.size(parse_output("t"))).first()[0] == 1
