"""JSON lines in and out, with explicit row order, positives and resumable output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querykiln.functions.text import strip_ws

POSITIVE_KEYS = ("positive_passages", "positive passages", "positives", "positive")


_FILE = ("_path", "_block", "_place")


def placed(read: DataFrame) -> DataFrame:
    """``read`` of files with where each row stands: its file, its split's start and a number that grows within the split."""
    return read.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))


def numbered(rows: DataFrame) -> DataFrame:
    """``placed`` rows with row_ord: dense from 0 in the order of files and lines, however they are split.

    Rows are counted per split, so no task ranks more than one split or the list of splits.
    """
    sizes = rows.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_path", "_block").rowsBetween(W.unboundedPreceding, -1))  # one row a split
    starts = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    rank = F.row_number().over(W.partitionBy("_path", "_block").orderBy("_place"))
    ranked = rows.withColumn("_rank", rank).join(starts, ["_path", "_block"])
    return ranked.withColumn("row_ord", (F.col("_before") + F.col("_rank") - 1).cast("long")).drop(*_FILE, "_rank", "_before")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_ord, line): lines in order, row_ord dense from 0."""
    return numbered(placed(spark.read.text(path))).select("row_ord", F.col("value").alias("line"))


def read_jsonl(spark: SparkSession, path: str, mode: str = "lenient") -> DataFrame:
    """(row_ord, v variant) of the objects and other values of a file; row_ord counts lines that aren't blank.

    lenient: blank and unreadable lines are dropped. strict: blank lines are dropped,
    unreadable ones raise. exact: blank lines raise too. Undecodable bytes are replaced.
    """
    lines = placed(spark.read.text(path)).withColumnRenamed("value", "line")
    blank = strip_ws("line") == ""
    lines = numbered(lines if mode == "exact" else lines.where(~blank))
    if mode == "lenient":
        got = lines.withColumn("v", F.try_parse_json("line")).where("v is not null")
    elif mode in ("strict", "exact"):
        got = lines.withColumn("v", F.parse_json(F.when(blank, F.lit("blank line")).otherwise(F.col("line"))))
    else:
        raise ValueError(f"mode {mode!r}: lenient, strict or exact")
    return got.select("row_ord", "v")


def head(df: DataFrame, n: int | None, order: str = "row_ord") -> DataFrame:
    """The first ``n`` rows by order; None or 0 means all."""
    return df.orderBy(order).limit(n) if n else df


def first_positive(v: str = "v") -> Column:
    """Text of the first positive: of the first key present, a list's first element, a dict's text, a pair's second, a string itself.

    A first key that yields no text gives null, whatever later keys hold.
    """
    def text(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        return F.when(kind.startswith("OBJECT"), F.try_variant_get(x, "$.text", "string")).when(kind.startswith("ARRAY"), F.try_variant_get(x, "$[1]", "string")).when(kind == "STRING", F.try_variant_get(x, "$", "string"))

    x = F.coalesce(*(F.try_variant_get(F.col(v), f"$['{key}']", "variant") for key in POSITIVE_KEYS))
    return F.when(F.schema_of_variant(x).startswith("ARRAY"), text(F.try_variant_get(x, "$[0]", "variant"))).otherwise(text(x))


def records(df: DataFrame, source: str = "math") -> DataFrame:
    """(row_ord, query, pos, error) of parsed lines; error names what is missing instead of raising."""
    if source == "math":
        query, pos = F.try_variant_get("v", "$.query", "string"), first_positive()
    elif source == "bright":
        query, pos = F.try_variant_get("v", "$.query[1]", "string"), F.try_variant_get("v", "$.pos[0][1]", "string")
    else:
        raise ValueError(f"source {source!r}: math or bright")
    return df.select("row_ord", query.alias("query"), pos.alias("pos"), F.when(query.isNull(), "query").when(pos.isNull(), "positive").alias("error"))


def with_uid(df: DataFrame) -> DataFrame:
    """_row_uid: the row's own, or row_<n> by its place among non-blank rows (n from 1; row_ord as ``numbered`` makes it)."""
    return df.withColumn("_row_uid", F.coalesce(F.nullif(F.col("_row_uid"), F.lit("")) if "_row_uid" in df.columns else F.lit(None), F.concat(F.lit("row_"), (F.col("row_ord") + 1).cast("string"))))


def unprocessed(rows: DataFrame, done: DataFrame) -> DataFrame:
    """rows whose _row_uid isn't in ``done``, the first of each by row_ord."""
    fresh = rows.join(done.select("_row_uid").where("_row_uid is not null and _row_uid <> ''").distinct(), "_row_uid", "left_anti")
    first = fresh.groupBy("_row_uid").agg(F.min("row_ord").alias("row_ord"))
    return fresh.join(first, ["_row_uid", "row_ord"], "left_semi")


def processed_uids(spark: SparkSession, path: str) -> DataFrame:
    """_row_uid of a sink's readable lines; a torn last line doesn't count."""
    return read_jsonl(spark, path).select(F.try_variant_get("v", "$._row_uid", "string").alias("_row_uid")).where("_row_uid <> ''").distinct()


def write_jsonl(df: DataFrame, path: str, order: str = "row_ord", mode: str = "overwrite", keep_order_column: bool = False) -> None:
    """One JSON object a line, nulls kept, in order over the part files; mode append adds files, never half lines."""
    cols = [c for c in df.columns if keep_order_column or c != order]
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")
    df.repartitionByRange(order).sortWithinPartitions(order).select(text).write.mode(mode).text(path)


def attach(df: DataFrame, mode: str = "augment") -> DataFrame:
    """augment keeps all columns, subgraph_only just center_topics and subgraphs."""
    if mode not in ("augment", "subgraph_only"):
        raise ValueError(f"mode {mode!r}: augment or subgraph_only")
    return df if mode == "augment" else df.select("center_topics", "subgraphs")


