"""Corpus pipeline: quality rules, toxicity, line dedup, MinHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a
DataFrame; every stage is written as Parquet in the shared folder and read again as
the next one's documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.llm import linededup, linerules, minhash, packing, toxicity
from querykiln.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars brought up to date with the text."""
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """COLUMNS and ``_id``: doc_id, or where an id is null or repeated a key of each row's own in its place.

    Keys keep the order of doc_id, null last, and are written once so that they stay
    the same; the rows are dealt by range, ties by text, so no id is gathered anywhere.
    """
    docs = docs.select(*COLUMNS).withColumn("_id", F.col("doc_id"))
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").head(1):
        return docs
    order = (F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.col("_tie").asc())
    dealt = docs.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.withColumn("doc_id", F.monotonically_increasing_id()).drop("_tie"), "keyed")


def _named(keyed: DataFrame) -> DataFrame:
    """COLUMNS with the ids that the rows came with."""
    return _documents(keyed.withColumn("doc_id", F.col("_id")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that fail the base rule or are mostly boilerplate go."""
    return linerules.keep(docs.select(*COLUMNS), linerules.learn(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that score as toxic go; learned from the labels of sf_dir."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs.select(*COLUMNS), model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: lines that an earlier line resembles are taken out; no document goes."""
    return _named(linededup.dedup_lines(_keyed(docs)))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 on five-word shingles: of each group of near-duplicates the smallest doc_id stays."""
    keyed = _keyed(docs)
    found = minhash.near_duplicates(keyed).where("kept").select("doc_id")
    return keyed.join(found, "doc_id", "left_semi").withColumn("doc_id", F.col("_id")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of all documents, packed into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("packing", packing_stage),
]
#: The line model and the lexicon are learned, which SQL cannot express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
