"""Operator 9 - best-fit packing by sums of squares.

Documents become pieces of at most ``capacity`` tokens, pieces are put into
sequences, long ones first. A piece goes to the open sequence with room for it
that makes the sum of squares of the counts of open sequences per residual gap
smallest (ties: the tightest gap); a sequence is opened only when none has room,
for as few sequences as can be. Pieces are dealt to groups of bounded size that
are packed apart; the loosest sequences of all groups are packed once more.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.llm.bpe import encoder_of, in_blocks
from querykiln.llm.common import Table, columns_of

CAPACITY = 2048
#: Pieces that one task packs, about.
GROUP = 60_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each size, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by residual gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        change = 2 - 2 * count[s:capacity]
        change[1:] += 2 * count[1 : capacity - s]
        change[:1] -= 1  # a bin that is filled is no longer counted
        change[count[s:capacity] == 0] = 1 << 60
        best = int(change.argmin()) if len(change) else 0
        if len(change) and count[s + best]:
            gap = s + best
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        where[i], offset[i] = b, capacity - gap
        if gap > s:
            bins[gap - s].append(b)
            count[gap - s] += 1
    return where, offset


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids and a 0, cut only where they exceed ``capacity``."""

    def run(batches):
        enc = encoder_of(path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for a, b in in_blocks(texts):
                for d, x in zip(ids[a:b], enc.encode(texts[a:b])):
                    x = np.append(x, 0).astype("<u4").tobytes()
                    for k, at in enumerate(range(0, len(x), 4 * capacity)):
                        part = x[at : at + 4 * capacity]
                        for column, v in zip(rows, (d, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return columns_of(docs, "doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns PIECES and sequence_id, offset. A null or empty text is one piece
    that holds only the closing 0; repeated rows and null ids are packed like any
    other; an empty table gives no rows; extra columns are ignored. Every piece is
    placed exactly once and offsets of a sequence leave no gap.
    """
    spark = docs.sparkSession
    pieces = Table(cut(docs, path, capacity), "pieces").df
    schema = f"{PIECES}, sequence_id long, offset long, loose boolean"

    def placed(df: DataFrame, n: int, base: int, keep: int) -> DataFrame:
        groups = max(1, -(-n // group))

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
            where, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
            filled = np.bincount(where, weights=pdf["length"].to_numpy())
            loose = np.isin(where, np.argsort(filled, kind="stable")[: int(len(filled) * keep / 100)]) if groups > 1 else np.zeros(len(where), bool)
            return pdf.drop(columns="part").assign(sequence_id=(int(key[0]) + base << 40) + where, offset=offset, loose=loose)

        part = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(groups)).cast("long")
        return df.withColumn("part", part).groupBy("part").applyInPandas(run, schema)

    first = Table(placed(pieces, pieces.count(), 0, 1), "packed").df
    again = first.where("loose").drop("sequence_id", "offset", "loose")
    n = again.count()
    out = first.where("not loose")
    if n:
        out = out.unionByName(placed(again, n, 1 << 20, 0))
    return out.drop("loose")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: pack all documents."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op9_packing": op9_packing}
ORACLE: dict[str, str] = {}
