"""BM25 of very many long queries: blocks of queries meet blocks of documents as matrices.

Queries of whole texts share a term with nearly every document, so their hits, and even
their scored pairs, are too many to be rows. Here postings are packed into blocks of
``DOCS`` documents and query terms into blocks of about ``QUERIES`` queries; each pair of
blocks is scored in memory, and only the best of each query leave it. A task holds one
block of each kind and one matrix of scores, whatever the corpus; disk holds the blocks.
Terms go by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from querykiln.sources.shared import kept, set_while

DOCS, QUERIES = 4096, 512
#: A term with more hits in a pair of blocks than this goes by matrix product, the others hit by hit.
DENSE = 20_000
_ONE = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1}


def _pack_docs(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "doc_idx"])
    docs, at = np.unique(pdf["doc_idx"].to_numpy(np.int64), return_inverse=True)
    terms, start = np.unique(pdf["h"].to_numpy(np.int64), return_index=True)
    ptr = np.append(start, len(pdf)).astype(np.int64)
    parts = (docs, terms, ptr, at.astype(np.int32), pdf["w"].to_numpy(np.float64))
    return pd.DataFrame([[x.tobytes() for x in parts]], columns=["docs", "terms", "ptr", "at", "dw"])


def _pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["qid", "pos"])
    qids, q = np.unique(pdf["qid"].to_numpy(np.int64), return_inverse=True)
    parts = (qids, q.astype(np.int32), pdf["h"].to_numpy(np.int64), pdf["w"].to_numpy(np.float64), pdf["pos"].to_numpy(np.int32), pdf["opens"].to_numpy(bool))
    return pd.DataFrame([[int(pdf["b"].iloc[0]), *(x.tobytes() for x in parts)]], columns=["b", "qids", "q", "h", "qw", "pos", "opens"])


def _array(row: dict, name: str, kind) -> np.ndarray:
    return np.frombuffer(row[name], kind)


class _Pair:
    """A block of queries and one of documents: the entries (query, term) that hit, and what they hit."""

    def __init__(self, row: dict):
        self.docs, self.qids = _array(row, "docs", np.int64), _array(row, "qids", np.int64)
        terms, self.ptr, self.at, self.dw = _array(row, "terms", np.int64), _array(row, "ptr", np.int64), _array(row, "at", np.int32), _array(row, "dw", np.float64)
        h = _array(row, "h", np.int64)
        j = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        hit = terms[j] == h
        self.j, self.q, self.qw, self.pos, self.opens = j[hit], _array(row, "q", np.int32)[hit], _array(row, "qw", np.float64)[hit], _array(row, "pos", np.int32)[hit], _array(row, "opens", bool)[hit]
        self.used, self.slot = np.unique(self.j, return_inverse=True)

    def _hits(self, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the terms j one after another: the place in j and the place in the postings of each hit."""
        n = self.ptr[j + 1] - self.ptr[j]
        of = np.repeat(np.arange(len(j)), n)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ptr[j], n)

    def scores(self) -> np.ndarray:
        nq, nd = len(self.qids), len(self.docs)
        many = np.bincount(self.slot, minlength=len(self.used)) * (self.ptr[self.used + 1] - self.ptr[self.used]) > DENSE
        row_of = np.cumsum(many) - 1
        of, p = self._hits(self.used[many])
        dense = np.zeros((int(many.sum()), nd))
        dense[of, self.at[p]] = self.dw[p]
        is_dense = many[self.slot]
        asked = np.zeros((nq, len(dense)))
        asked[self.q[is_dense], row_of[self.slot[is_dense]]] = self.qw[is_dense]
        out = asked @ dense
        q, w = self.q[~is_dense].astype(np.int64), self.qw[~is_dense]
        of, p = self._hits(self.j[~is_dense])
        if len(p):
            out += np.bincount(q[of] * nd + self.at[p], weights=w[of] * self.dw[p], minlength=nq * nd).reshape(nq, nd)
        return out

    def bits(self) -> np.ndarray:
        """For each term that is hit, a bit for each document that has it."""
        out = np.zeros((len(self.used), len(self.docs)), bool)
        of, p = self._hits(self.used)
        out[of, self.at[p]] = True
        return np.packbits(out, axis=1)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, pos, how many documents have it as the query's first term)."""
        bits, out, last, seen = self.bits(), [], -1, None
        for q, slot, pos in zip(self.q.tolist(), self.slot.tolist(), self.pos.tolist()):  # by query and pos
            if q != last:
                last, seen = q, np.zeros(bits.shape[1], np.uint8)
            new = bits[slot] & ~seen
            if n := int(np.bitwise_count(new).sum(dtype=np.int64)):
                out.append((q, pos, n))
                seen |= new
        return tuple(np.array(out, np.int64).reshape(-1, 3).T)

    def shut(self) -> np.ndarray:
        """Query by document: whether none of the terms that open candidates is in it."""
        bits, open_ = self.bits(), np.zeros((len(self.qids), (len(self.docs) + 7) // 8), np.uint8)
        np.bitwise_or.at(open_, self.q[self.opens], bits[self.slot[self.opens]])
        return ~np.unpackbits(open_, axis=1, count=len(self.docs)).astype(bool)


def _blocks(batches):
    """(row, whether its block of queries is another than the last row's)."""
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            yield row, row["b"] != last
            last = row["b"]


def _count(batches):
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            pair = _Pair(row)
            q, pos, n = pair.entries()
            yield pa.RecordBatch.from_pydict({"qid": pair.qids[q], "entry": pos.astype(np.int32), "c": n})


def _best(top: int, capped: bool):
    def run(batches):
        import pyarrow as pa

        best = None
        out = lambda: pa.RecordBatch.from_pydict(dict(zip(("qid", "doc_idx", "score"), best)))
        for row, other in _blocks(batches):
            pair = _Pair(row)
            s = pair.scores()
            if capped:
                s[pair.shut()] = 0
            k = min(top, s.shape[1])
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            q, d = np.nonzero((s >= least[:, None] - 1e-8) & (s > 0))
            new = pair.qids[q], pair.docs[d], s[q, d]
            if other and best is not None:
                yield out()
            best = new if other or best is None else tuple(map(np.concatenate, zip(best, new)))
            order = np.lexsort((best[1], -np.round(best[2], 9), best[0]))
            best = tuple(x[order] for x in best)
            first = np.r_[True, best[0][1:] != best[0][:-1]] if len(order) else np.zeros(0, bool)
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else first
            best = tuple(x[rank < top] for x in best)
        if best is not None:
            yield out()

    return run


def _query_blocks(terms: DataFrame, n: int) -> DataFrame:
    """terms: qid, term, w, pos, opens."""
    rows = terms.select(F.pmod(F.xxhash64("qid"), F.lit(n)).alias("b"), "qid", F.xxhash64("term").alias("h"), "w", "pos", "opens")
    return kept(rows.groupBy("b").applyInPandas(_pack_queries, "b long, qids binary, q binary, h binary, qw binary, pos binary, opens binary"))


def top_of_blocks(parts: DataFrame, terms: DataFrame, n_docs: int, k: int, max_candidates: int | None) -> DataFrame:
    """(qid, doc_idx, score, rank) of the best k of each query.

    parts: doc_idx, term, w (what the term adds to a score for each unit of a query's
    weight); terms: qid (long), term, w, pos, the first place of the term in the query.
    """
    spark = parts.sparkSession
    n = max(1, -(-terms.select("qid").distinct().count() // QUERIES))
    docs = parts.select(F.floor(F.col("doc_idx") / DOCS).alias("b"), "doc_idx", F.xxhash64("term").alias("h"), "w")
    docs = kept(docs.groupBy("b").applyInPandas(_pack_docs, "docs binary, terms binary, ptr binary, at binary, dw binary"))
    capped = max_candidates is not None and n_docs > max_candidates  # else none is cut off
    terms = terms.withColumn("opens", F.lit(True))
    with set_while(spark, _ONE):
        if capped:
            per = _query_blocks(terms, n).crossJoin(docs).mapInArrow(_count, "qid long, entry int, c long")
            per = kept(per.groupBy("qid", "entry").agg(F.sum("c").alias("c")))
            before = F.coalesce(F.sum("c").over(W.partitionBy("qid").orderBy("entry").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            last = per.withColumn("before", before).where(F.col("before") < max_candidates).groupBy("qid").agg(F.max("entry").alias("last"))
            terms = terms.join(last, "qid").withColumn("opens", F.col("pos") <= F.col("last"))
        best = kept(_query_blocks(terms, n).crossJoin(docs).mapInArrow(_best(k, capped), "qid long, doc_idx long, score double"))
    w = W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_idx")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
