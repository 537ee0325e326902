"""Operator 5 - near-duplicate documents by MinHash with tensored banding.

Two small collections of ``half`` keys are made, each key from ``rows`` minhashes;
a table's key combines one key of either collection, so half * half tables need
only 2 * half * rows minhashes, about a square root of what tables of their own
would take. Sharing a table's key makes a candidate; every candidate is confirmed
on the full shingle sets.

With half = 10 and rows = 2 a pair at similarity 0.8 is missed with probability
2 * (1 - 0.8 ** 2) ** 10 = 0.00007, and less above.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.llm.bpe import in_blocks
from querykiln.llm.bytekit import Words, mixed, shingles
from querykiln.llm.common import Table, columns_of, components, contract

SHINGLE = 5
PERCENT = 80
HALF, ROWS = 10, 2
#: Nodes of a block, about; a task compares two blocks.
BLOCK = 256
_RNG = np.random.Generator(np.random.PCG64(77))
_ODD = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(1, 2**63, 256, dtype=np.uint64)


def half_keys(sets: np.ndarray, offsets: np.ndarray, half: int, rows: int) -> np.ndarray:
    """(texts, 2 * half) keys; texts without shingles have undefined rows."""
    out = np.zeros((len(offsets) - 1, 2 * half), np.uint64)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if not len(some):
        return out
    starts = offsets[some]
    for c in range(2 * half):
        key = np.full(len(some), c + 1, np.uint64)
        for r in range(rows):
            f = c * rows + r
            low = np.minimum.reduceat(((sets * _ODD[f] + _ADD[f]) >> np.uint64(32)).astype(np.uint32), starts)
            key = mixed(key + low)
        out[some, c] = key
    return out


def signatures(docs: DataFrame, k: int, half: int = HALF, rows: int = ROWS) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, klass (digest of the shingle set, null if empty), keys (2 * half longs)."""

    def run(batches):
        for batch in batches:
            doc, th, texts = batch.column("doc_id").cast(pa.int64()), batch.column("th"), batch.column("text").to_pylist()
            for a, b in in_blocks(texts, 1_000_000):
                sets, offsets = shingles(Words(texts[a:b], lower=True), k)
                keys = half_keys(sets, offsets, half, rows).view(np.int64)
                n = np.diff(offsets)
                klass = [hashlib.blake2b(sets[s:e].tobytes(), digest_size=16).digest() if e > s else None for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([doc.slice(a, b - a), th.slice(a, b - a), pa.array(n, pa.int64()), pa.array(klass, pa.binary()), pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * 2 * half, pa.array(keys.ravel()))], ["doc_id", "th", "n_shingles", "klass", "keys"])

    return columns_of(docs, "doc_id", "text").withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, n_shingles long, klass binary, keys array<long>")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose whole shingle sets are similar enough."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("u", "v", "tu", "tv")]
            known: dict[str, int] = {}
            at = [[known.setdefault(t or "", len(known)) for t in c] for c in cols[2:]]
            sets, distinct = [], list(known)
            for a, b in in_blocks(distinct, 1_000_000):
                s, o = shingles(Words(distinct[a:b], lower=True), k)
                sets += [s[x:y] for x, y in zip(o[:-1].tolist(), o[1:].tolist())]
            ok = []
            for i, j in zip(*at):
                x, y = sets[i], sets[j]
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) and len(y) else 0
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])

    right = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
    both = right.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
    return both.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long").distinct()


def _tables(nodes: DataFrame, half: int) -> DataFrame:
    """(key, node) of all half * half tables, but for keys whose either half no other node has."""
    halves = nodes.select("node", F.posexplode("keys").alias("c", "h"))
    shared = halves.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("h")
    live = halves.join(shared, "h").groupBy("node").agg(*(F.collect_list(F.when(F.col("c") < half if side == 0 else F.col("c") >= half, F.col("h"))).alias(f"s{side}") for side in (0, 1)))
    return live.select("node", F.explode("s0").alias("x"), "s1").select("node", "x", F.explode("s1").alias("y")).select(F.xxhash64("x", "y").alias("key"), "node")


def _hops(links: DataFrame) -> DataFrame:
    """(node, component) after two hops to the smallest linked node: equal labels are linked, unequal ones may be."""
    one = links.groupBy(F.greatest("u", "v").alias("node")).agg(F.min(F.least("u", "v")).alias("up"))
    two = one.join(one.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left")
    return Table(two.select("node", F.coalesce("top", "up").alias("component")), "labels", small=True).df


def _spread(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(key, node, comp) of the keys whose nodes aren't all of one component."""
    if comps is None:
        return members.withColumn("comp", F.col("node"))
    now = members.join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    open_ = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return now.join(open_, "key", "left_semi")


def _across(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between nodes of one family but different components; enough of them to join what is linked.

    A family's nodes are dealt to blocks, each pair of blocks is one task that counts
    the shared shingles of its nodes as a product of incidence matrices. So no pair
    becomes a row, no task holds a whole family, and none is skipped.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        if pdf["comp"].nunique() < 2:
            return none
        sets = []
        for a, b in in_blocks(pdf["text"].tolist(), 1_000_000):
            x, o = shingles(Words(pdf["text"].iloc[a:b].tolist(), lower=True), k)
            sets += [x[i:j] for i, j in zip(o[:-1].tolist(), o[1:].tolist())]
        n = np.array([len(x) for x in sets])
        of = np.repeat(np.arange(len(sets)), n)
        _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        use = count[inverse] > 1
        row, col = of[use], number[inverse[use]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            i, j = np.searchsorted(col, [c, c + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[row[i:j], col[i:j] - c] = 1
            both += m @ m.T
        comp, block, node = pdf["comp"].to_numpy(), pdf["block"].to_numpy(), pdf["node"].to_numpy()
        ok = (100 * both.astype(np.float64) >= percent * (n[:, None] + n[None, :] - both.astype(np.float64))) & (comp[:, None] != comp[None, :])
        if key[1] != key[2]:
            ok &= block[:, None] != block[None, :]
        u, v = np.nonzero(np.triu(ok, 1))
        return pd.concat(contract([pd.DataFrame({"u": node[u], "v": node[v]})])) if len(u) else none

    many = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(many, "family").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return dealt.groupBy("family", "i", "j").applyInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, half: int = HALF, rows: int = ROWS) -> DataFrame:
    """Components of documents whose k-word shingle sets have Jaccard >= percent / 100.

    Words are runs of other than ASCII white space, A-Z lower-cased. Returns one row
    per input row: doc_id, n_shingles, component_id (smallest doc_id reachable, its
    own included), kept (doc_id = component_id). Null, empty and blank texts have no
    shingle and link with nothing; with fewer than k words the whole sequence is the
    one shingle. Repeated rows each get a row; rows of one doc_id but other texts go
    by their own text. Extra columns are ignored; an empty table gives no rows.

    Texts with equal sets are one node. Candidates are confirmed in three rounds, so
    that a group of n copies costs about n checks: each node against the smallest
    node it shares a key with; then, per key, one node of each component against the
    smallest; then, block by block, all nodes of a family (nodes joined by keys that
    still have more than one component). So no candidate stays unchecked.
    """
    held: list[Table] = []

    def table(df: DataFrame, name: str, small: bool = False) -> DataFrame:
        held.append(Table(df, name, small))
        return held[-1].df

    sig = table(signatures(docs, k, half, rows), "signatures")
    own = sig.where("klass is not null and doc_id is not null")
    first = own.groupBy("klass").agg(F.min(F.struct("doc_id", "th")).alias("f"), F.first("keys").alias("keys"))
    klass = table(first.select("klass", "f.doc_id", "f.th", "keys", F.monotonically_increasing_id().alias("node")), "klass")
    keyed = _tables(klass, half)
    shared = keyed.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("top")).where("rep < top").select("key", "rep")
    members = table(keyed.join(shared, "key"), "members")
    nodes = klass.select("node", "doc_id", "th").join(members.select("node").distinct(), "node", "left_semi")
    whole = columns_of(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
    texts = table(whole.join(nodes, ["doc_id", "th"]).groupBy("doc_id", "th", "node").agg(F.first("text").alias("text")).select("node", "text"), "texts")
    members, firsts = members.select("key", "node"), members.groupBy("node").agg(F.min("rep").alias("u"))

    todo = table(firsts.where("u < node").select("u", F.col("node").alias("v")), "pairs", small=True)
    links = table(verify(todo, texts, k, percent), "links", small=True)

    mixed_keys = table(_spread(members, _hops(links)), "spread")
    per = mixed_keys.groupBy("key", "comp").agg(F.min("node").alias("v"))
    low = per.groupBy("key").agg(F.min(F.struct("v", "comp")).alias("low"))
    pairs = per.join(low, "key").where("comp <> low.comp").select(F.col("low.v").alias("u"), "v").distinct()
    more = table(pairs.join(todo, ["u", "v"], "left_anti"), "pairs", small=True)
    links = table(verify(more, texts, k, percent).unionByName(links), "links", small=True)

    comps = _hops(links)
    mixed_keys = _spread(mixed_keys.select("key", "node"), comps)
    lowest = mixed_keys.groupBy("key").agg(F.min("node").alias("u"))
    families = components(mixed_keys.join(lowest, "key").select("u", F.col("node").alias("v")))
    named = families.withColumnRenamed("component", "family").join(comps, "node", "left")
    members = table(named.select("node", "family", F.coalesce("component", "node").alias("comp")), "families", small=True)
    comps = components(_across(members, texts, k, percent).unionByName(links))

    named = klass.select("klass", "node", "doc_id").join(comps, "node", "left").select("klass", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = named.join(least, "component").select("klass", "component_id")
    out = sig.select("doc_id", "n_shingles", "klass").join(final, "klass", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = Table(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates").df
    for t in held:
        t.drop()
    return out


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: near-duplicates of all documents on 4-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)


QUERIES = {"op5_minhash": op5_minhash}
#: Every pair that shares a shingle is counted in full; links are followed to a fixed point.
ORACLE = {
    "op5_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh
  FROM w
), k AS (SELECT min(doc_id) AS node, len(any_value(sh)) AS n, list_sort(sh) AS key, any_value(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
e AS (SELECT node, n, unnest(sh) AS x FROM k),
p AS (
  SELECT a.node AS u, b.node AS v FROM e a JOIN e b ON a.x = b.x AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT node, node AS c FROM k UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.node),
m AS (SELECT node, min(c) AS c FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id, s.doc_id = coalesce(m.c, s.doc_id) AS kept
FROM s LEFT JOIN k ON k.key = list_sort(s.sh) LEFT JOIN m ON m.node = k.node
"""
}
