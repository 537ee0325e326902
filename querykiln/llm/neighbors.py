"""Operator 3 - near-duplicate embeddings by navigable small-world graphs per shard.

Vectors of one label are dealt to shards of bounded size. Each shard's hierarchical
navigable small-world graph is built once and queried by the shard's own vectors and, a
block at a time, by those of half of the other shards, so that each pair of shards meets
once. Beams widen until an audit against brute force passes, which draws queries until it
has seen enough true links; queries whose beams are full of links are scanned exactly, as
is a block that no beam gets through its audit. Hits are confirmed by cosine in double
precision. A task holds one shard and one block and returns counts and a spanning forest
of its links, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.llm.common import Table, _roots, columns_of, components

COSINE = 0.93
#: Distinct vectors of a shard, about, and of a block of queries.
SHARD, BLOCK = 16_384, 4_096
LINKS, BEAM = 16, 48
#: Queries an audit draws at a time, distinct true links it must have seen, and the share of them to be found.
AUDIT, SEEN, RECALL = 256, 300, 0.99


class SmallWorld:
    """Graph layers over unit vectors, built a batch at a time from the top layer down."""

    def __init__(self, x: np.ndarray, links: int = LINKS, beam: int = BEAM, seed: int = 11):
        self.x = np.ascontiguousarray(x, np.float32)
        self.links, self.beam = links, beam
        n = len(x)
        level = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 6)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # (adjacency over all ids, members)
        for lv in range(int(level.max()) if n else -1, -1, -1):
            order = np.argsort(-level, kind="stable")
            members = order[level[order] >= lv]
            self.layers.append((np.full((n, 2 * links if lv == 0 else links), -1, np.int32), members))
            self._build(*self.layers[-1])

    def _build(self, near: np.ndarray, members: np.ndarray) -> None:
        done, n = min(len(members), 32), len(members)
        self._join(near, members[:done], members[:done], self.x[members[:done]] @ self.x[members[:done]].T)
        while done < n:
            batch = members[done : done + min(256, done)]
            q = self.x[batch]
            ids, sims = self._beam(q, self._entries(q, near, members[:1]), near, self.beam)
            own = q @ q.T
            np.fill_diagonal(own, -2)
            ids = np.concatenate([ids, np.broadcast_to(batch, (len(batch), len(batch)))], 1)
            self._join(near, batch, ids, np.concatenate([sims, own], 1))
            done += len(batch)

    def _entries(self, q: np.ndarray, near: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where to enter a layer: the best found in the layers above it."""
        at = np.broadcast_to(self.layers[0][1][:1], (len(q), 1))
        for layer, _ in self.layers:
            if layer is near:
                break
            at = self._beam(q, at, layer, 8)[0]
        return np.where(at >= 0, at, first[0])

    def _join(self, near: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Link new nodes to diverse close candidates, and these back; a row that is full keeps its closest."""
        if ids.ndim == 1:
            ids = np.broadcast_to(ids, sims.shape)
        pick = np.argsort(-sims, 1, kind="stable")[:, : 3 * self.links]
        ids, sims = np.take_along_axis(ids, pick, 1), np.take_along_axis(sims, pick, 1)
        ok = (ids >= 0) & (ids != new[:, None]) & (sims > -2)
        vectors = self.x[np.maximum(ids, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        chosen, nearest = np.zeros(ids.shape, bool), np.full(ids.shape, -3.0, np.float32)
        for k in range(ids.shape[1]):  # keep one that is closer to the node than to those kept
            take = ok[:, k] & (chosen.sum(1) < self.links) & (nearest[:, k] < sims[:, k])
            chosen[:, k] = take
            nearest = np.where(take[:, None], np.maximum(nearest, between[:, k, :]), nearest)
        rank = np.argsort(np.where(chosen, 0, np.where(ok, 1, 2)), 1, kind="stable")[:, : self.links]
        mine = np.where(np.take_along_axis(ok, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        near[new, : mine.shape[1]] = mine
        to, back = mine.ravel(), np.repeat(new, mine.shape[1])
        to, back = to[to >= 0], back[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        for c in range(0, len(targets), 256):
            t, f, n = targets[c : c + 256], first[c : c + 256], count[c : c + 256]
            more = np.full((len(t), n.max()), -1, np.int64)
            row = np.repeat(np.arange(len(t)), n)
            more[row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = back[f[0] : f[0] + n.sum()]
            both = np.sort(np.concatenate([near[t], more], 1), 1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            s = np.where(both >= 0, np.einsum("td,tkd->tk", self.x[t], self.x[np.maximum(both, 0)]), -2)
            keep = np.argsort(-s, 1, kind="stable")[:, : near.shape[1]]
            near[t] = np.take_along_axis(both, keep, 1)

    def _beam(self, q: np.ndarray, entry: np.ndarray, near: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in step: (ids, similarities), best first, -1 where fewer."""
        n = len(q)
        ids, sims = np.full((n, beam), -1, np.int64), np.full((n, beam), -2.0, np.float32)
        seen = np.zeros((n, len(self.x)), bool)
        entry = np.sort(entry, 1)[:, :beam]
        s = np.einsum("bd,bed->be", q, self.x[entry])
        s[:, 1:][entry[:, 1:] == entry[:, :-1]] = -2
        ids[:, : entry.shape[1]], sims[:, : entry.shape[1]] = np.where(s > -2, entry, -1), s
        seen[np.arange(n)[:, None], entry] = True
        open_ = ids >= 0
        live = np.arange(n)
        while len(live):
            best = np.where(open_[live], sims[live], -3).argmax(1)
            go = open_[live, best]
            live, best = live[go], best[go]
            if not len(live):
                break
            open_[live, best] = False
            new = near[ids[live, best]].astype(np.int64)
            ok = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
            seen[np.broadcast_to(live[:, None], new.shape)[ok], new[ok]] = True
            s = np.where(ok, np.einsum("bd,bed->be", q[live], self.x[np.maximum(new, 0)]), -2)
            all_s = np.concatenate([sims[live], s], 1)
            all_i = np.concatenate([ids[live], np.where(ok, new, -1)], 1)
            all_o = np.concatenate([open_[live], ok], 1)
            keep = np.argpartition(-all_s, beam - 1, 1)[:, :beam]
            ids[live], sims[live], open_[live] = (np.take_along_axis(a, keep, 1) for a in (all_i, all_s, all_o))
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        near, members = self.layers[-1]
        return self._beam(q, self._entries(q, near, members[:1]), near, beam)


def _pairs(u: np.ndarray, v: np.ndarray, n: int, same: bool) -> np.ndarray:
    """Distinct pairs as one number each; if the queries are the index, without order and self-matches."""
    if same:
        u, v = np.minimum(u, v)[u != v], np.maximum(u, v)[u != v]
    return np.unique(u.astype(np.int64) * n + v)


def _audit(index: np.ndarray, queries: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """All matches (query, indexed) of queries drawn at random, and whether ``SEEN`` distinct links came before the queries ran out."""
    order = np.random.default_rng(1).permutation(len(queries))
    us, vs, seen = [], [], 0
    for a in range(0, len(order), AUDIT):
        drawn = order[a : a + AUDIT]
        u, v = np.nonzero(queries[drawn] @ index.T >= cosine)
        us.append(drawn[u])
        vs.append(v)
        seen += len(_pairs(us[-1], v, len(index), same))
        if seen >= SEEN:  # blocks may share links: count them all together
            seen = len(_pairs(np.concatenate(us), np.concatenate(vs), len(index), same))
        if seen >= SEEN and a + AUDIT < len(order):
            return np.concatenate(us), np.concatenate(vs), True
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs]), False


class Searcher:
    """The graph of a shard and what its audits have seen so far."""

    def __init__(self, index: np.ndarray, cosine: float, beam: int = BEAM):
        self.index, self.cosine, self.beam = index, cosine, min(beam, len(index))
        self.graph, self.enough = SmallWorld(index), False
        #: Of the true links in audits: how many, and how many the graph found before any exact scan.
        self.true, self.found = 0, 0

    def links(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, indexed) with cosine of at least ``cosine``; of the index with itself if ``queries`` is it.

        Each block is audited: until ``SEEN`` true links have been seen by drawn queries,
        of this block and those before; then by one draw a block.
        """
        same = queries is self.index
        if self.enough:
            drawn = np.random.default_rng(len(queries)).permutation(len(queries))[:AUDIT]
            u, v = np.nonzero(queries[drawn] @ self.index.T >= self.cosine)
            true_u, true_v = drawn[u], v
        else:
            true_u, true_v, self.enough = _audit(self.index, queries, self.cosine, same)
        truth = _pairs(true_u, true_v, len(self.index), same)
        while True:
            u, v = self._searched(queries)
            found = np.isin(truth, _pairs(u, v, len(self.index), same)).sum()
            if found >= RECALL * len(truth):
                break
            if self.beam == len(self.index):  # nor does a beam that holds all
                u, v = self._scanned(queries, np.arange(len(queries)))
                break
            self.beam = min(2 * self.beam, len(self.index))
        self.true, self.found = self.true + len(truth), self.found + int(found)
        return np.concatenate([u, true_u]), np.concatenate([v, true_v])

    def _searched(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the graph finds with this beam, confirmed; queries that fill half of it are scanned."""
        us, vs, full, q32 = [], [], [], queries.astype(np.float32)
        for a in range(0, len(queries), 256):
            ids, sims = self.graph.query(q32[a : a + 256], self.beam)
            hit = (sims >= self.cosine - 1e-4) & (ids >= 0)
            crowded = hit.sum(1) * 2 > self.beam if self.beam < len(self.index) else np.zeros(len(hit), bool)
            full.append(a + np.flatnonzero(crowded))
            u, k = np.nonzero(hit & ~crowded[:, None])
            us.append(u + a)
            vs.append(ids[u, k])
        u, v, full = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs, full))
        good = np.einsum("nd,nd->n", queries[u], self.index[v]) >= self.cosine
        x, y = self._scanned(queries, full)
        return np.concatenate([u[good], x]), np.concatenate([v[good], y])

    def _scanned(self, queries: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(which), 512):
            x, y = np.nonzero(queries[which[a : a + 512]] @ self.index.T >= self.cosine)
            us.append(which[a : a + 512][x])
            vs.append(y)
        return np.concatenate(us), np.concatenate(vs)


def links_of(index: np.ndarray, queries: np.ndarray, cosine: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, indexed) of unit vectors in double precision with cosine of at least ``cosine``."""
    return Searcher(index, cosine, beam).links(queries)


class _Shard:
    """One shard as its rows come in: first its own vectors, then blocks of queries."""

    def __init__(self, cosine: float, beam: int):
        self.cosine, self.beam, self.searcher = cosine, beam, None
        self.held: list[pd.DataFrame] = []

    @staticmethod
    def _unit(rows: pd.DataFrame) -> np.ndarray:
        x = np.stack(rows["x"].to_numpy()).astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def _made(self, rows: pd.DataFrame, u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        """Counts and forest of the links of ``rows`` (query places u) with the shard's (places v)."""
        a, b = rows["node"].to_numpy()[u], self.node[v]
        own = rows is self.rows
        ca, cb = rows["copies"].to_numpy()[u], self.rows["copies"].to_numpy()[v]
        swap = a > b
        lo, hi, cl, ch = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, cb, ca), np.where(swap, ca, cb)
        far = np.flatnonzero(lo != hi) if own else np.arange(len(lo))
        _, one = np.unique(np.column_stack([lo[far], hi[far]]), axis=0, return_index=True)
        at = far[one]
        if not len(at):
            return pd.DataFrame({"node": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        node, inverse = np.unique(np.concatenate([lo[at], hi[at]]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([ch[at], cl[at]])).astype(np.int64)
        who, root = _roots(lo[at], hi[at])
        return pd.DataFrame({"node": node, "n": n, "root": root[np.searchsorted(who, node)]})

    def index(self) -> pd.DataFrame:
        self.rows = pd.concat(self.held, ignore_index=True)
        self.node, self.held = self.rows["node"].to_numpy(), []
        x = self._unit(self.rows)
        self.searcher = Searcher(x, self.cosine, self.beam)
        return self._made(self.rows, *self.searcher.links(x))

    def block(self) -> pd.DataFrame:
        rows, self.held = pd.concat(self.held, ignore_index=True), []
        return self._made(rows, *self.searcher.links(self._unit(rows)))


def _search(cosine: float, beam: int):
    """Over rows sorted by shard, a shard's own vectors first: links of each shard, graphs built once."""

    def run(frames):
        key, shard = None, None

        def rest(shard):
            if shard is not None and shard.held:
                yield shard.index() if shard.searcher is None else shard.block()

        for pdf in frames:
            for (label, d, at, guest), part in pdf.groupby(["label", "d", "at", "guest"], sort=True):
                if (label, d, at) != key:
                    yield from rest(shard)
                    key, shard = (label, d, at), _Shard(cosine, beam)
                if guest and shard.searcher is None:
                    yield shard.index()
                for a in range(0, len(part), BLOCK):
                    shard.held.append(part.iloc[a : a + BLOCK])
                    if guest and sum(map(len, shard.held)) >= BLOCK:
                        yield shard.block()
        yield from rest(shard)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors link when their labels are equal and not null, they have as many
    components, and their cosine in double precision is at least ``cosine``. Null,
    empty and zero vectors and those with null or non-finite components link with
    nothing. Equal vectors are one node, counted as often as they occur; vectors that
    share a vec_id go by their own value. Repeated rows each get a row. Extra columns
    are ignored; an empty table gives no rows.
    """
    rows = columns_of(vectors, "vec_id", "embedding", "label")
    rows = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"), F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(3), "embedding", "label").alias("h2"))
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    distinct = rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("x").alias("x"), F.size(F.first("x")).alias("d"))
    nodes = Table(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    many = nodes.df.groupBy("label", "d").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = nodes.df.select("label", "d", "node", "copies", "x").join(many, ["label", "d"]).withColumn("own", F.pmod(F.xxhash64("node"), "shards").cast("int"))
    # of two shards the one that is less far ahead, round the ring, is the index: each has half of the others as guests
    ahead = F.pmod(F.col("own") - F.col("at"), F.col("shards"))
    meets = (ahead == 0) | (2 * ahead < F.col("shards")) | (2 * ahead == F.col("shards")) & (F.col("at") < F.col("own"))
    dealt = dealt.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where(meets)
    dealt = dealt.select("label", "d", "at", (F.col("own") != F.col("at")).alias("guest"), "node", "copies", "x")
    by = ["label", "d", "at"]
    sorted_ = dealt.repartition(*by).sortWithinPartitions(*by, "guest", "node")
    found = Table(sorted_.mapInPandas(_search(cosine, beam), "node long, n long, root long"), "links", small=False)
    comps = components(found.df.select(F.col("root").alias("u"), F.col("node").alias("v")))
    counts = found.df.groupBy("node").agg(F.sum("n").alias("n"))
    known = nodes.df.select("h1", "h2", "node", "copies", "first_id").join(counts, "node", "left").join(comps, "node", "left").select("h1", "h2", "copies", "n", "first_id", F.coalesce("component", "node").alias("component"))
    least = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = known.join(least, "component").select("h1", "h2", F.lit(True).alias("ok"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "h1", "h2", "ok").join(known, ["h1", "h2", "ok"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = Table(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "neighbors").df
    nodes.drop()
    found.drop()
    return out


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: near-duplicates of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op3_hnsw": op3_hnsw}
ORACLE = {
    "op3_hnsw": """
WITH RECURSIVE x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS r FROM x
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(e, e) > 0
),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.93),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.w, r.c FROM r JOIN l ON l.u = r.vec_id),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY u)
SELECT m.vec_id, coalesce(n.n_links, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""
}
