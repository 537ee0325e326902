"""Graphs that are built once a shard find what brute force finds, also where they are small."""

import numpy as np

from querykiln.llm import neighbors


def test_small_graphs_are_used_and_measured():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(300, 16))
    x = np.concatenate([c, c[:150] + rng.normal(size=(150, 16)) * 0.05])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    s = neighbors.Searcher(x, 0.93, beam=8)
    u, v = s.links(x)
    truth = neighbors._pairs(*np.nonzero(x @ x.T >= 0.93), len(x), True)
    assert s.beam < len(x) and s.true == len(truth) >= 150 and s.found >= 0.99 * s.true
    assert (neighbors._pairs(u, v, len(x), True) == truth).all()


def test_one_id_with_two_vectors_and_no_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (0, [0.01, 1.0], 0), (5, [1.0, 1.0], 0), (5, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbors.near_duplicates(df).collect())
    assert got == [(0, 1, 0, True), (1, 1, 0, False), (1, 1, 1, True), (2, 1, 1, False), (5, 1, 5, True), (5, 1, 5, True)]
    assert neighbors.near_duplicates(df.limit(0)).count() == 0


def test_many_shards(spark, monkeypatch):
    rng = np.random.default_rng(6)
    c = rng.normal(size=(60, 8))
    x = np.concatenate([c, c + rng.normal(size=c.shape) * 0.1, c[:20]])
    df = spark.createDataFrame([(i, [float(a) for a in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    want = (u @ u.T >= 0.93).sum(1) - 1
    for shard in (1000, 40, 11):
        got = {r.vec_id: r.n_links for r in neighbors.near_duplicates(df, shard=shard, beam=6).collect()}
        assert got == dict(enumerate(want.tolist()))
