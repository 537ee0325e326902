"""Recall of the graph over distinct pairs, where links are few."""

import numpy as np
import pytest

from querykiln.llm import neighbors


def unit(x):
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distinct(u, v, same):
    return {(min(a, b), max(a, b)) if same else (a, b) for a, b in zip(u.tolist(), v.tolist()) if not same or a != b}


class SelfOnly:
    """A graph that finds of each query only what equals it."""

    def __init__(self, x):
        self.at = {r.astype(np.float32).tobytes(): i for i, r in enumerate(x)}

    def query(self, q, beam):
        ids, sims = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -2.0, np.float32)
        for i, r in enumerate(q):
            if (k := self.at.get(r.tobytes())) is not None:
                ids[i, 0], sims[i, 0] = k, 1
        return ids, sims


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("graph", [neighbors.SmallWorld, SelfOnly])
def test_few_links_are_all_found(same, graph, monkeypatch):
    monkeypatch.setattr(neighbors, "SmallWorld", graph)
    rng = np.random.default_rng(8)
    a, b = unit(rng.normal(size=(3000, 64))), rng.normal(size=(3000, 64))
    b[:40] = a[rng.permutation(3000)[:40]] + rng.normal(size=(40, 64)) * 0.03
    x = np.concatenate([a, unit(b)]) if same else a
    q = x if same else unit(b)
    truth = distinct(*np.nonzero(q @ x.T >= 0.93), same)
    assert len(truth) >= 40 and distinct(*neighbors.links_of(x, q, 0.93), same) == truth


def test_recall_over_distinct_pairs_with_many_links():
    rng = np.random.default_rng(9)
    c = unit(rng.normal(size=(2000, 32)))
    x = unit(np.concatenate([c, c + rng.normal(size=c.shape) * 0.03, rng.normal(size=(2000, 32))]))
    truth = distinct(*np.nonzero(x @ x.T >= 0.93), True)
    found = distinct(*neighbors.links_of(x, x, 0.93), True)
    print("recall over distinct pairs", len(found & truth) / len(truth), "of", len(truth))
    assert found <= truth and len(found) >= 0.985 * len(truth)
    assert neighbors._audit(x, x, 0.93, True)[2] and not neighbors._audit(x[:10], x[:10], 0.93, False)[2]
