"""Notices are found wherever they stand and wherever words are put into them; kin are told apart."""

import random

import pytest

from querykiln.llm import licenses


@pytest.mark.parametrize("put", [0, 17, 41, 60, 86])
@pytest.mark.parametrize("before", [0, 1, 30, 77, 200, 511])
def test_stretched_notice(put, before):
    s, rng = licenses.Scanner(), random.Random(put)
    words = licenses.TEMPLATES["MIT grant"].split()
    fill = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    for place in (10, 43, 70):
        text = " ".join([*fill(before), *words[:place], *fill(put), *words[place:], *fill(40)])
        assert [(n, c) for n, c, _, _ in s.scan(text)] == [("MIT grant", 1.0)]


def test_copies_and_kin():
    s = licenses.Scanner()
    names = lambda t: [m[0] for m in s.scan(t)]
    for k in licenses.TEMPLATES:
        assert names(f"x y z {licenses.TEMPLATES[k]} and so on") == [k]
        assert names("\n".join([licenses.TEMPLATES[k]] * 3)) == [k] * 3
    assert names("Released under the XYZ License.") == [] and names("Licensed under CC BY 3.0.") == []
    assert names(licenses.TEMPLATES["GPL-3.0 notice"].replace("version 3", "version 7")) == []


def naive(t, words, coverage):
    """The longest common subsequence of any window up to three times as long."""
    best = 0
    for a in range(len(words)):
        row = [0] * (len(t) + 1)
        for w in words[a : a + 3 * len(t)]:
            up = row[:]
            for j, x in enumerate(t):
                row[j + 1] = up[j] + 1 if x == w else max(up[j + 1], row[j])
        best = max(best, row[-1])
    return best / len(t) >= coverage


def test_agrees_with_naive_alignment():
    rng = random.Random(2)
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    s, hits = licenses.Scanner({"t": " ".join(t)}, telling={}), 0
    for _ in range(300):
        words = [w for w in t if rng.random() < 0.9]
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["x", "y", *t]))
        words = ["q"] * rng.randrange(5) + words + ["r"] * rng.randrange(5)
        want, got = naive(t, words, 0.8), bool(s.scan(" ".join(words)))
        hits += want
        assert not got or want
        assert got or not want or len(set(words) & set(t)) < len([w for w in words if w in t])  # repeats may cost patience an anchor
    assert hits > 50


def test_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
