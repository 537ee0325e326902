"""Line dedup against brute force at several thresholds and sizes of key groups, and on odd rows."""

import random

import pytest

from querykiln.llm import linededup, minhash


def gone_lines(texts, percent):
    seen, gone = [], set()
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            s = set(line.lower().split())
            if s and any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                gone.add((i, k))
            if s:
                seen.append(s)
    return gone


@pytest.mark.parametrize("percent, few, huge", [(60, 32, 4096), (70, 2, 4), (80, 0, 2), (80, 3, 99), (90, 1, 1)])
def test_lines_at_other_thresholds(spark, monkeypatch, percent, few, huge):
    monkeypatch.setattr(linededup, "FEW", few)
    monkeypatch.setattr(linededup, "HUGE", huge)
    rng = random.Random(percent + few)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([rng.randrange(1, 14), rng.randrange(14, 40)]))] for _ in range(30)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(6)):
            b = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                b[rng.randrange(len(b))] = f"v{rng.randrange(30)}"
            lines.append("\t".join(b).title())
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "a b c\na b c d", "p q\np q r", " ".join(f"x{i}" for i in range(6000)) + "\n" + " ".join(f"x{i}" for i in range(5500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc, r.line_no) for r in linededup.removed_lines(docs, percent).collect()} == gone_lines(texts, percent)


def test_lines_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b\na b", 1, "x"), (3, "a b\nc", 2, "y"), (4, "B  a\nd", 3, "z"), (5, None, 4, "n")], "doc_id long, text string, _gone long, row string")
    got = sorted((tuple(r) for r in linededup.dedup_lines(docs).collect()), key=repr)
    assert got == sorted([(None, "a b\na b", 1, "x"), (3, "a b\nc", 2, "y"), (4, "d", 3, "z"), (5, None, 4, "n")], key=repr)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        linededup.removed_lines(docs, 40)


def test_texts_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (7, a + " z"), (6, b), (6, b), (None, a), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_shingles, r.kept) for r in minhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(5, 5, 26, True), (5, 5, 26, True), (7, 5, 27, False), (6, 5, 26, False), (6, 5, 26, False), (None, 5, 26, True), (8, 8, 0, True)], key=repr)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
