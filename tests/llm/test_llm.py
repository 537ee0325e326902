"""Operators of querykiln.llm against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from querykiln.llm import bpe, langid, licenses, linededup, linerules, minhash, neighbors, packing, quality, toxicity
from querykiln.llm.common import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, h string"
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def docs(spark, *texts):
    """Documents with ids from 0, one repeated row, and extra columns of clashing names."""
    rows = [(i, t, "en", "s", len(t or ""), 9, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[:1]], DOCS)


ODD = (None, "", " \n\t ", "word", "a b c d e f g\n" * 3, "x" * 5000, "é" * 40 + " <|endoftext|> 日本 it's")


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: top(x) for x in up if top(x) != x} | {x: top(x) for x in got if top(x) == x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("words", [0, 60])
def test_bpe_equals_the_library(words):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(PATH), bpe.bpe_of(PATH)
    rng = random.Random(3)
    pools = ("abcdefghij" * 3 + "  \n'.,!?019ABÉß", "".join(map(chr, range(32, 0x250))) + " " * 40, "日本 абв ΣςσΟ עב हि 🎉é́İſK\x1c\x85\xa0²¼Ⅷ٣ ")
    texts = ["".join(rng.choice(p) for _ in range(rng.randrange(90))) for p in pools for _ in range(150)] + [t for t in ODD if t] + ["it's we're 'tis o'clock '''s <|startoftext|><|x|>"]
    found = sorted({w for t in texts for c in own.sections(t) if c not in own.special for w in own.pre_tokens(c)})[:words]
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.build(dict(zip(found, own.merge(found)))).to_bytes())
    assert lexicon.look_up([*found, b"zzzzqq", b""]) == [*own.merge(found), None, None]
    for t, ids in zip(texts, bpe.Encoder(own, lexicon, 500).encode(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_op6_and_op9_rows(spark):
    from tokenizers import Tokenizer

    lib, d = Tokenizer.from_file(PATH), docs(spark, *ODD, "some words " * 3000)
    for r in bpe.digest(d, PATH).collect():
        text = (ODD + ("some words " * 3000,))[r.doc_id] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for group in (60_000, 3):
        got = packing.pack(d, PATH, group=group).collect()
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append(r)
            ids = lib.encode((ODD + ("some words " * 3000,))[r.doc_id] or "", add_special_tokens=False).ids + [0]
            part = ids[r.start : r.start + r.length]
            assert r.start == 2048 * r.piece and len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        for rows in by.values():
            at = 0
            for r in sorted(rows, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048
        assert Counter(r.doc_id for r in got)[0] == 2
    assert packing.pack(d.limit(0), PATH).count() == 0


def test_sum_of_squares_is_tight():
    sizes = np.sort(np.random.default_rng(0).integers(1, 2049, 3000))[::-1]
    where, _ = packing.sum_of_squares(sizes, 2048)
    assert where.max() + 1 <= 1.03 * np.ceil(sizes.sum() / 2048)


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def test_minhash_equals_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(5, 90))] for _ in range(25)]
    texts = list(ODD)
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randrange(6)):
            c = list(b)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(len(c))] = f"v{rng.randrange(999)}"
            texts.append(" ".join(c).upper() if rng.random() < 0.2 else " ".join(c))
    sets = shingle_sets(texts, 4)
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, *texts), k=4).collect()}
    assert {i: got[i].component_id for i in got} == {i: top(i) for i in range(len(texts))}
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (top(i) == i) for i in got)


def test_block_products_find_links(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[: 60 - i]) for i in range(0, 40, 4)]
    members = spark.createDataFrame([(i, 0, i) for i in range(len(texts))], "node long, family long, comp long")
    got = components(minhash._across(members, spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 4, 80)).collect()
    sets = shingle_sets(texts, 4)
    near = {i for i in range(len(texts)) for j in range(len(texts)) if i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {r.node for r in got} | {r.component for r in got} == near


def test_lines_equal_brute_force(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 14))] for _ in range(40)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(6)):
            b = list(rng.choice(base))
            if rng.random() < 0.5:
                b[rng.randrange(len(b))] = f"v{rng.randrange(30)}"
            lines.append((" " if rng.random() < 0.2 else "") + " ".join(b).title())
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "w1\n\nw1"]
    seen, gone = [], set()
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            s = set(line.lower().split())
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                gone.add((i, k))
            if s:
                seen.append(s)
    assert {(r.doc, r.line_no) for r in linededup.removed_lines(docs(spark, *texts)).collect()} == gone
    out = linededup.dedup_lines(docs(spark, *texts))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")] and out.count() == len(texts) + 1
    for r in out.collect():
        want = None if texts[r.doc_id] is None else "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, k) not in gone)
        assert r.text == want


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(30, 8))
    x = [*(c[rng.integers(30)] + rng.normal(size=8) * 0.25 for _ in range(150)), *c[:5], *c[:5]]
    rows = [(i, [float(v) for v in e], int(i % 2)) for i, e in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [1.0, None], 0), (904, rows[0][1], None), (905, [], 1), (906, [1e300] * 8, 1), (907, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    ok = [(i, np.array(e) / np.abs(e).max(), lab) for i, e, lab in rows if lab is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links, up = defaultdict(set), {r[0]: r[0] for r in rows}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a, la in ok:
        for j, b, lb in ok:
            if i != j and la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i].add(j)
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    for shard in (16_384, 20):
        got = {r.vec_id: (r.n_links, r.component_id) for r in neighbors.near_duplicates(df, shard=shard).collect()}
        assert got == {i: (len(links[i]), top(i)) for i in up}


def test_graph_recall():
    rng = np.random.default_rng(4)
    c = rng.normal(size=(500, 32))
    x = np.concatenate([c, c + rng.normal(size=c.shape) * 0.2, c + rng.normal(size=c.shape) * 0.2])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    u, v = neighbors.links_of(x, x, 0.93)
    truth = x @ x.T >= 0.93
    assert truth[u, v].all() and len(set(zip(u.tolist(), v.tolist()))) >= 0.97 * truth.sum()


def test_language_accuracy(spark):
    got = langid.op1_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("held_out and n > 100").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.9 and got["score"].between(0, 1).all()
    odd = langid.identify(docs(spark, *ODD), langid.ByteNet(["a", "b"])).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd][:4] == ["und"] * 4 and langid.train(docs(spark).limit(0)) is None


@pytest.mark.parametrize("query, label, least", [(quality.op2_quality, "quality", 0.9), (toxicity.op7_toxicity, "toxic", 0.8)])
def test_classifiers(spark, query, label, least):
    sf = SF.replace("0.001", "0.01")
    got = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    one, zero = got[got[label] == 1]["score"].to_numpy(), got[got[label] == 0]["score"].to_numpy()
    assert (one[:, None] > zero[None, :]).mean() + 0.5 * (one[:, None] == zero[None, :]).mean() > least


def test_odd_rows_score(spark):
    d, labels = docs(spark, *ODD), spark.createDataFrame([(0, None, 1), (3, 1, 0), (4, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(d, quality.learn(d, labels)).where("score between 0 and 1").count() == len(ODD) + 1
    assert toxicity.score(d, toxicity.learn(d, labels)).where("score between 0 and 1").count() == len(ODD) + 1
    assert quality.learn(d, labels.limit(0)).rules == []


def test_grammar():
    m = toxicity.Model(toxicity.INSULT, ["zrk"])
    out = lambda t: ["".join(b for _, b in c[2] if b in toxicity.MATCHES) for c in m.clauses(t)]
    assert out("you are an idiot. not an idiot, he said idiot; i will kill you") == ["J", "n", "r", "tT"]
    assert out("zrkaba and zrkabo\nhello") == ["WV"] and out("idiotic words") == []
    assert m.features("zrka zrkb")[-1] == m.features("zrka. zrkb")[-1] == 1.0 and m.features("zrka")[-1] == 0.0 and m.features(None) == [0.0] * 10


def test_threats_need_a_target():
    m = toxicity.Model(toxicity.INSULT, [])
    out = lambda t: ["".join(b for _, b in c[2] if b in toxicity.MATCHES) for c in m.clauses(t)]
    for text, want in [("i will kill you", "tT"), ("they will hurt all of them", "tT"), ("they should be shot by us", "T"), ("they deserve to be beaten", "T"), ("we will kill time", "t"), ("he will kill time", "t"), ("this will destroy the competition record", "t"), ("i will not kill you", "n"), ("she said i will kill you", "r")]:
        assert out(text) == [want]
    by_arcs = m.arcs()
    assert {w for _, b, w in by_arcs.values() if b == "T"} == {toxicity.BUILT_IN[0]} and all(w == 0 for _, b, w in by_arcs.values() if b not in toxicity.MATCHES)
    score = lambda t: m.score(toxicity.np.array([m.features(t)]))[0]
    assert score("i will kill you") > 3 * score("we will kill time")


def test_score_is_the_sum_of_clause_weights():
    m = toxicity.Model(toxicity.INSULT, ["zrk"])
    text = "you idiot. what an idiot. i will kill you\nwe will kill time, she said idiot. i will kill them, moron"
    arcs, odds, seen = m.arcs(), m.bias, {}
    for left, end, out in m.clauses(text):
        state, path = toxicity.GRAMMAR.start, []
        for w, _ in out:
            state, b, weight = arcs[state, m.read(w)]
            path.append((toxicity.MATCHES.find(b), b, weight))
        best = min((p for p in path if p[0] >= 0), default=None)
        if best:
            k = seen[best[1]] = seen.get(best[1], 0) + 1
            odds += best[2] * toxicity.np.log(1 + 1 / k)
    assert abs(m.score(toxicity.np.array([m.features(text)]))[0] - 1 / (1 + toxicity.np.exp(-odds))) < 1e-12 and len(seen) >= 4


def test_line_rules(spark):
    good = "This is a plain line with some words that say one thing. " * 3
    rng = random.Random(0)
    many = "\n".join(" ".join(f"word{rng.randrange(9999)}" for _ in range(12)) + "." for _ in range(8))
    menu = "\n".join(" | ".join(f"m{i}{j}" for j in range(12)) for i in range(9))
    field = linerules.learn(docs(spark, many, menu, good))
    got = {r.doc_id: r for r in linerules.judge(docs(spark, *ODD, many, menu), field).collect()}
    assert got[len(ODD)].kept and not got[len(ODD) + 1].kept and not got[len(ODD) + 1].base_failed
    assert got[0].base_failed and got[0].n_words == 0 and (got[4].n_words, got[4].n_dup_lines, got[4].n_repeat_words) == (21, 2, 21)
    f = linerules.Field(np.zeros(1), np.array([[0.5, -0.2], [-0.4, 0.3]]))
    for e in ([0.3, -1.0, 2.0, 0.1], [-3.0], [1.0, 1.0]):
        best = max(np.ndindex(*[2] * len(e)), key=lambda y: sum(a for a, b in zip(e, y) if b) + sum(f.move[p, q] for p, q in zip(y, y[1:])))
        assert f.viterbi(e) == list(best)


def test_licenses(spark):
    notice = licenses.TEMPLATES["MIT grant"]
    texts = [*ODD, "x " + notice + " y", notice.replace("restriction", "limits"), "Licensed under CC BY-NC 4.0.\nAll rights reserved.", "we license nothing"]
    got = [(r.doc_id, r.license) for r in licenses.scan(docs(spark, *texts)).orderBy("doc_id", "start_char").collect()]
    n = len(ODD)
    assert got == [(n, "MIT grant"), (n + 1, "MIT grant"), (n + 2, "CC-BY-NC-4.0 line"), (n + 2, "All rights reserved")]
    a, b = "a b c d e".split(), "x a c b d d e".split()
    assert licenses.align(a, b) == sorted(licenses.align(a, b)) and len(licenses.align(a, b)) == 4


def test_pipeline(spark):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{SF}/documents.parquet")
    judged = linerules.judge(d, linerules.learn(d)).where("kept").toPandas()["doc_id"]
    one = P.quality_rules(spark, d, SF)
    assert sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted(judged) and one.columns == d.columns
    two = P.toxicity_filter(spark, one, SF)
    three = P.line_dedup(spark, two, SF)
    assert three.count() == two.count() and three.columns == d.columns
    four = P.minhash_dedup(spark, three, SF)
    rows = three.orderBy("doc_id").toPandas()
    sets = shingle_sets(rows["text"], 5)
    kept = set(four.toPandas()["doc_id"])
    for i in range(len(sets)):  # brute force: what goes has a near-duplicate, two that stay are none
        near = [j for j in range(len(sets)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        ids = rows["doc_id"].tolist()
        assert (ids[i] in kept) or near
        assert ids[i] not in kept or not [j for j in near if ids[j] in kept]
    assert [n for n, _ in P.STAGES] == ["quality_rules", "toxicity", "line_dedup", "minhash_dedup", "packing"]
    assert {r.doc_id for r in P.packing_stage(spark, four, SF).select("doc_id").collect()} == kept
