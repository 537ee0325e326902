"""Operator 8 - quality rules by line sequence labelling.

Every line of a text is content or boilerplate. A linear-chain conditional random
field over binary features of a line and its neighbours' labels is trained here on
lines that labelling functions mark; Viterbi decoding marks all lines of a text,
and the share of its words in content lines decides whether the text is kept.
Base measures of the whole text (words, symbols, repeats) decide first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.llm.bpe import in_blocks
from querykiln.llm.bytekit import Words, mixed
from querykiln.llm.common import columns_of

#: Texts that the field is trained on, at most (by hash of doc_id).
SAMPLE = 1_500
#: Lines of a training chain; longer texts make several, so that all lines are trained on.
CHAIN = 60
#: Words in content lines, of all words, that a text needs.
CONTENT = 0.5
MIN_WORDS, REPEATS = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Lines of which at least one word in 25 opens one of these are notices.
_NOTICE = (b"licen", b"rights reserved", b"copyright", b"cookie", b"subscribe", b"click here", b"privacy policy", b"terms of")
FEATURES = ("bias", "short", "long", "symbols", "many_symbols", "bars", "shouts", "upper", "repeats", "many_repeats", "digits", "plain", "ends", "notice", "seen", "first")
FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


class Lines:
    """Base measures and line features of a block of texts."""

    def __init__(self, texts: list):
        w = Words(texts, lower=False)
        raw, buf = w.raw, w.buf
        n = len(texts)
        self.n_words = w.last - w.first
        in_word = np.zeros(len(buf) + 1, np.int64)
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[w.start] += 1
        edge[w.start + w.size] -= 1
        inside = np.cumsum(edge[:-1]).astype(bool)
        np.cumsum(inside & ((buf & 0xC0) != 0x80), out=in_word[1:])
        at = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        sym = at(_SYMBOL[buf])
        span = lambda c: c[w.text_end] - c[w.text_start]
        self.word_chars, self.n_symbols = span(in_word), span(sym)
        self.n_repeat_words = self._repeats(w)
        # lines: by the newlines of the joined bytes, of which each text has one at its end
        end = np.flatnonzero(buf == 10) + 1
        start = np.concatenate([[0], end[:-1]])
        self.text = np.searchsorted(w.text_end, end)
        first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
        self.words = last - first
        seen: set = set()
        before = -1
        dup, notice = np.zeros(len(end), bool), np.zeros(len(end), bool)
        for i, (t, a, b, k) in enumerate(zip(self.text.tolist(), start.tolist(), end.tolist(), self.words.tolist())):
            if t != before:
                seen, before = set(), t
            if k:
                line = raw[a : b - 1]
                dup[i] = line in seen
                seen.add(line)
                low = line.lower()
                notice[i] = 25 * sum(map(low.count, _NOTICE)) >= k
        self.n_dup_lines = np.bincount(self.text[dup], minlength=n)
        line = lambda mask: (c := at(mask))[end] - c[start]
        k, size = np.maximum(self.words, 1), np.maximum(end - start - 1, 1)
        same = np.zeros(len(w.hash) + 1, np.int64)
        if len(w.hash) > 1:
            np.cumsum(np.concatenate([[False], w.hash[1:] == w.hash[:-1]]), out=same[1:])
        rep = (same[last] - same[np.minimum(first + 1, last)]) / k
        s, alpha = line(_SYMBOL[buf]) / k, np.maximum(line(_ALPHA[buf]), 1)
        tail = buf[np.maximum(end - 2, 0)]
        self.x = np.column_stack([
            np.ones(len(end)), self.words < 4, self.words > 40, s > 0.25, s > 0.8, line(buf == 124) / k > 0.15, line(buf == 33) / k > 0.3,
            line(_UPPER[buf]) / alpha > 0.4, rep > 0.3, rep > 0.7, line(_DIGIT[buf]) / size > 0.2, (s <= 0.05) & (rep < 0.1) & (self.words >= 8),
            np.isin(tail, list(b".?!")), notice, dup, np.concatenate([[True], self.text[1:] != self.text[:-1]]),
        ]).astype(np.float64)

    @staticmethod
    def _repeats(w: Words) -> np.ndarray:
        """Words in 3-word windows that their text holds twice or more."""
        n, h = len(w.first), w.hash
        out = np.zeros(n, np.int64)
        if len(h) < 3:
            return out
        tri = mixed(mixed(mixed(h[:-2]) + h[1:-1]) + h[2:])
        of = np.repeat(np.arange(n), w.last - w.first)
        ok = of[2:] == of[:-2]
        where = np.flatnonzero(ok)
        key = mixed(tri[where] + of[where].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = where[count[inverse] > 1]
        cover = np.zeros(len(h), bool)
        for j in range(3):
            cover[hit + j] = True
        return np.bincount(of[cover], minlength=n)

    def silver(self) -> np.ndarray:
        """Labelling functions: 1 boilerplate, 0 content, -1 unsure (lines without a word among them)."""
        f = {name: self.x[:, i] > 0 for i, name in enumerate(FEATURES)}
        bad = f["many_symbols"] | (f["symbols"] & f["bars"]) | f["many_repeats"] | (f["shouts"] & f["upper"]) | f["notice"]
        good = ~bad & f["plain"] & ~f["seen"] & ~f["upper"]
        out = np.where(bad, 1, np.where(good, 0, -1))
        out[self.words == 0] = -1
        return out


class Field:
    """Linear chain over labels 0 content, 1 boilerplate: x @ w scores boilerplate, ``move`` scores neighbours."""

    def __init__(self, w: np.ndarray, move: np.ndarray):
        self.w, self.move = w, move

    def viterbi(self, e: list[float]) -> list[int]:
        """Best labels of a chain with boilerplate scores e (content scores 0)."""
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b, back = 0.0, e[0], []
        for x in e[1:]:
            a0, b0 = a + m00, b + m10
            a1, b1 = a + m01, b + m11
            back.append((b0 > a0, b1 > a1))
            a, b = max(a0, b0), max(a1, b1) + x
        label = int(b > a)
        out = [label]
        for p in reversed(back):
            label = int(p[label])
            out.append(label)
        return out[::-1]


def train(chains: list, rounds: int = 70, rate: float = 0.15, ridge: float = 1e-3) -> Field:
    """Gradient ascent on the likelihood of what is labelled, other labels summed out.

    chains: (features, silver labels) of one text each.
    """
    d = len(FEATURES)
    w, move = np.zeros(d), np.zeros((2, 2))
    chains = [(x, y) for x, y in chains if len(x) and (y >= 0).any()]
    if not chains:
        return Field(np.array([-1.0] + [0.0] * (d - 1)), move)
    by: dict[int, list] = {}
    for x, y in chains:
        by.setdefault(len(x), []).append((x, y))
    stacks = [(np.stack([x for x, _ in v]), np.stack([y for _, y in v])) for v in by.values()]
    total = sum(len(x) for x, _ in chains)

    def marginals(e: np.ndarray, move: np.ndarray):
        """Of chains of one length, with (chains, places, 2) scores."""
        n, length, _ = e.shape
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = e[:, 0]
        for i in range(1, length):
            f[:, i] = e[:, i] + np.logaddexp(f[:, i - 1, :1] + move[0], f[:, i - 1, 1:] + move[1])
        for i in range(length - 2, -1, -1):
            v = e[:, i + 1] + b[:, i + 1]
            b[:, i] = np.logaddexp(move[:, 0] + v[:, :1], move[:, 1] + v[:, 1:])
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])[:, None, None]
        node = np.exp(f + b - z)
        pair = np.zeros((2, 2))
        if length > 1:
            v = (e + b)[:, 1:]
            for p in (0, 1):
                for q in (0, 1):
                    pair[p, q] = np.exp(f[:, :-1, p] + move[p, q] + v[:, :, q] - z[:, :, 0]).sum()
        return node, pair

    m, v = np.zeros(d + 4), np.zeros(d + 4)
    for t in range(1, rounds + 1):
        gw, gm = -ridge * w * total, -ridge * move * total
        for x, y in stacks:
            e = np.zeros((*y.shape, 2))
            e[:, :, 1] = x @ w
            held = e.copy()
            held[:, :, 1][y == 0] = -1e9
            held[:, :, 0][y == 1] = -1e9
            n1, p1 = marginals(held, move)
            n0, p0 = marginals(e, move)
            gw += np.einsum("nld,nl->d", x, n1[:, :, 1] - n0[:, :, 1])
            gm += p1 - p0
        g = np.concatenate([gw, gm.ravel()]) / total
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, move = w + step[:d], move + step[d:].reshape(2, 2)
    return Field(w, move)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from at most ``sample`` whole texts; their lines are labelled by labelling functions, no labels are read."""
    named = columns_of(docs, "doc_id", "text").where("text is not null").withColumn("h", F.xxhash64("text"))
    ids = named.select("doc_id", "h").orderBy(F.xxhash64(F.coalesce("doc_id", "h")), "doc_id", "h").limit(sample).collect()  # at most ``sample``
    chosen = docs.sparkSession.createDataFrame(sorted({tuple(r) for r in ids}, key=repr), "id long, th long")
    picked = named.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("th")), "left_semi").dropDuplicates(["doc_id", "h"])
    texts = picked.select("doc_id", "text").toPandas().sort_values(["doc_id", "text"])["text"].tolist()
    chains = []
    for a, b in in_blocks(texts, 500_000):
        lines = Lines(texts[a:b])
        y = lines.silver()
        cut = np.searchsorted(lines.text, np.arange(b - a + 1))
        chains += [(lines.x[k : min(j, k + CHAIN)], y[k : min(j, k + CHAIN)]) for i, j in zip(cut[:-1], cut[1:]) for k in range(i, j, CHAIN)]
    return train(chains)


def _judged(f: Field, batches):
    """Batches of FIELDS, in the order of the rows."""
    for batch in batches:
        doc, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text").to_pylist()
        for a, b in in_blocks(texts, 1_000_000):
            m = Lines(texts[a:b])
            failed = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > REPEATS * m.n_words)
            score, cut = (m.x @ f.w), np.searchsorted(m.text, np.arange(b - a + 1))
            some = np.flatnonzero(m.words > 0)
            at = np.searchsorted(some, cut)
            share = np.zeros(b - a)
            scores, words = score[some].tolist(), m.words[some]
            for t, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if i < j:
                    label = np.array(f.viterbi(scores[i:j]))
                    share[t] = words[i:j][label == 0].sum() / words[i:j].sum()
            kept = ~failed & (share >= CONTENT)
            cols = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words]
            yield pa.RecordBatch.from_arrays([doc.slice(a, b - a), *(pa.array(c.astype(np.int64)) for c in cols), pa.array(failed), pa.array(kept), pa.array(share)], [x.split()[0] for x in FIELDS.split(", ")])


def judge(docs: DataFrame, field: Field) -> DataFrame:
    """FIELDS of every whole text.

    Base rule: fewer than 50 words, or over half of the words in repeated 3-word
    windows, fails. Else a text is kept if at least half of its words stand in lines
    decoded as content. Null and empty texts have no words and fail; repeated rows are
    each judged; null ids pass through; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    return columns_of(docs, "doc_id", "text").mapInArrow(lambda batches: _judged(held.value, batches), FIELDS)


def keep(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, each by its own text whatever its id; all columns pass through."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            kept = [k for got in _judged(held.value, [batch]) for k in got.column("kept").to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_linerules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: base measures and verdict of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, learn(docs))


QUERIES = {"op8_linerules": op8_linerules}
ORACLE: dict[str, str] = {}
