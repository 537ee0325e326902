"""Operator 1 - language identification by a byte convolutional network.

Texts are cut into windows of fixed length. Each byte has a small vector; filters
of several widths run over a window, every filter keeps its largest response, and
a softmax over these gives the languages. Trained here in numpy on labelled text
by stochastic gradient descent; a text's score is the mean over all its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querykiln.llm.common import columns_of, crc32_text

WINDOW = 96
VECTOR = 6
WIDTHS = (2, 3, 5)
FILTERS = 10
#: Labelled texts per language that the network learns from, at most (by hash of doc_id).
SAMPLE = 250
#: Training windows per language.
WINDOWS = 1500
_LETTER = regex.compile(r"\p{L}")
#: Upper-case ASCII counts as lower-case, digits as one byte.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def windows(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts (rows of WINDOW bytes, spaces at the end) and each one's text."""
    raw = [t.encode().translate(_FOLD) for t in texts]
    n = [max(1, -(-len(b) // WINDOW)) for b in raw]
    flat = b"".join([b.ljust(k * WINDOW) for b, k in zip(raw, n)])
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), n)


class ByteNet:
    def __init__(self, langs: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, (w * VECTOR) ** -0.5, (w * VECTOR, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.p["c"] = np.zeros(len(langs), np.float32)

    def _columns(self, x: np.ndarray, w: int) -> np.ndarray:
        """(windows, places, w * VECTOR): the vectors under a filter at each place."""
        v = self.p["e"][x]
        n, length, d = v.shape
        s = v.strides
        return np.lib.stride_tricks.as_strided(v, (n, length - w + 1, w * d), s)

    def features(self, x: np.ndarray, keep: bool = False):
        out, held = [], {}
        for w in WIDTHS:
            c = self._columns(x, w)
            n, places, width = c.shape
            r = (np.ascontiguousarray(c).reshape(-1, width) @ self.p[f"f{w}"]).reshape(n, places, FILTERS)
            if keep:
                at = r.argmax(1)
                held[w] = (c, at)
            top = r.max(1) + self.p[f"b{w}"]
            out.append(np.maximum(top, 0))
        return np.concatenate(out, 1), held

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x)[0] @ self.p["o"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 6) -> None:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                at = order[a : a + batch]
                g = self._gradient(x[at], y[at])
                t += 1
                for k, d in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    s[k] = 0.999 * s[k] + 0.001 * d * d
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict:
        f, held = self.features(x, keep=True)
        z = f @ self.p["o"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z /= len(y)
        g = {"o": f.T @ z, "c": z.sum(0), "e": np.zeros_like(self.p["e"])}
        df = (z @ self.p["o"].T) * (f > 0)
        for i, w in enumerate(WIDTHS):
            c, at = held[w]
            d = df[:, i * FILTERS : (i + 1) * FILTERS]
            under = c[np.arange(len(x))[:, None], at]  # windows, filters, w * VECTOR
            g[f"f{w}"] = np.einsum("nfk,nf->kf", under, d)
            g[f"b{w}"] = d.sum(0)
            back = (d[:, :, None] * self.p[f"f{w}"].T[None]).reshape(len(x), FILTERS, w, VECTOR)
            for j in range(w):
                np.add.at(g["e"], x[np.arange(len(x))[:, None], at + j], back[:, :, j])
        return g


def train(docs: DataFrame, sample: int = SAMPLE) -> ByteNet | None:
    """Learn from at most ``sample`` texts of each non-null lang; None if there are none."""
    spark = docs.sparkSession
    w = W.partitionBy("lang").orderBy("h", "doc_id")
    ids = docs.where("lang is not null and text is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample)
    chosen = ids.select("doc_id", "lang").toPandas()  # at most ``sample`` a language
    if not len(chosen):
        return None
    picked = spark.createDataFrame(chosen[["doc_id"]].drop_duplicates())
    got = docs.join(F.broadcast(picked), "doc_id", "left_semi").select("doc_id", "lang", F.col("text")).toPandas()
    got = got[got["lang"].notna() & got["text"].notna()].sort_values(["doc_id", "text"]).reset_index(drop=True)
    langs = sorted(got["lang"].unique())
    rng = np.random.default_rng(4)
    xs, ys = [], []
    for k, lang in enumerate(langs):
        x = windows([t for t in got["text"][got["lang"] == lang] if _LETTER.search(t)])[0]
        x = x[rng.permutation(len(x))[:WINDOWS]]
        xs.append(x)
        ys.append(np.full(len(x), k))
    net = ByteNet(langs)
    net.fit(np.concatenate(xs), np.concatenate(ys))
    return net


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    ``und`` with score 0 if the text is null, has no letter, or nothing could be
    learned. Windows without a letter of their own are left out. Repeated rows are
    each predicted; null ids pass through; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if net and t and _LETTER.search(t)]
            at, size = 0, 0
            while at < len(some):
                end, size = at, 0
                while end < len(some) and (end == at or size + len(texts[some[end]]) < 400_000):
                    size += len(texts[some[end]])
                    end += 1
                which = some[at:end]
                x, of = windows([texts[i] for i in which])
                p = np.concatenate([net.predict(x[a : a + 512]) for a in range(0, len(x), 512)]).astype(float)
                weight = (((x >= 97) & (x <= 122)) | (x >= 128)).sum(1).astype(float)
                total = np.zeros((len(which), len(net.langs)))
                np.add.at(total, of, p * weight[:, None])
                total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
                for i, k, s in zip(which, total.argmax(1).tolist(), total.max(1).tolist()):
                    lang[i], score[i] = net.langs[k], min(1.0, s)
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learn where crc32(doc_id) mod 4 is not 2, predict all documents."""
    docs = columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    out = crc32_text(F.col("doc_id")) % 4 == 2
    return identify(docs, train(docs.where(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_langid": op1_langid}
ORACLE: dict[str, str] = {}
