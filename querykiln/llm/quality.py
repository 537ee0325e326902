"""Operator 2 - quality classifier: a sparse rule ensemble.

Shallow trees are grown by boosting on statistics of labelled texts; each path
from a root to a node becomes a conjunctive rule; a logistic model with lasso
weights keeps few of them. The kept rules are compiled into one Spark column over
the statistics, which are Spark columns over the text themselves, so scoring is a
plain projection without Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.llm.common import columns_of, crc32_text

#: Labelled rows that the rules are learned from, at most (by hash of doc_id).
SAMPLE = 12_000
TREES, DEPTH, CUTS = 24, 3, 24
LASSO = 2e-3
THRESHOLD = 0.3
SPACE = r"[\x20\x09-\x0D]+"
STATISTICS = ("words", "word_length", "symbols", "bars", "shouts", "digits", "upper", "letters", "distinct", "repeats", "lines", "repeated_lines", "stops")


def with_statistics(df: DataFrame) -> DataFrame:
    """``df`` (with column text) and the columns of STATISTICS, doubles without nulls."""
    t = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(t)
    one = lambda char: n - F.length(F.replace(t, F.lit(char), F.lit("")))
    any_of = lambda chars: F.regexp_count(t, F.lit(f"[{chars}]"))
    df = df.withColumns({"_w": F.filter(F.split(t, SPACE), lambda x: x != ""), "_l": F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0)})
    words, lines = F.size("_w"), F.size("_l")
    w1, l1, n1 = F.greatest(words, F.lit(1)), F.greatest(lines, F.lit(1)), F.greatest(n, F.lit(1))
    df = df.withColumns({"_u": any_of("A-ZÀ-ÖØ-Þ"), "_o": any_of("^A-Za-zÀ-ÖØ-öø-ÿ")})
    return df.withColumns({
        "words": F.log1p(words.cast("double")),
        "word_length": n / w1,
        "symbols": any_of("#*$%&<>") / w1,
        "bars": one("|") / w1,
        "shouts": one("!") / w1,
        "digits": any_of("0-9") / n1,
        "upper": F.col("_u") / F.greatest(n - F.col("_o"), F.lit(1)),
        "letters": 1 - F.col("_o") / n1,
        "distinct": F.size(F.array_distinct("_w")) / w1,
        "repeats": F.size(F.filter(F.zip_with(F.col("_w"), F.slice("_w", 2, F.greatest(words - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)) / w1,
        "lines": F.log1p(lines.cast("double")),
        "repeated_lines": 1 - F.size(F.array_distinct("_l")) / l1,
        "stops": one(".") / w1,
    }).withColumns({c: F.col(c).cast("double") for c in STATISTICS}).drop("_w", "_l", "_u", "_o")


class Rules:
    """rules: lists of (statistic, '<=' or '>', value); weights; bias."""

    def __init__(self, rules: list, weights: list[float], bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    def column(self) -> Column:
        """The score as one expression over the statistics' columns."""
        z = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights):
            cond = None
            for name, side, value in rule:
                part = F.col(name) <= F.lit(float(value)) if side == "<=" else F.col(name) > F.lit(float(value))
                cond = part if cond is None else cond & part
            z = z + F.when(cond, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def _matrix(x: np.ndarray, rules: list) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for k, rule in enumerate(rules):
        for name, side, value in rule:
            v = x[:, STATISTICS.index(name)]
            out[:, k] &= v <= value if side == "<=" else v > value
    return out


def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list, path: list, depth: int, paths: list, leaves: list) -> None:
    """One regression tree on gradients g and curvatures h: every node's path and the leaves' values."""
    if path:
        paths.append(tuple(sorted(path)))
    total, curve = g.sum(), h.sum()
    best = None
    if depth and len(g) >= 40:
        for f, values in enumerate(cuts):
            n, gl, hl = (np.bincount(binned[:, f], weight, len(values) + 1)[:-1].cumsum() for weight in (None, g, h))
            gain = gl**2 / (hl + 1.0) + (total - gl) ** 2 / (curve - hl + 1.0) - total**2 / (curve + 1.0)
            gain[(n < 15) | (len(g) - n < 15)] = 0
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                best = gain[k], f, k
    if best is None:
        leaves.append((tuple(path), total / (curve + 1.0)))
        return
    _, f, k = best
    left = binned[:, f] <= k
    for side, mask in (("<=", left), (">", ~left)):
        _grow(binned[mask], g[mask], h[mask], cuts, [*path, (STATISTICS[f], side, float(cuts[f][k]))], depth - 1, paths, leaves)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Rules:
    """Boosted trees to rules, then logistic weights under an L1 penalty (accelerated proximal gradient)."""
    if len(y) == 0:
        return Rules([], [], 0.0)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    if y.min() == y.max():
        return Rules([], [], float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, CUTS))) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)])  # bin k: at most cut k
    z, rules = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(trees):
        p, leaves = 1 / (1 + np.exp(-z)), []
        _grow(binned, y - p, p * (1 - p), cuts, [], depth, rules, leaves)
        z = z + 0.4 * (_matrix(x, [path for path, _ in leaves]) @ np.array([value for _, value in leaves]))
    rules = sorted(set(rules))
    m = _matrix(x, rules)
    seen: dict[bytes, int] = {}
    for k in range(len(rules)):  # rules that hold for the same rows: the shortest stays
        key = m[:, k].tobytes()
        if key not in seen or len(rules[k]) < len(rules[seen[key]]):
            seen[key] = k
    use = sorted(k for k in seen.values() if 0 < m[:, k].sum() < len(y))
    rules, m = [rules[k] for k in use], m[:, use].astype(np.float64)
    w, b = np.zeros(len(rules)), float(np.log(share / (1 - share)))
    v, vb, t = w.copy(), b, 1.0
    rate = 4.0 / max(1.0, np.linalg.norm(np.column_stack([m, np.ones(len(y))]), 2) ** 2 / len(y))
    for _ in range(1500):
        e = 1 / (1 + np.exp(-(m @ v + vb))) - y
        new = v - rate * (m.T @ e) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0)
        nb = vb - rate * e.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return Rules([rules[k] for k in keep], w[keep].tolist(), b)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Rules:
    """Rules from at most ``sample`` labelled documents; labels other than 0 and 1 don't count."""
    spark = docs.sparkSession
    lab = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y"))
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()  # bounded by ``sample``
    if not len(chosen):
        return Rules([], [], 0.0)
    picked = F.broadcast(spark.createDataFrame(chosen))
    got = with_statistics(columns_of(docs, "doc_id", "text").join(picked, "doc_id")).select("doc_id", "_y", *STATISTICS).toPandas()
    got = got.sort_values(["doc_id", *STATISTICS])
    return fit(got[list(STATISTICS)].to_numpy(float), got["_y"].to_numpy(float))


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text.

    Null and empty texts have statistics of 0 and a score too; repeated rows are each
    scored; null ids pass through; extra columns are ignored; no rows give no rows.
    """
    return with_statistics(columns_of(docs, "doc_id", "text")).select("doc_id", rules.column().alias("score"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learn where crc32(doc_id) mod 5 is not 0, score all documents."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = crc32_text(F.col("doc_id")) % 5 == 0
    rules = learn(docs.where(~out), labels.where(~out))
    return score(docs, rules).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
ORACLE: dict[str, str] = {}
