"""Operator 7 - toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns the words of a clause into symbols (insult, threat,
target, modal, passive, negation, reported speech). Six small transducers, composed
into one, rewrite insults and threats by their surroundings: reported, negated,
announced, aimed at a target, targeted. Every arc of the composition that puts out a
match carries a weight; a clause is worth its strongest arc, and the k-th clause of a
kind adds log(1 + 1/k) of that to a text's log odds. The insult lexicon (words and
stems) and the weights are learned from labelled texts; targets, negations and the
like are word lists.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.llm.common import columns_of, crc32_text

#: Labelled rows to learn from, at most (by hash of doc_id).
SAMPLE = 8_000
THRESHOLD = 0.5
#: An insult is at least so many times likelier in toxic texts and in so many of them.
ODDS, SUPPORT = 20.0, 6
#: Stems have so many letters; they are learned where toxic texts have two words of them.
STEMS = (4, 5, 6, 7, 8)

INSULT = "idiot idiots moron morons stupid scum loser losers worthless pathetic disgusting imbecile abruti crétin idiota imbécil dummkopf".split()
THREAT = "kill killed hurt murder murdered destroy destroyed shoot shot stab stabbed beat beaten strangle strangled tuer frapper töten umbringen schlagen matar golpear".split()
TARGET = "you your yourself he she him her they them these those people tu toi vous il elle ils du dich ihr sie er tú usted ustedes él ella ellos".split()
MODAL = "will shall gonna going should must deserve vais vas va werde wirst soll voy vas debería".split()
PASSIVE = "be been get werden être ser".split()
NEGATION = "not no never isn't aren't wasn't don't nobody nicht kein keine nie non jamais ni nunca".split()
REPORTED = "said says say wrote writes called quoted reported claims claimed alleged sagte sagt schrieb dit disait écrit dijo dice escribió".split()

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.,;:!?\n()|]+")


class Transducer:
    """Letter-to-letter transducer. moves: (state, symbol) -> (state, symbol); symbols without a move pass, the state staying."""

    def __init__(self, moves: dict, start=0):
        self.moves, self.start = moves, start

    def step(self, state, symbol):
        return self.moves.get((state, symbol), (state, symbol))


def compose(*parts: Transducer, alphabet: str) -> Transducer:
    """One transducer that feeds each part's output to the next; reachable states only."""
    start = tuple(p.start for p in parts)
    moves, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for a in alphabet:
            new, b = [], a
            for p, s in zip(parts, state):
                s, b = p.step(s, b)
                new.append(s)
            moves[state, a] = (tuple(new), b)
            if moves[state, a][0] not in seen:
                seen.add(moves[state, a][0])
                todo.append(moves[state, a][0])
    return Transducer(moves, start)


def _window(trigger: str, width: int, rewrite: dict, alphabet: str) -> Transducer:
    """After ``trigger``, symbols are rewritten for ``width`` words."""
    moves = {(s, trigger): (width, trigger) for s in range(width + 1)}
    for s in range(1, width + 1):
        for a in alphabet:
            if a != trigger:
                moves[s, a] = (s - 1, rewrite.get(a, a))
    return Transducer(moves)


def _aimed(width: int) -> Transducer:
    """An announced threat t becomes T at a target up to ``width`` words later, or at once if the target came before in the passive."""
    moves = {(0, "P"): ("target", "P"), ("target", "B"): ("passive", "B"), ("passive", "t"): (0, "T")}
    for s in (0, "target", *range(1, width + 1)):
        moves[s, "t"] = (width, "t")
    for s in range(1, width + 1):
        moves |= {(s, a): (s - 1, a) for a in _OUT if a not in "Pt"}
        moves[s, "P"] = ("target", "T")
    return Transducer(moves)


#: o other, I insult, W word of an insult's stem, K threat word, P target, M modal, B passive, N negation, R reported speech;
#: out: J targeted, n negated, r reported insult, w reported or negated stem, t announced threat, T one aimed at a target, V a second word by a stem.
ALPHABET = "oIWKPMBNR"
_OUT = ALPHABET + "JnrTtwV"
GRAMMAR = compose(
    Transducer({(0, "R"): (1, "R"), (1, "I"): (1, "r"), (1, "K"): (1, "r"), (1, "W"): (1, "w")}),
    _window("N", 3, {"I": "n", "K": "n", "W": "w"}, _OUT),
    _window("M", 3, {"K": "t"}, _OUT),
    _aimed(3),
    _window("P", 4, {"I": "J"}, _OUT),
    Transducer({(0, "W"): (1, "W"), (1, "W"): (1, "V")}),
    alphabet=ALPHABET,
)
#: Matches from strongest to weakest, with the weights that arcs carry until others are learned; the last is of stems matched twice in clauses.
MATCHES = "TJIVrntWw"
BUILT_IN = np.array([3.0, 3.0, 2.0, 2.0, 0.5, 0.5, 0.3, 1.0, 0.5, 3.0])


class Model:
    """Insult words and stems, and weights of the features of ``features``."""

    def __init__(self, words: list[str], stems: list[str]):
        self.words, self.stems = sorted(set(words)), sorted(set(stems))
        self.symbol = {w: s for group, s in ((TARGET, "P"), (MODAL, "M"), (PASSIVE, "B"), (NEGATION, "N"), (REPORTED, "R"), (THREAT, "K"), (self.words, "I")) for w in group}
        self.stem = tuple(self.stems)
        whole = "|".join(map(re.escape, sorted({*self.words, *THREAT}, key=len, reverse=True)))
        stems_ = "".join(f"|{re.escape(s)}" for s in sorted(self.stems, key=len, reverse=True))
        self.scan = re.compile(rf"(?<![^\W\d_])(?:(?:{whole})(?![^\W\d_]){stems_})")
        self.weights, self.bias = BUILT_IN.copy(), -4.0

    def arcs(self) -> dict:
        """The composed transducer with weights: (state, symbol) to (state, symbol out, weight)."""
        worth = dict(zip(MATCHES, self.weights))
        return {at: (state, out, float(worth.get(out, 0.0))) for at, (state, out) in GRAMMAR.moves.items()}

    def read(self, word: str) -> str:
        s = self.symbol.get(word)
        return s if s else "W" if self.stem and word.startswith(self.stem) else "o"

    def clauses(self, text: str):
        """(start, end, symbols out) of each clause with an insult or a threat word."""
        low = text.lower()
        end = -1
        for hit in self.scan.finditer(low):
            if hit.start() < end:
                continue
            left = hit.start()
            while left > 0 and low[left - 1] not in ".,;:!?\n()|":
                left -= 1
            stop = _CLAUSE.search(low, hit.end())
            end = stop.start() if stop else len(low)
            state, out = GRAMMAR.start, []
            for w in _WORD.findall(low, left, end):
                state, b = GRAMMAR.moves[state, self.read(w)]
                out.append((w, b))
            yield left, end, out

    def features(self, text: str | None) -> list[float]:
        """log1p counts of clauses by strongest match; whether two clauses match by a stem, or one does twice."""
        counts, stems = Counter(), 0
        for _, _, out in self.clauses(text) if text else ():
            got = {b for _, b in out}
            stems += 2 * ("V" in got) or bool(got & {"W", "w"})
            best = next((b for b in MATCHES if b in got), None)
            if best:
                counts[best] += 1
        return [float(np.log1p(counts[b])) for b in MATCHES] + [float(stems > 1)]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def lexicon(texts: list[str], toxic: np.ndarray) -> tuple[list[str], list[str]]:
    """Words that are far commoner in toxic texts, and stems that toxic texts far oftener have twice.

    Of a stem and a longer one with nearly as many texts the longer one stays; then
    stems and words that a kept stem covers are dropped.
    """
    once, twice = (Counter(), Counter()), (Counter(), Counter())
    before: dict[str, set] = {}
    lines: set = set()
    for t, y in zip(texts, toxic):
        longest = set(sorted(t.split("\n"), key=len)[-3:])
        if longest & lines:  # a copy of another text would count its words again
            continue
        lines |= longest
        found = _WORD.findall(t.lower())
        words, stems = Counter(found), Counter()
        if y:
            for a, b in zip(found, found[1:]):
                before.setdefault(b, set()).add(a)
        for w, c in words.items():
            for k in STEMS:
                if len(w) >= k:
                    stems[w[:k]] += c
        once[int(y)].update(words.keys())
        twice[int(y)].update([s for s, c in stems.items() if c > 1])
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    least = max(SUPPORT, 0.01 * n1)

    def strong(neg: Counter, pos: Counter, most: float) -> dict:
        return {w: c for w, c in pos.items() if c >= least and len(w) >= 4 and (c + 0.5) / (n1 + 1) * (n0 + 1) / (neg[w] + 0.5) >= ODDS and neg[w] <= most * c}

    words, stems = strong(*once, 0.05), strong(*twice, 0.3)
    words = {w: c for w, c in words.items() if len(before.get(w, ())) >= SUPPORT}
    whole = {w for w in words if all(words.get(o, 0) <= words[w] for o in words if o.startswith(w))}
    forms = {s: sum(1 for w in once[1] if w.startswith(s)) for s in stems}
    stems = {s: c for s, c in stems.items() if forms[s] >= 5}  # a stem has forms; else the word itself is meant
    longest = [s for s in stems if not any(o != s and o.startswith(s) and stems[o] >= 0.9 * stems[s] for o in stems)]
    kept = [s for s in longest if not any(s != o and s.startswith(o) for o in longest)]
    return [w for w in words if w in whole and not w.startswith(tuple(kept) or ("\0",))], kept


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Lexicon, then logistic weights by Newton steps with a ridge; without both classes the built-in weights stay."""
    if not len(texts) or toxic.min() == toxic.max():
        return Model(INSULT, [])
    words, stems = lexicon(texts, toxic)
    model = Model([*INSULT, *words], stems)
    x = np.array([model.features(t) for t in texts])
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([0.5] * x.shape[1] + [1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (toxic - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    # a match that never occurred keeps its built-in weight, scaled to those learned
    seen = x.any(0)
    base = model.weights * (np.median(w[:-1][seen] / model.weights[seen]) if seen.any() else 1.0)
    model.weights, model.bias = np.where(seen, w[:-1], np.maximum(base, 0)), float(w[-1])
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From at most ``sample`` labelled documents; labels other than 0 and 1 don't count."""
    lab = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("_y"))
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()  # bounded by ``sample``
    if not len(chosen):
        return Model(INSULT, [])
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen))
    got = columns_of(docs, "doc_id", "text").where("text is not null").join(picked, "doc_id").select("doc_id", "text", "_y").toArrow()  # batches pass through the driver; rows would all be held there, several times
    rows = sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "text", "_y"))), key=lambda r: r[:2])
    return fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], float))


def _scored(m: Model, batch: pa.RecordBatch) -> np.ndarray:
    x = np.array([m.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(m.weights))
    return m.score(x)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text.

    Null and empty texts match nothing and score as any text without a match; repeated
    rows are each scored; null ids pass through; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(_scored(m, batch))], ["doc_id", "score"])

    return columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, each by its own text whatever its id; all columns pass through."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scored(held.value, batch) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learn where crc32(doc_id) mod 5 is not 0, score all documents."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = crc32_text(F.col("doc_id")) % 5 == 0
    model = learn(docs.where(~out), labels.where(~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
