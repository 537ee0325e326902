"""Operator 6 - BPE encoding and decoding with a transducer lexicon.

``BPE`` reproduces one public tokenizer file: pre-tokens of lower-cased text are
merged by ranked pairs whose last symbol carries a word end. ``Lexicon`` is a
minimal acyclic transducer: frequent words of the corpus share prefixes and
suffixes, arc outputs add up to a word's number, and that number finds its ids.
It is stored as one flat file that workers memory-map. Words that it lacks are
merged exactly, many at a time.

Plain Latin texts are cut into pre-tokens by array operations over the bytes of
many texts; others go through the file's own normalizer, chunk by chunk.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.llm.bytekit import IS_SPACE, segment_hashes
from querykiln.llm.common import columns_of

#: Words in the lexicon at most; it grows no further with the corpus, so its broadcast is bounded.
LEXICON_WORDS = 50_000
#: Words whose ids a worker remembers at most before it starts anew.
REMEMBERED = 400_000
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that normal form C leaves alone and lower() maps one by one.
_PLAIN = re.compile("[\x21-\x7e¡-įı-ňŊ-ž‐-‧‰-⁞]*")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t\n\v\f\r \x85\xa0  -     　]+")
_LONG = 48
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 stays, the rest follows from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class BPE:
    """One tokenizer file of the word-end kind. ``path`` names the file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab, model = dict(said["model"]["vocab"]), said["model"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.token = [names.get(i, "") for i in range(max(names) + 1)]
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rank = {}
        for r, (a, b) in enumerate(pairs):
            rank[(vocab[a], vocab[b])] = (r, vocab[a + b])
        self.rank = rank
        keys = np.array([(a << 16) | b for a, b in rank], np.uint32)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([x[0] for x in rank.values()], np.int32)[order]
        self.made = np.array([x[1] for x in rank.values()], np.int32)[order]
        self.library = Tokenizer.from_file(path)

    # merging -------------------------------------------------------------
    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0) & (a >= 0), at, -1).astype(np.int32)

    def _block(self, words: list[bytes], width: int) -> list[bytes]:
        """Words of at most ``width`` bytes, each step merging the best pair of every word.

        Symbols stay in place: ``after`` and ``before`` link the live ones of a row,
        and ``rank`` has the rank of the pair that starts at a place.
        """
        n, cols = len(words), np.arange(width)
        sizes = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        m = self.first[flat]
        m[cols >= sizes[:, None]] = -1
        m[np.arange(n), sizes - 1] = self.last[flat[np.arange(n), sizes - 1]]
        at = np.full((n, width), -1, np.int32)
        at[:, :-1] = self._look(m[:, :-1], m[:, 1:])
        rank = np.where(at >= 0, self.ranks[at], _NONE)
        after = np.where(cols + 1 < sizes[:, None], cols + 1, -1).astype(np.int8)
        before = np.broadcast_to((cols - 1).astype(np.int8), (n, width)).copy()
        rows = np.arange(n)
        while True:
            p = rank[rows].argmin(1)
            go = rank[rows, p] < _NONE
            rows, p = rows[go], p[go]
            if not len(rows):
                break
            q = after[rows, p].astype(np.int64)
            m[rows, p] = self.made[at[rows, p]]
            m[rows, q] = -1
            rank[rows, q] = _NONE
            nxt = after[rows, q].astype(np.int64)
            after[rows, p] = nxt
            has = nxt >= 0
            before[rows[has], nxt[has]] = p[has]
            got = np.where(has, self._look(m[rows, p], m[rows, np.maximum(nxt, 0)]), -1)
            at[rows, p], rank[rows, p] = got, np.where(got >= 0, self.ranks[got], _NONE)
            o = before[rows, p].astype(np.int64)
            has = o >= 0
            r, o, p = rows[has], o[has], p[has]
            got = self._look(m[r, o], m[r, p])
            at[r, o], rank[r, o] = got, np.where(got >= 0, self.ranks[got], _NONE)
        live = m >= 0
        ids = m[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _long(self, word: bytes) -> bytes:
        """One long word: a heap of pairs over a linked list."""
        ids = [*self.first[np.frombuffer(word, np.uint8)].tolist()]
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(self.rank[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.rank[pair][1], -2
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            for a in (left[i], i):
                if a >= 0 and right[a] >= 0 and (p := (ids[a], ids[right[a]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], a, p))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers, by exact ranked merging."""
        out: list = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > _LONG:
                out[i] = self._long(w)
            elif w:
                by.setdefault(min(_LONG, -(-len(w) // 4) * 4), []).append(i)
        for width, which in by.items():
            for k in range(0, len(which), 8192):
                part = which[k : k + 8192]
                for i, ids in zip(part, self._block([words[i] for i in part], width)):
                    out[i] = ids
        return out

    # taking text apart ---------------------------------------------------
    def pre_tokens(self, chunk: str) -> list[bytes]:
        """The pre-tokens of a chunk without white space, as UTF-8."""
        if _PLAIN.fullmatch(chunk):
            return [w.encode() for w in _WORD.findall(chunk.lower())]
        got = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in got]

    def sections(self, text: str) -> list[str]:
        """Chunks in order; the strings of special tokens stand alone."""
        out: list[str] = []
        for part in self.special_re.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append(part)
            elif _ODD_SPACE.search(part):
                out += [x for x in _SPACE.split(part) if x]
            else:
                out += part.split()
        return out

    def decode(self, ids) -> str:
        """The file names no decoder: tokens are joined by one space."""
        return " ".join([self.token[i] for i in ids])


class Encoder:
    """Encodes texts, remembering words (by 64-bit hashes) within a bound."""

    def __init__(self, bpe: BPE, lexicon: "Lexicon | None" = None, remembered: int = REMEMBERED):
        self.bpe, self.lexicon, self.remembered = bpe, lexicon, remembered
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)  # ascending
        self.where, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """From the lexicon, or else merged."""
        found = self.lexicon.look_up(words) if self.lexicon else [None] * len(words)
        miss = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(miss, self.bpe.merge([words[i] for i in miss])):
            found[i] = ids
        return found

    def encode(self, texts: list) -> list[np.ndarray]:
        """The ids of each text; a null text is empty."""
        plain = [t is None or PLAIN_TEXT.fullmatch(t) is not None and "<|" not in t for t in texts]
        out: list = [None] * len(texts)
        which = [i for i, p in enumerate(plain) if p]
        if which:
            for i, ids in zip(which, self._plain([texts[i] for i in which])):
                out[i] = ids
        for i, p in enumerate(plain):
            if not p:
                out[i] = self._any(texts[i])
        return out

    def _any(self, text: str) -> np.ndarray:
        """A text with rarer characters or with special tokens' strings."""
        chunks = self.bpe.sections(text)
        words: dict[bytes, bytes] = {}
        taken = {c: None if c in self.bpe.special else self.bpe.pre_tokens(c) for c in set(chunks)}
        for p in taken.values():
            words.update(dict.fromkeys(p or (), b""))
        words = dict(zip(words, self.ids_of(list(words))))
        made = {c: np.array([self.bpe.special[c]], "<u4").tobytes() if p is None else b"".join([words[w] for w in p]) for c, p in taken.items()}
        return np.frombuffer(b"".join([made[c] for c in chunks]), "<u4")

    def _plain(self, texts: list) -> list[np.ndarray]:
        raw, starts, ends, first, last = plain_words(texts)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        h = segment_hashes(np.frombuffer(raw, np.uint8), starts, ends - starts)
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
        self._learn(raw, distinct, starts[at], ends[at])
        k = np.searchsorted(self.hash, distinct)
        where, size = self.where[k][back], self.size[k][back]
        done = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=done[1:])
        ids = self.ids[np.repeat(where - done[:-1], size) + np.arange(done[-1])]
        return [ids[a:b] for a, b in zip(done[first].tolist(), done[last].tolist())]

    def _learn(self, raw: bytes, distinct: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        def unknown() -> np.ndarray:
            if not len(self.hash):
                return np.arange(len(distinct))
            k = np.minimum(np.searchsorted(self.hash, distinct), len(self.hash) - 1)
            return np.flatnonzero(self.hash[k] != distinct)

        new = unknown()
        if len(self.hash) + len(new) > self.remembered:
            self.forget()
            new = unknown()
        if not len(new):
            return
        got = self.ids_of([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        where = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(got), "<u4")])
        into = np.searchsorted(self.hash, distinct[new])
        self.hash, self.where, self.size = np.insert(self.hash, into, distinct[new]), np.insert(self.where, into, where), np.insert(self.size, into, size)


#: Texts of these characters alone are in normal form C, lower() maps their letters one by
#: one, and every character from U+00C0 on is a letter.
PLAIN_TEXT = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_KIND = np.ones(256, np.int8)  # 0 white space, 1 letter, 2 digit, 3 other
_KIND[:128] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[IS_SPACE] = 0


def plain_words(texts: list) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of plain texts: the lower-cased bytes, pre-tokens' starts and ends, and each text's range of pre-tokens."""
    parts = [t.lower().encode() if t else b"" for t in texts]
    raw = b"\n".join(parts) + b"\n"
    buf = np.frombuffer(raw, np.uint8)
    kind = _KIND[buf]
    edge = np.empty(len(kind), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= kind == 2
    quote = np.flatnonzero(buf == 39)
    for p in quote[edge[quote]].tolist():  # 's 't 're 've 'm 'll 'd are one pre-token
        n = 2 if raw[p + 1 : p + 3] in (b"re", b"ve", b"ll") else int(raw[p + 1 : p + 2] in (b"s", b"t", b"m", b"d"))
        if n:
            edge[p + 1] = False
            edge[p + 1 + n] = True
    at = np.append(np.flatnonzero(edge), len(buf))
    word = kind[at[:-1]] != 0
    starts, ends = at[:-1][word], at[1:][word]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    stop = np.cumsum(sizes)
    return raw, starts, ends, np.searchsorted(starts, stop - sizes), np.searchsorted(starts, stop)


class Lexicon:
    """Minimal acyclic transducer over words, in flat arrays.

    An arc's key is (state << 8) | byte; arc outputs add up along a word's path
    to its number, which finds its ids. States with the same arcs and finality
    are one state, so suffixes are shared.
    """

    NAMES = ("keys", "target", "output", "final", "start", "ids")
    KINDS = (np.int64, np.int32, np.int32, np.uint8, np.int64, np.uint32)

    def __init__(self, arrays: dict):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: dict[bytes, bytes]) -> "Lexicon":
        """From words to their ids, words added in byte order, one at a time."""
        ordered = sorted(w for w in words if w)
        arcs: list[dict] = [{}]
        final: list[bool] = [False]
        register: dict = {}
        path: list[tuple[int, int, int]] = []  # (parent, byte, child) not yet made minimal

        def settle(depth: int) -> None:
            while len(path) > depth:
                parent, byte, child = path.pop()
                key = (final[child], tuple(arcs[child].items()))
                arcs[parent][byte] = register.setdefault(key, child)

        before = b""
        for w in ordered:
            same = len(os.path.commonprefix([before, w]))
            settle(same)
            at = path[-1][2] if path else 0
            for byte in w[same:]:
                arcs.append({})
                final.append(False)
                arcs[at][byte] = len(arcs) - 1
                path.append((at, byte, len(arcs) - 1))
                at = len(arcs) - 1
            final[at] = True
            before = w
        settle(0)
        number, order, stack = {0: 0}, [0], [0]
        while stack:
            for t in arcs[stack.pop()].values():
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
                    stack.append(t)
        below: dict[int, int] = {}

        def count(root: int) -> None:
            todo = [root]
            while todo:
                s = todo[-1]
                wait = [t for t in arcs[s].values() if t not in below]
                if wait:
                    todo += wait
                else:
                    below[s] = final[s] + sum(below[t] for t in arcs[s].values())
                    todo.pop()

        count(0)
        keys, target, output = [], [], []
        for s in order:
            passed = int(final[s])
            for byte in sorted(arcs[s]):
                t = arcs[s][byte]
                keys.append((number[s] << 8) | byte)
                target.append(number[t])
                output.append(passed)
                passed += below[t]
        ids = [words[w] for w in ordered]
        start = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) // 4 for x in ids], out=start[1:])
        made = {"keys": keys, "target": target, "output": output, "final": [final[s] for s in order], "start": start, "ids": np.frombuffer(b"".join(ids), "<u4")}
        arrays = {n: np.asarray(made[n], k) for n, k in zip(cls.NAMES, cls.KINDS)}
        by_key = np.argsort(arrays["keys"])
        for n in ("keys", "target", "output"):
            arrays[n] = arrays[n][by_key]
        return cls(arrays)

    def to_bytes(self) -> bytes:
        head = json.dumps([len(getattr(self, n)) for n in self.NAMES]).encode().ljust(128)
        return head + b"".join(np.ascontiguousarray(getattr(self, n)).tobytes().ljust(-(-getattr(self, n).nbytes // 8) * 8, b"\0") for n in self.NAMES)

    @classmethod
    def mapped(cls, blob: bytes) -> "Lexicon":
        """Write the blob to a file of this process, map it and unlink it."""
        fd, path = tempfile.mkstemp(prefix="lexicon-")
        with os.fdopen(fd, "wb") as f:
            f.write(blob)
        held = np.memmap(path, np.uint8, "r")
        os.unlink(path)
        at, arrays = 128, {}
        for n, kind, size in zip(cls.NAMES, cls.KINDS, json.loads(bytes(held[:128]))):
            nbytes = size * np.dtype(kind).itemsize
            arrays[n] = held[at : at + nbytes].view(kind)
            at += -(-nbytes // 8) * 8
        return cls(arrays)

    def look_up(self, words: list[bytes]) -> list:
        """The ids of each word, or None; all words walk the automaton together."""
        out: list = [None] * len(words)
        if not len(self.keys):
            return out
        short = [i for i, w in enumerate(words) if 0 < len(w) <= _LONG]
        for k in range(0, len(short), 16384):
            part = short[k : k + 16384]
            sizes = np.array([len(words[i]) for i in part])
            width = int(sizes.max())
            flat = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
            state, number = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            live = np.arange(len(part))
            for j in range(width):
                done = sizes[live] <= j
                walk = live[~done]
                key = (state[walk] << 8) | flat[walk, j]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[at] == key
                state[walk[~ok]] = -1
                walk, at = walk[ok], at[ok]
                state[walk] = self.target[at]
                number[walk] += self.output[at]
                live = walk
                if not len(live):
                    break
            hit = np.flatnonzero((state >= 0) & (self.final[np.maximum(state, 0)] == 1))
            lo, hi = self.start[number[hit]].tolist(), self.start[number[hit] + 1].tolist()
            for i, a, b in zip(hit.tolist(), lo, hi):
                out[part[i]] = self.ids[a:b].tobytes()
        return out


_PER_PROCESS: dict = {}


def bpe_of(path: str) -> BPE:
    if ("bpe", path) not in _PER_PROCESS:
        _PER_PROCESS["bpe", path] = BPE(path)
    return _PER_PROCESS["bpe", path]


def encoder_of(path: str, lexicon=None, name: str = "") -> Encoder:
    """A worker's encoder; it outlives a task. lexicon: a broadcast of Lexicon.to_bytes()."""
    key = ("encoder", path, name)
    if key not in _PER_PROCESS:
        for k in [k for k in _PER_PROCESS if k[0] == "encoder"]:
            del _PER_PROCESS[k]
        _PER_PROCESS[key] = Encoder(bpe_of(path), Lexicon.mapped(lexicon.value) if lexicon is not None else None)
    return _PER_PROCESS[key]


def in_blocks(rows: list, size: int = 2_000_000):
    """Slices of texts with about so many characters each."""
    a = held = 0
    for i, t in enumerate(rows):
        held += len(t) if t else 0
        if held >= size:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(rows):
        yield a, len(rows)


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n): how often each pre-token stands in all texts."""

    def counted(batches):
        bpe, n = bpe_of(path), Counter()

        def out():
            got = list(n.items())
            n.clear()
            for i in range(0, len(got), 20_000):
                part = got[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([k for _, k in part], pa.int64())], ["word", "n"])

        for batch in batches:
            texts = [t for t in batch.column("text").to_pylist() if t]
            for a, b in in_blocks(texts):
                plain = [t for t in texts[a:b] if PLAIN_TEXT.fullmatch(t) and "<|" not in t]
                for t in texts[a:b] if len(plain) < b - a else []:
                    if "<|" in t or not PLAIN_TEXT.fullmatch(t):
                        n.update([w for c in bpe.sections(t) if c not in bpe.special for w in bpe.pre_tokens(c)])
                raw, starts, ends, *_ = plain_words(plain)
                h = segment_hashes(np.frombuffer(raw, np.uint8), starts, ends - starts)
                _, at, k = np.unique(h, return_index=True, return_counts=True)
                for s, e, c in zip(starts[at].tolist(), ends[at].tolist(), k.tolist()):
                    n[raw[s:e]] += c
                if len(n) > REMEMBERED:
                    yield from out()
        yield from out()

    return columns_of(docs, "text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> Lexicon:
    """The lexicon of the ``words`` commonest words of all texts (ties by bytes)."""
    top = word_counts(docs, path).orderBy(F.desc("n"), "word").limit(words).select("word").toArrow().column(0).to_pylist()
    return Lexicon.build(dict(zip(top, bpe_of(path).merge(top))))


def encode(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """Encode and decode every whole text.

    Returns doc_id, ids (array<int>), decoded (string). A null or empty text has
    no ids and decodes to the empty string; repeated rows are each encoded; null
    ids pass through; extra columns are ignored; an empty table gives no rows.
    """
    lexicon = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, path, words).to_bytes())

    def run(batches):
        enc = encoder_of(path, lexicon, "lexicon")
        for batch in batches:
            doc, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in in_blocks(texts):
                ids = [x.tolist() for x in enc.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([doc.slice(a, b - a).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.bpe.decode(x) for x in ids])], ["doc_id", "ids", "decoded"])

    return columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """As ``encode``, with digests in place of ids and text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    lexicon = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, path, words).to_bytes())

    def run(batches):
        enc = encoder_of(path, lexicon, "lexicon")
        decimal = [str(i) for i in range(len(enc.bpe.token))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            doc, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            n, a_sha, b_sha = [], [], []
            for a, b in in_blocks(texts):
                for x in enc.encode(texts[a:b]):
                    ids = x.tolist()
                    n.append(len(ids))
                    a_sha.append(sha(" ".join([decimal[i] for i in ids])))
                    b_sha.append(sha(enc.bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([doc.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a_sha, pa.string()), pa.array(b_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: encode and decode all documents."""
    import public_tokenizers

    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_bpe": op6_bpe}
ORACLE: dict[str, str] = {}
